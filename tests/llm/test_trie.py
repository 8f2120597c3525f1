import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import prefix_trie
from tessera.llm.scan import scan


def plain(rows):
    """The contract's words on the driver; rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    return sorted(
        (min(m), len(node), str(min(members[node[:-1]]) if node else None), len(m), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )


def got(df):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = prefix_trie.op11_conversation_prefix_trie(spark, sf)
    assert {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    assert got(df) == plain(rows)


def odd_rows():
    rng, rows = random.Random(3), []
    for c in range(240):  # few texts, so that many prefixes are shared
        for turn in range(rng.choice([0, 1, 2, 3, 9, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "漢字"])))
    rows += [(c, t, "user", "same") for c in range(300, 420) for t in range(4)]  # copies
    rows += [(c, t, "user", "same" if t < 10 else f"{c}") for c in range(420, 470) for t in range(12)]  # a long common beginning
    rows += [(500, None, None, None), (500, None, "user", None), (500, 1, "b", "x"), (500, 1, "a", "y"), (500, 1, "a", "x"), (500, 1, "a", "x"), (500, -3, "", "")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (-7, 0, "user", "same"), (-5, 0, "user", "same"), (2**62, 1, "user", "far"), (601, 0, "user", "one")]
    return rows


def test_odd_rows_and_oversized_turns(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("p1", "q1", "place", "depth", "bytes", "h", "base", "n", "part", "edge", "bucket", "top")}).repartition(5)
    # the contract's c - c % 5 for a negative c is that of SQL
    want = plain([r for r in rows if r[0] is None or r[0] >= 0 or r[0] == -5])
    for limit, bucket in ((prefix_trie.LIMIT, prefix_trie.BUCKET), (3, 10)):
        assert got(prefix_trie.conversation_trie(df.where("conv_id is null or conv_id <> -7"), limit, bucket)) == want
    assert got(prefix_trie.conversation_trie(df.limit(0))) == []
    assert got(prefix_trie.conversation_trie(df.where("conv_id is null"))) == []


def test_a_conversation_without_turns(spark):
    """Rebuilt from a conversation that is absent, or shorter than h, and no turns of its own after h."""
    rows = [(c, 0, "user", "x") for c in range(1, 60) if c % 5]
    want = plain(rows)
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == want and any(r[1] == 0 and r[3] > 40 for r in want)
    turnless = [(c, 0, "user", "x") for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert [r[:6] for r in got(prefix_trie.conversation_trie(spark.createDataFrame(turnless, SCHEMA)))] == [(min(c for c, *_ in turnless), 0, "None", len(turnless), 0, 1)]


def test_one_conversation_with_most_rows(spark):
    """A hot conversation is ordered by many tasks; a deep trie needs no recursion."""
    rows = [(3, t, "user", f"t{t % 7}") for t in range(6000)] + [(0, t, "user", f"t{t}") for t in range(8)] + [(c, 0, "user", "x") for c in range(20, 40)]
    random.Random(1).shuffle(rows)
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain(rows)


def test_ends_in_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", "same") for c in range(300, 420) for t in range(4)]
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_scan(spark):
    """Places and running sums of a key that spans tasks, small batches included."""
    rng = np.random.default_rng(2)
    rows = [(int(k), int(o), int(v)) for k, o, v in zip(rng.choice([1, 2, 2, 2, 2, 2, 5, 9], 5000), rng.permutation(5000), rng.integers(-(2**63), 2**63 - 1, 5000))]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("2000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        have = {(r.k, r.o): (r.place, r.v_before, r.v_with) for r in scan(df, "k", [F.col("o")], ["o"], ("v",), "test").collect()}
        want, state = {}, {}
        signed = lambda x: (x + 2**63) % 2**64 - 2**63
        for k, o, v in sorted(rows):
            n, s = state.get(k, (0, 0))
            want[k, o] = (n, signed(s), signed(s + v))
            state[k] = (n + 1, s + v)
        assert have == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert scan(df.limit(0), "k", [F.col("o")], ["o"], ("v",), "test").collect() == []
