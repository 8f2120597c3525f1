"""Prefix trie of conversations.

Turns are ordered within conversations and conversations rebuilt from the first turns of another (see
:func:`rebuild`). The digest of a prefix is the sum of hashes of its (place, role, text), so
equal prefixes are one node wherever they stand; a node's members are counted by a
pre-aggregated grouping, which leaves one row for each node, however many copies there are.

Nodes are hash-partitioned by the digest of their first turn into buckets of about
``BUCKET`` nodes. In each bucket an ``applyInPandas`` builds tries of dictionary pointers and
sums them up from the leaves by an iterative postorder. A first turn with more than
``LIMIT`` different conversations is oversized: its top node is set aside and the rest is partitioned
again by the next turn, and so on; nodes set aside get their sums from their children's, deepest
first. What a task holds is bounded by ``LIMIT`` conversations of the longest kind.

Ids of the conversations that end at a node are hashed in order: ranges of (node, id) become strings of
bounded length first, so a node with very many of them is read by one task as few long rows,
and never collected. Digests have 128 bits.

Defined cases: rows without conv_id belong to no conversation; a null turn comes first;
equal turns of a conversation come by role, then text; a null role or text is empty;
repeated rows are turns of their own; a conversation that is rebuilt without turns is a
member of the root alone; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scan import scan
from tessera.session import materialize, ship

BUCKET = 20_000  # nodes of a bucket, about
LIMIT = 4096  # different conversations of a subtrie that one task builds
CHUNK = 1 << 14  # ids of one string
GROUP, HEADS, OF = 5, 9, 8  # conversations share turns in groups of 5; fewer than 9 of them
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0 on), d1, d2 (digest of role and text), bytes of every turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    rows = rows.withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64("text", F.lit(17), "role"), "bytes": F.octet_length("text").cast("long")})
    return scan(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["d1", "d2", "bytes"], (), "trie-turns")


def rebuild(ordered: DataFrame) -> DataFrame:
    """conv_id, depth (from 1 on), d1, d2, bytes: the first h turns of conversation c - c % 5,
    then the conversation's own turns after its first h, where h = crc32(decimal c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = ordered.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < OF)).withColumnRenamed("conv_id", "base")
    convs = ordered.where("place = 0").select("conv_id", base.alias("base"), h.alias("h"))
    first = convs.join(heads, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "d1", "d2", "bytes")
    sizes = heads.groupBy("base").agg((F.max("place") + 1).alias("n"))
    own = ordered.withColumns({"base": base, "h": h}).where("place >= h").join(sizes, "base", "left")
    at = F.least("h", F.coalesce("n", F.lit(0))) + F.col("place") - F.col("h") + 1
    return first.unionByName(own.select("conv_id", at.alias("depth"), "d1", "d2", "bytes"))


def prefixes(paths: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (digest of the prefix), q1, q2 (that of its parent), bytes."""
    rows = paths.withColumns({"e1": F.xxhash64("depth", "d1", "d2"), "e2": F.xxhash64("d2", "depth", F.lit(5), "d1")})
    done = scan(rows, "conv_id", [F.col("depth")], ["depth", "bytes"], ("e1", "e2"), "trie-prefixes")
    return done.selectExpr("conv_id", "depth", "e1_with as p1", "e2_with as p2", "e1_before as q1", "e2_before as q2", "bytes")


def subtries(rows):
    """Sums of the tries of one bucket: rows p, q (parent), conv_id, n_convs, bytes."""
    pointer = {p: k for k, p in enumerate(zip(rows.p1, rows.p2))}
    up = [pointer.get(q, -1) for q in zip(rows.q1, rows.q2)]
    children: dict[int, list[int]] = {}
    for k, parent in enumerate(up):
        children.setdefault(parent, []).append(k)
    order, stack = [], list(children.get(-1, ()))  # tops: their parents are elsewhere
    while stack:
        k = stack.pop()
        order.append(k)
        stack.extend(children.get(k, ()))
    leaves, kids = [0] * len(up), [len(children.get(k, ())) for k in range(len(up))]
    saved = ((rows.n_convs - 1) * rows.bytes).tolist()
    for k in reversed(order):  # children before their parents
        leaves[k] = leaves[k] or 1
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    conv = rows.conv_id.tolist()
    parents = [conv[k] if k >= 0 else 0 for k in up]
    return pd.DataFrame(
        {"p1": rows.p1, "p2": rows.p2, "q1": rows.q1, "q2": rows.q2, "depth": rows.depth, "conv_id": rows.conv_id, "n_convs": rows.n_convs}
        | {"parent_conv_id": parents, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "top": [k < 0 for k in up]}
    )


BUILT = "p1 long, p2 long, q1 long, q2 long, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _hash_ends(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of rows (conv_id, p1, p2)."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (batch.column(c).to_numpy() for c in ("p1", "p2", "conv_id"))
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]))
            starts = np.union1d(starts, np.arange(0, len(ids), CHUNK))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(p1[starts]), pa.array(p2[starts]), pa.array(ids[starts]), pa.array(texts)], names=["p1", "p2", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for p1, p2, text in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
                if (p1, p2) == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (p1, p2), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["p1", "p2", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=["p1", "p2", "ends_sha256"])

    ordered = ends.repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").select("p1", "p2", "conv_id")
    chunks = ordered.mapInArrow(strings, "p1 long, p2 long, first long, ids string")
    dealt = chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return dealt.mapInArrow(hashes, "p1 long, p2 long, ends_sha256 string")


def trie(paths: DataFrame, convs: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """The nodes of conversations: ``paths`` as from :func:`rebuild`, ``convs`` has each conv_id once,
    with turns or without."""
    spark = paths.sparkSession
    ship(spark)
    steps = materialize(prefixes(paths), "trie-steps")
    # a node's rows agree in all but the conversation; the smallest stands for it
    nodes = steps.groupBy("p1", "p2").agg(*(F.min(c).alias(c) for c in ("q1", "q2", "depth", "bytes", "conv_id")), F.count("*").alias("n_convs"))

    def below(rows: DataFrame, level: int) -> DataFrame:
        """With the digest of each node's ancestor of this depth."""
        tops = steps.where(F.col("depth") == level).select("conv_id", F.col("p1").alias("a1"), F.col("p2").alias("a2"))
        return materialize(rows.join(tops, "conv_id"), "trie-nodes")

    level, rest, small, aside = 1, below(nodes, 1), [], []
    total = rest.count()
    while True:
        sizes = rest.groupBy("a1", "a2").agg(F.count_distinct("conv_id").alias("m")).where(F.col("m") > limit)
        oversized = materialize(sizes.select("a1", "a2"), "trie-oversized")
        if oversized.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(oversized, ["a1", "a2"], "left_anti"))
        large = rest.join(oversized, ["a1", "a2"], "left_semi")
        aside.append(large.where(F.col("depth") == level).drop("a1", "a2"))
        level += 1
        rest = below(large.where(F.col("depth") >= level).drop("a1", "a2"), level)

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket))
    held = reduce(DataFrame.unionByName, small).withColumn("bucket", F.pmod(F.xxhash64("a1", "a2"), F.lit(buckets))).drop("a1", "a2")
    built = materialize(held.groupBy("bucket").applyInPandas(subtries, BUILT), "trie-built")

    tops = built.where("top")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L as p1", "0L as p2", "cast(null as long) as q1", "cast(null as long) as q2", "0L as depth", "0L as bytes", "conv_id", "n_convs")
    known = [root, *aside]  # by depth
    parents = materialize(reduce(DataFrame.unionByName, (k.selectExpr("p1 as q1", "p2 as q2", "conv_id as parent_conv_id") for k in known)), "trie-parents")
    done, deeper = [], None
    for depth in range(len(known) - 1, -1, -1):  # from their children's sums, deepest first
        kids = tops.where(F.col("depth") == depth + 1)
        if deeper is not None:
            kids = kids.select(deeper.columns).unionByName(deeper)
        sums = kids.groupBy("q1", "q2").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        own = known[depth].join(sums.withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left")
        deeper = materialize(
            own.selectExpr(
                "p1", "p2", "q1", "q2", "depth", "conv_id", "n_convs", "coalesce(kids, 0L) as n_children",
                "coalesce(leaves, 1L) as n_leaves", "(n_convs - 1) * bytes + coalesce(saved, 0L) as saved_tokens",
            ),
            "trie-aside",
        )
        done.append(deeper)

    names = ["p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    outer = reduce(DataFrame.unionByName, [tops.select(deeper.columns), *done]).join(parents, ["q1", "q2"], "left")
    found = built.where("not top").select(names).unionByName(outer.select(names))
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("last")).select("conv_id", "last.p1", "last.p2")
    ends = convs.select("conv_id").join(last, "conv_id", "left").selectExpr("conv_id", "coalesce(p1, 0L) as p1", "coalesce(p2, 0L) as p2")
    hashed = found.join(_hash_ends(ends), ["p1", "p2"], "left")
    return hashed.select(*names[2:], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    ordered = materialize(turns(conversations), "trie-ordered")
    return trie(rebuild(ordered), ordered.where("place = 0").select("conv_id"), limit, bucket)


def op11_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
