"""The agent loop, added chunks, joint scores and the registry's log."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import increment, joint, loop, policy, registry, retrieve
from tessera.session import put_if_absent, read_text, write_text

REPLY = "run_id int, step int, label string, confidence double, failed boolean, kinds array<string>, passed boolean, faithfulness_confidence double, relevance int, answer_confidence double, evidence_sufficient boolean"
GOOD = ("sufficient", 0.9, False, [], True, 0.9, 3, 0.9, True)


def play(spark, scripts, chunks=3):
    """Runs whose judges say what the scripts say, step by step (the last reply goes on)."""
    rows = [(i, k, *(script[min(k, len(script) - 1)])) for i, script in scripts.items() for k in range(14)]
    said = spark.createDataFrame(rows, REPLY)
    ask = spark.createDataFrame([(i, f"q{i}") for i in scripts] + [(min(scripts), "again")], "run_id int, question string")
    search = lambda asks: asks.select("run_id", F.explode(F.sequence(F.lit(1), F.lit(chunks))).alias("rank")).selectExpr("run_id", "rank as chunk_id", "rank") if chunks else asks.selectExpr("run_id", "1 as chunk_id", "1 as rank").where("false")
    verdicts = lambda live: live.join(said, (live.run_id == said.run_id) & (live.steps_used == said.step)).drop(said.run_id).drop("step")
    runs, evidence = loop.run(ask, search, verdicts)
    return {r.run_id: r for r in runs.collect()}, evidence


def test_every_run_ends(spark):
    change = lambda **new: tuple(new.get(n, g) for n, g in zip(loop.REPLIES, GOOD))
    deep = change(passed=False, kinds=["unsupported_claim"])
    shallow = change(passed=False, kinds=["missing_citation"])
    runs, evidence = play(spark, {
        1: [GOOD], 2: [GOOD, deep, GOOD], 3: [GOOD, shallow], 4: [change(label="insufficient")], 5: [GOOD, change(failed=True)],
        6: [change(failed=True), GOOD], 7: [GOOD, change(evidence_sufficient=False)], 8: [GOOD, change(kinds=["new_kind"], passed=False)],
        9: [GOOD, change(relevance=1), GOOD, change(relevance=1), GOOD, shallow, shallow, GOOD],
    })
    path = lambda i: [(t.node, t.route, t.trigger) for t in runs[i].trajectory]
    assert path(1) == [("triage", "write", "evidence_ok"), ("editor", "accept", "passed")] and runs[1].outcome == "accepted" and runs[1].question == "again"
    assert [r for _, r, _ in path(2)] == ["write", "re_retrieve", "write", "accept"] and runs[2].rounds == 2 and runs[2].drafts == 2 and runs[2].cost_spent == 4
    assert [r for _, r, _ in path(3)] == ["write", "rewrite", "rewrite", "rewrite", "escalate"] and path(3)[-1][2] == "rewrite_budget_exhausted"
    assert [r for _, r, _ in path(4)] == ["re_retrieve", "re_retrieve", "abstain"] and runs[4].drafts == 0
    assert path(5)[-1] == ("editor", "escalate", "unexplained_failure")  # a lost verdict is not guessed at
    assert path(6) == [("triage", "write", "evidence_ok"), ("editor", "accept", "passed")]  # a lost triage is partial
    assert runs[7].outcome == "abstained" and path(8)[-1][2] == "unclassified_violation"
    assert [r for _, r, _ in path(9)] == ["write", "re_retrieve", "write", "re_retrieve", "write", "rewrite", "rewrite", "accept"]
    # evidence counts once however often it is found
    assert all(r.n_evidence == 3 for r in runs.values()) and evidence.count() == 3 * 9
    given = {r.run_id: r for r in loop.handovers(spark.createDataFrame(list(runs.values())), evidence, {"evidence_insufficient": "label it"}).collect()}
    assert set(given) == {3, 4, 5, 7, 8} and given[4].next_step == "label it" and given[3].next_step.startswith("Unrecognised")
    assert given[3].evidence_ids == [1, 2, 3] and given[4].trajectory.split("\n")[-1] == "2. abstain evidence_insufficient"


def test_no_evidence_abstains_and_no_runs_end_at_once(spark):
    runs, evidence = play(spark, {1: [GOOD]}, chunks=0)
    assert runs[1].outcome == "abstained" and runs[1].n_evidence == 0 and evidence.count() == 0
    none, _ = loop.run(spark.createDataFrame([], "run_id int, question string"), None, None)
    assert none.collect() == []


def test_the_loop_stops_a_policy_that_does_not(spark, monkeypatch):
    monkeypatch.setattr(loop, "_decision", lambda *a: F.struct(F.lit("rewrite").alias("route"), F.lit("again").alias("trigger")))
    runs, _ = play(spark, {1: [GOOD]})
    assert runs[1].outcome == "escalated" and runs[1].steps_used == policy.MAX_STEPS + 1 and runs[1].trajectory[-1].node == "loop"


def test_added_chunks_make_the_same_index(spark):
    rows = [(i, t) for i, t in enumerate(["graph model", "graph text words", "", "model model tree", "graph", None, "tree tree"])]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    whole = retrieve.sparse_index(chunks)
    for base in ("chunk_id < 3", "chunk_id = 3", "true", "false"):
        known = chunks.where(base)
        got = increment.extend(retrieve.sparse_index(known, persist=True), chunks.unionByName(chunks.where("chunk_id = 4")), known)
        for a, b in ((got.postings, whole.postings), (got.term_stats, whole.term_stats), (got.corpus, whole.corpus)):
            assert sorted(map(tuple, a.select(*sorted(b.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))


def test_discovery_never_raises(spark):
    known = spark.createDataFrame([(1, "old")], "chunk_id int, text string")

    def down():
        raise ConnectionError("no network")

    lost = increment.discover(down, known)
    assert not lost.found_anything and lost.error == "no network"
    assert increment.discover(lambda: known, known).error == "no new candidates found"
    broken = increment.discover(lambda: known.select("chunk_id"), known)
    assert broken.index is None and broken.error
    found = increment.discover(lambda: spark.createDataFrame([(i, f"new graph {i}") for i in (1, 2, 3, 4)], "chunk_id int, text string"), known, most=2)
    assert found.found_anything and found.error is None and [r.chunk_id for r in found.chunks.orderBy("chunk_id").collect()] == [2, 3]
    # searched beside the base, ranked anew, each chunk once
    one = spark.createDataFrame([(1, "a", 0.9), (1, "s", 0.6)], "query_id int, chunk_id string, score double")
    two = spark.createDataFrame([(1, "l", 0.95), (1, "s", 0.9), (1, "m", 0.1)], "query_id int, chunk_id string, score double")
    both = retrieve.union_backends(one, two, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r["rank"]) for r in both] == [("l", 0.95, 1), ("a", 0.9, 2), ("s", 0.9, 3)]


def test_joint_scores_come_in_bounded_batches(spark, tmp_path):
    assert joint.batches_of([1, 2, 3, 50, 60], 60) == [(0, 3), (3, 4), (4, 5)] and joint.batches_of([], 5) == [] and joint.batches_of([100], 5) == [(0, 1)]
    pairs = [(q, c, f"w{q} w{c} the", " ".join(f"w{k}" for k in range(c * 7 % 90))) for q in range(4) for c in range(60)] + [(9, 9, None, None), (9, 10, "", "x")]
    df = spark.createDataFrame(pairs, "query_id int, chunk_id int, query string, chunk_text string").repartition(5)
    log = str(tmp_path)

    def make():
        import uuid

        made, inner = uuid.uuid4().hex, joint.interaction_scorer()

        def score(batch):
            sizes = [len((q + " " + c).split()) + 1 for q, c in batch]
            with open(f"{log}/{made}", "a") as out:
                out.write(f"{len(batch) * max(sizes)} {len(batch)}\n")
            return inner(batch)

        return score

    got = {(r.query_id, r.chunk_id): r.rerank_score for r in joint.joint_scores(df, make, 200).collect()}
    plain = dict(zip([(q, c) for q, c, *_ in pairs], joint.interaction_scorer()([(q or "", c or "") for _, _, q, c in pairs])))
    assert got == plain and got[9, 9] == 0.0
    cost = [tuple(map(int, line.split())) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert sum(n for _, n in cost) == len(pairs) and all(c <= 200 or n == 1 for c, n in cost) and len(cost) < len(pairs) / 2
    ranked = joint.joint_rerank(df.select("query_id", "chunk_id", F.lit(1).alias("rank")), df.select("query_id", "query").where("query_id < 4").distinct().groupBy("query_id").agg(F.min("query").alias("query")), df.select("chunk_id", F.col("chunk_text").alias("text")).distinct())
    assert ranked.where("query_id = 1 and rank = 1").count() == 1


def test_two_writers_lose_nothing(tmp_path, spark):
    path = f"file://{tmp_path}/log"
    errors = []

    def write(k):
        try:
            for i in range(8):
                registry.Registry(spark, path).register(f"{k}-{i}")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = registry.Registry(spark, path)
    assert not errors and now.version == 24 and len(now.entries) == 25
    a, b = registry.Registry(spark, path), registry.Registry(spark, path)
    a.register("same")
    with pytest.raises(registry.RegistryError):
        b.register("same")  # it reads on before it writes
    b.promote("same")
    a.refresh()
    assert a.champion == b.champion == "same" and a.version == 26


def test_a_writer_that_dies_leaves_the_log_whole(tmp_path, spark):
    path = f"file://{tmp_path}/log"
    registry.Registry(spark, path).register("x")
    (tmp_path / "log" / ".0000000002.json.dead").write_text('{"regis')  # a part that was never put in its place
    (tmp_path / "log" / "0000000009.json").write_text("{}")  # beyond a gap: not an entry
    r = registry.Registry(spark, path)
    assert r.version == 1 and set(r.entries) == {"baseline", "x"}
    r.promote("x")
    assert registry.Registry(spark, path).champion == "x"
    assert not put_if_absent(spark, f"{path}/0000000002.json", "other") and json.loads(read_text(spark, f"{path}/0000000002.json"))["promote"] == "x"
    write_text(spark, f"{path}/t", "one"), write_text(spark, f"{path}/t", "two")
    assert read_text(spark, f"{path}/t") == "two"


def test_an_extended_index_is_searched_where_its_terms_stand(spark):
    """Base and added chunks keep their terms in one row a chunk, so a search moves no postings (F10)."""
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["graph model", "graph text words", "", "model model tree", None, "tree tree", "graph"])], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "graph tree"), (2, "model")], "query_id int, query string")
    known = chunks.where("chunk_id % 2 = 0")
    index = increment.extend(retrieve.sparse_index(known, persist=True), chunks, known)
    found = retrieve.bm25_top(asked, index, 3)
    want = retrieve.top(retrieve.bm25(asked, retrieve.sparse_index(chunks)), 3)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(found) == key(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
