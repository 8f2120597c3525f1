"""Properties that hold for any input."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import agreement, chunking, gate, metrics, pairs, retrieve
from tessera.plans import catalogue

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
scores = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.floats(-5, 5)), max_size=25, unique_by=lambda x: x[:2])
SCORES = "query_id int, chunk_id int, score double"


@few
@given(scores, scores)
def test_fusion_is_symmetric(spark, a, b):
    x, y = (spark.createDataFrame(r, SCORES) for r in (a, b))
    got = lambda p, q: {(r.query_id, r.chunk_id): round(r.score, 12) for r in retrieve.rrf(p, q).collect()}
    assert got(x, y) == got(y, x)


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.integers(0, 3)), max_size=20, unique_by=lambda x: x[:2]), st.integers(0, 99))
def test_recall_grows_with_the_cut(spark, labels, seed):
    rng = random.Random(seed)
    qrels = spark.createDataFrame(labels, "query_id int, chunk_id int, grade int")
    found = spark.createDataFrame([(q, c, i + 1) for q in range(3) for i, c in enumerate(rng.sample(range(10), 8))], "query_id int, chunk_id int, rank int")
    queries = spark.range(3).selectExpr("cast(id as int) as query_id")
    at = [{r.query_id: r[f"recall_at_{k}"] for r in metrics.per_query(queries, found, qrels, candidate_k=k).collect()} for k in (1, 4, 8)]
    for q in range(3):
        values = [m[q] for m in at]
        assert values == [None] * 3 or values == sorted(values)


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=30))
def test_kappa_is_bounded(spark, rows):
    r = agreement.kappa(spark.createDataFrame(rows, "human int, judge int")).first()
    assert -1 - 1e-9 <= r.kappa <= 1 + 1e-9


@few
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_correction_is_a_prefix_of_the_order(spark, ps):
    rows = gate.holm(spark.createDataFrame([(f"m{i}", p) for i, p in enumerate(ps)], "metric string, p_value double")).orderBy("rank").collect()
    flags = [r.significant for r in rows]
    assert flags == sorted(flags, reverse=True)


@few
@given(st.integers(0, 10**6))
def test_packer_keeps_its_bounds(seed):
    rng = random.Random(seed)
    text = "\n\n".join(" ".join(rng.choice(["a", "bc", "def.", "gh!"]) for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 8)))
    size = chunking.Packing(target=rng.randrange(20, 60), overlap=rng.randrange(0, 20), least=10, most=80)
    out = chunking.pack(text, size)
    assert all(chunking.count_words(c.text) == c.tokens <= size.most and c.start < c.end for c in out)


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12), st.integers(0, 3)), max_size=25, unique_by=lambda x: x[:2]), st.integers(1, 3))
def test_pairs_equal_the_loop(spark, rows, gap):
    df = spark.createDataFrame([(f"q{q}", c, g) for q, c, g in rows], "query string, chunk_id int, grade int")
    want = set()
    for q in {f"q{r[0]}" for r in rows}:
        v = sorted(((g, c) for p, c, g in rows if f"q{p}" == q), key=lambda x: (-x[0], x[1]))
        own = [(q, a[1], b[1]) for i, a in enumerate(v) for b in v[i + 1 :] if a[0] - b[0] >= gap]
        want |= set(own[:4])
    assert {(r.nq, r.chosen, r.rejected) for r in pairs.preference_pairs(df, gap=gap).collect()} == want


@pytest.mark.parametrize("name", ["hybrid_search", "paired_bootstrap", "section_islands", "train_split"])
def test_results_do_not_depend_on_partitions(spark, sf, name):
    found = []
    for n in ("1", "4", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalogue.queries()[name](spark, sf)
        df = df.withColumns({c: F.round(c, 5) for c, k in df.dtypes if k == "double"})
        found.append(sorted(map(str, df.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]
