"""The block index and the vector index against the full rankings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import block_index, retrieve, vector_index
from tessera.plans import fixtures as X


def ranking(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def topics(spark):
    """Chunks of three vocabularies, with words that all of them share."""
    rng = random.Random(1)
    words = {t: [f"{t}{i}" for i in range(60)] for t in "abc"}
    rows = [(i, t, " ".join(rng.choice(words[t] if rng.random() < 0.8 else ["common", "usual"]) for _ in range(rng.choice([5, 30, 80])))) for i in range(900) for t in "abc"[i % 3]]
    rows += [(1000 + i, "a", "a1 a2 a3 common") for i in range(40)] + [(2000, "c", ""), (2001, None, None), (2002, None, "a1 b1 c1")]
    asks = [(1, "a1 a2 common"), (2, "b7"), (3, "the of"), (4, ""), (5, None), (6, "c1 c1 a5 usual"), (7, "nowhere"), (8, " ".join(words["b"]))]
    return spark.createDataFrame(rows, "chunk_id long, cluster string, text string"), spark.createDataFrame(asks, "query_id int, query string")


@pytest.mark.parametrize("clustered, segment, lead, pushed", [(True, 8, 2, 1000), (False, 1, 1, 2)])
def test_blocks_give_the_full_ranking(spark, topics, tmp_path, clustered, segment, lead, pushed):
    chunks, asked = topics
    plain = retrieve.sparse_index(chunks, persist=True)
    index = block_index.block_index(plain, chunks.select("chunk_id", "cluster") if clustered else None, segment)
    block_index.save_blocks(index, str(tmp_path))
    stored = block_index.load_blocks(spark, str(tmp_path))
    for n in (7, 2000):
        assert ranking(block_index.top_blocks(asked, stored, n, lead, pushed)) == ranking(retrieve.top(retrieve.bm25(asked, plain), n))
    assert block_index.top_blocks(asked.limit(0), stored, 5).collect() == []


def test_blocks_are_skipped_and_folders_pruned(spark, topics, tmp_path):
    chunks, asked = topics
    index = block_index.block_index(retrieve.sparse_index(chunks, persist=True), chunks.select("chunk_id", "cluster"), 8)
    block_index.save_blocks(index, str(tmp_path))
    stored = block_index.load_blocks(spark, str(tmp_path))
    one = asked.where("query_id = 1")
    found = block_index.search_blocks(one, stored, 10, lead=4)
    total, scored = found.bounds.count(), found.bounds.join(found.scored, ["query_id", "segment"]).count()
    assert scored < 0.5 * total  # nearly all segments hold 'common', few can hold all three
    blocks, _ = block_index._of_terms(stored, retrieve.query_terms(one), 1000)
    plan = blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert blocks.select(F.input_file_name()).distinct().count() < stored.blocks.select(F.input_file_name()).distinct().count() / 4
    with pytest.raises(block_index.FormatError):
        stored.corpus.write.mode("overwrite").parquet(str(tmp_path / "old" / "corpus"))
        block_index.load_blocks(spark, str(tmp_path / "old"))


def clustered_vectors(rng, centres=40, each=50, dim=16):
    x = rng.normal(size=(centres, dim))
    return (x[:, None, :] + 0.25 * rng.normal(size=(centres, each, dim))).reshape(-1, dim)


def test_few_probes_on_clusters(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = clustered_vectors(rng)
    store = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, (x[i * 37] + 0.05 * rng.normal(size=16)).tolist()) for i in range(40)], "query_id int, embedding array<double>")
    vector_index.build(store, str(tmp_path), lists=40)
    index = vector_index.load(spark, str(tmp_path))
    assert index.probes <= 6 and index.recall >= vector_index.RECALL  # of 40 lists
    truth = retrieve.cosine_top(asked, store, 30)
    found = vector_index.search(asked, index, 30)
    assert min(r.recall for r in vector_index.recall(found, truth).collect()) >= 0.8
    assert vector_index.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.95
    assert ranking(vector_index.search(asked, index, 30, exact=True)) == ranking(truth)
    # a request reads fewer than a tenth of the vectors, and few lists even when exact
    one = asked.where("query_id = 0")
    probed = index.codes.where(F.col("list").isin([0]))
    assert "PartitionFilters: [isnotnull(list" in probed._jdf.queryExecution().toString()
    unit = retrieve.unit_rows(np.array([one.first().embedding]))
    near = np.argsort(-(unit @ index.centroids.T)[0])[: index.probes].tolist()
    assert index.codes.where(F.col("list").isin(near)).count() <= 0.2 * len(x) and 4 * 30 < 0.1 * len(x)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)]  # many copies
    rows += [(300, [0.0] * 4), (301, None), (302, [1.0, None, 0.0, 0.0]), (303, [1.0, 2.0]), (304, [2.0, 1.0]), (305, []), (306, [1e200, 0.0, 0.0, 1e200]), (307, [1e-200] * 4)]
    store = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [1.0, 1.0]), (4, None), (5, [0.3, -1.0, 2.0, 0.1]), (6, [1.0] * 3), (7, [])], "query_id int, embedding array<double>")
    good = store.where("chunk_id not in (306, 307)")
    index = vector_index.build(good, str(tmp_path / "v"), lists=7)
    for n in (0, 5, 1000):
        for most in (1, 4096)[: n + 1]:
            assert ranking(vector_index.search(asked, index, n, exact=True, most=most)) == ranking(retrieve.cosine_top(asked, good, n))
    none = vector_index.build(store.limit(0), str(tmp_path / "none"))
    assert vector_index.search(asked, none, 5, exact=True).collect() == []
    with pytest.raises(vector_index.FormatError):
        vector_index.load(spark, str(tmp_path / "absent"))


def test_codes_bound_the_score():
    rng = np.random.default_rng(4)
    unit = retrieve.unit_rows(np.vstack([rng.normal(size=(500, 24)), np.zeros((1, 24)), np.eye(24)]))
    packed, error = vector_index.encode(unit)
    q = retrieve.unit_rows(rng.normal(size=(50, 24)))
    assert (np.abs(q @ vector_index.decode(packed).T - q @ unit.T) <= error + 1e-12).all()
    assert error.max() < 0.02 and packed.shape[1] == 24 + 8


def test_measured_recall_on_the_driver_tables(spark, sf, tmp_path):
    index = vector_index.build(X.vectors(spark, sf), str(tmp_path))
    asked = X.requests(spark, sf)
    truth = retrieve.cosine_top(asked, X.vectors(spark, sf), 30)
    assert vector_index.recall(vector_index.search(asked, index, 30), truth).agg(F.avg("recall")).first()[0] >= 0.9


def test_blocks_and_scores_are_made_where_their_rows_are(spark, tmp_path):
    """The build moves postings to their chunk and to their folder, the search moves the wanted
    blocks to their segment; hits are summed there."""
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 7)), "xy"[i % 2]) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, cluster string")
    plain = retrieve.sparse_index(chunks, persist=True)
    built = block_index.block_index(plain, chunks.select("chunk_id", "cluster"), 8)
    assert "hashpartitioning(term" not in built.blocks._jdf.queryExecution().executedPlan().toString()
    block_index.save_blocks(built, f"file://{tmp_path}/b")
    stored = block_index.load_blocks(spark, f"file://{tmp_path}/b")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, "ff aa dd"), (4, "zz")], "query_id long, query string")
    found = block_index.search_blocks(asked, stored, 7, 2)
    plan = found.ranking._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    key = lambda df: [(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    assert key(found.ranking) == key(retrieve.top(retrieve.bm25(asked, plain), 7))
