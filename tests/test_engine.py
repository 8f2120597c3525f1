import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.engine import Engine, Tracer, choose, ingest_corpus, with_deadline
from tessera.operators import retrieve

TEXT = "Intro\n" + "Graph models find fraud in payment networks. " * 40 + "\nMethod\n" + "We train a sparse encoder on labelled pairs. " * 60 + "\fResults\nAccuracy rises by two points.\nRecall stays as it was.\nReferences\n[1] A. B."


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("p1", TEXT), ("p2", TEXT.replace("fraud", "spam"))], "paper_id string, text string")
    manifest = spark.createDataFrame([("p1", "On fraud", 2020, "V"), ("p2", "On spam", None, "V")], "paper_id string, title string, year int, venue string")
    return ingest_corpus(docs, manifest=manifest)


@pytest.fixture(scope="module")
def engine(corpus):
    return Engine(corpus["chunks"], corpus["vectors"], config.Settings(deadline_seconds=120))


def test_stages(spark, corpus):
    assert corpus["chunks"].where("n_tokens > 700").count() == 0
    assert corpus["chunks"].select("chunk_id").distinct().count() == corpus["chunks"].count()
    assert corpus["bounds"].first().over == 0
    counts = ingest_corpus(spark.createDataFrame([("p", TEXT)], "paper_id string, text string"), "parse", dry_run=True)
    assert set(counts) == {"records", "report"}
    with pytest.raises(ValueError):
        ingest_corpus(spark.createDataFrame([], "paper_id string, text string"), "print")


def test_search(engine):
    asked = engine.requests([{"query_id": "a", "query": "payment fraud"}, {"query_id": "b", "query": "spam", "year_min": 2000}])
    answer = engine.search(asked)
    rows = answer.results.orderBy("query_id", "rank").collect()
    assert answer.error is None and answer.stamps["corpus_version"] == "v1"
    first = engine.chunk(rows[0].chunk_id).first()
    assert "fraud" in first.text and all(r.year == 2020 for r in rows if r.query_id == "b")
    assert engine.search(asked, 0).error.code == "bad_request"
    none = engine.search(engine.requests([{"query_id": "c", "query": "fraud", "year_min": 3000}]))
    assert none.error.code == "no_results" and none.error.retryable
    broken = engine.search(asked.drop("year_min"))
    assert broken.error.code == "retrieval_failed" and broken.results is None
    assert {r.status for r in engine.health().collect()} == {"ok"}
    assert engine.section("p1", "METHOD").first().position == 1
    assert engine.tracer.table(engine.spark).where("kind = 'tool'").count() >= 3


def test_ranker(corpus, engine):
    reverse = lambda df: df.withColumn("rerank_score", -F.col("score"))
    other = Engine(corpus["chunks"], corpus["vectors"], config.Settings(deadline_seconds=0), ranker=reverse)
    asked = engine.requests([{"query_id": "a", "query": "sparse encoder pairs"}])
    scores = [r.score for r in other.search(asked, 3).results.orderBy("rank").collect()]
    assert scores == sorted(scores)
    base = retrieve.baseline_rerank(engine.search(asked).results).orderBy("rank").collect()
    assert [r.rerank_score for r in base] == [1 / r["rank"] for r in base]


def test_choice(engine):
    def fails():
        raise OSError("no index")

    assert choose({"live": fails, "stub": lambda: engine}, "fraud")[0] == "stub"
    with pytest.raises(RuntimeError, match="no index"):
        choose({"live": fails}, "fraud")


def test_deadline(spark):
    from tessera.engine import DeadlineExceeded

    slow = lambda: spark.range(8, numPartitions=8).select(F.expr("java_method('java.lang.Thread', 'sleep', 4000L)")).collect()
    with pytest.raises(DeadlineExceeded):
        with_deadline(spark, 0.5, slow)
    assert with_deadline(spark, 30, lambda: 3) == 3


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"top_k": 7}')
    s = config.load(str(path), {"TESSERA_K1": "1.2"})
    assert (s.top_k, s.k1) == (7, 1.2)
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        config.load(str(path), {})


def test_spans_hold_no_text(spark):
    t = Tracer()
    with t.span("tool", "x", query="secret words"):
        pass
    assert "secret" not in str(t.rows) and t.rows[0][4] == {"query": "str:12"}
