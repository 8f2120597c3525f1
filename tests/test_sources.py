import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve
from tessera.sources import documents, jsonl, stores
from tessera.streaming import streams

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>"""
ENTRY = """<entry><id>http://x/abs/{}v2</id><title>T {}</title><summary>S</summary><published>2021-05-01</published><category term="cs.IR"/><link title="pdf" href="http://x/{}"/></entry>"""


def fetch(query, start, size):
    return ATOM.format("".join(ENTRY.format(f"2105.{i:05d}", i, i) for i in range(start, start + size)))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query_id": "1", "query": "a", "split": "dev"}\n\n{"query_id": "2", "query": "b", "split": "test"}\n')
    q = jsonl.strict(spark, f"file://{path}", jsonl.QUERIES)
    assert q.count() == 2 and jsonl.for_split(q, "dev").count() == 1
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"query_id": "1"}\nnot json\n[1]\n')
    with pytest.raises(jsonl.BadRecord, match=r"bad.jsonl:2.*bad.jsonl:3"):
        jsonl.strict(spark, f"file://{bad}", jsonl.QUERIES)
    assert jsonl.scan(spark, f"file://{bad}", jsonl.QUERIES).where("query_id is not null").count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.blocklist(spark, f"file://{tmp_path}/none.jsonl")
    assert jsonl.manifest(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    block = tmp_path / "b.jsonl"
    block.write_text(json.dumps({"query": "x"}) + "\n" + json.dumps({"text": "y"}) + "\n")
    assert sorted(r.query for r in jsonl.blocklist(spark, f"file://{block}").collect()) == ["x", "y"]
    jsonl.write(q, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_stores(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "graph model"), ("b", "text")], "chunk_id string, text string")
    path = f"file://{tmp_path}/index"
    stores.save_index(retrieve.sparse_index(chunks), path)
    asked = spark.createDataFrame([(1, "graph")], "query_id int, query string")
    assert [r.chunk_id for r in retrieve.bm25(asked, stores.load_index(spark, path)).collect()] == [r.chunk_id for r in retrieve.bm25(asked, retrieve.sparse_index(chunks)).collect()]
    spark.read.parquet(f"{path}/corpus").withColumn("format", F.lit(1)).write.parquet(f"{path}-old/corpus")
    with pytest.raises(stores.FormatError):
        stores.load_index(spark, f"{path}-old")
    store = stores.VectorStore(spark, f"file://{tmp_path}/vectors")
    assert store.count() == 0
    store.upsert(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>"))
    store.upsert(spark.createDataFrame([("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>"))
    assert store.count() == 3 and store.get(["b"]).first().embedding == [1.0, 1.0]
    store.drop()
    assert store.count() == 0
    meta = spark.createDataFrame([("a", "p", "T", ["X Y"], 2020, None, "S", 1)], "chunk_id string, paper_id string, title string, authors array<string>, year int, venue string, section string, page int")
    assert stores.rebuild_metadata(stores.flatten_metadata(meta)).collect() == meta.collect()
    run = spark.createDataFrame([("r1", "q", "m", 0.5), ("r1", "q2", "m", float("nan"))], "run string, query_id string, metric string, value double")
    stores.save_run(run, f"file://{tmp_path}/runs")
    assert {r.value for r in stores.load_run(spark, f"file://{tmp_path}/runs", "r1").collect()} == {0.5, None}
    stores.log_metrics(run, f"file://{tmp_path}/metrics")
    assert spark.read.parquet(f"file://{tmp_path}/metrics").count() == 1


def test_feed(spark):
    assert documents.build_query(["a b"], ["cs.IR"]) == '(all:"a b") AND (cat:cs.IR)'
    seen = spark.createDataFrame([("2105.00003",)], "arxiv_id string")
    rows = documents.search_feed(spark, ["graph"], [], "tests.test_sources:fetch", max_results=120, exclude=seen).collect()
    assert len(rows) == 119 and rows[0].year == 2021 and all("v" not in r.arxiv_id for r in rows)
    assert documents.search_feed(spark, ["g"], [], "tests.test_sources:fetch", max_results=999).count() == documents.HARD_STOP
    venues = spark.createDataFrame([("arXiv 2105.00003",), ("none",)], "venue string")
    assert [r.arxiv_id for r in documents.known_ids(venues).collect()] == ["2105.00003"]


def test_files_and_text(spark, tmp_path):
    for name in ("b.bin", "a.bin", "c.bin"):
        (tmp_path / name).write_text(f"Head {name}\nbody")
    parser = lambda data: [(1, i, t, 10.0, False) for i, t in enumerate(data.decode().split("\n"))]
    rows = documents.parse_files(spark, f"file://{tmp_path}/*.bin", parser, limit=2).collect()
    assert {r.paper_id for r in rows} == {"a", "b"} and len(rows) == 4
    blocks = documents.text_blocks(spark.createDataFrame([("p", "Intro\nSome text here.\fNext page.")], "paper_id string, text string"))
    assert sorted((r.page, r.block, r["size"]) for r in blocks.collect()) == [(1, 0, 14.0), (1, 1, 10.0), (2, 0, 10.0)]


def test_question_set(spark):
    paper = [("p", "T", [("Intro", ["one fact", "two"])], [("q1", "what?", ["one fact", "FLOAT SELECTED: x", "two"], ["fact"], False), ("q2", "none?", [], [], True)])]
    df = spark.createDataFrame(paper, "paper_id string, title string, sections array<struct<name:string,paragraphs:array<string>>>, qas array<struct<query_id:string,query:string,evidence:array<string>,highlighted:array<string>,unanswerable:boolean>>")
    parts = documents.question_set(df)
    assert sorted((r.query_id, r.chunk_id, r.grade) for r in parts["qrels"].collect()) == [("q1", "p-0-0", 3), ("q1", "p-0-1", 2)]
    assert {(r.query_id, r.intent) for r in parts["queries"].collect()} == {("q1", "factoid"), ("q2", "unanswerable")}


def run_stream(df, name, mode, sink=None):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", sink[1]) if sink else df.writeStream.outputMode(mode).format("memory").queryName(name)
    q = (w.foreachBatch(sink[0]) if sink else w).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    run_stream(streams.span_windows(stream.selectExpr("ts", "event_type as kind", "value as ms"), "1 day"), "spans", "complete")
    assert spark.sql("select sum(n) from spans").first()[0] == events.count()
    steps = stream.selectExpr("cast(user_id as string) as run_id", "ts", "case event_type when 'click' then 'rewrite' else 'accept' end as route")
    run_stream(streams.running_budgets(steps), "budgets", "update")
    got = {r.run_id: r.steps for r in spark.sql("select run_id, max(steps) as steps from budgets group by 1").collect()}
    assert got == {str(r.user_id): r.n for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    chunks = stream.selectExpr("cast(user_id as string) as chunk_id", "ts", "value")
    table = f"file://{tmp_path}/chunks"
    for k in range(2):
        run_stream(streams.new_chunks(chunks, "60 days"), "", "append", (streams.upsert_into(table), f"file://{tmp_path}/cp{k}"))
    assert spark.read.parquet(table).count() == events.select("user_id").distinct().count()


def test_idle_runs_are_closed_and_forgotten(spark, tmp_path):
    """Batch by batch: totals go on, an idle run is told once as closed, and begins anew."""
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    schema = "run_id string, ts timestamp, route string"
    days = [
        [("a", "2024-01-01 00:00", "rewrite"), ("b", "2024-01-01 01:00", "accept"), ("a", "2024-01-01 02:00", "re_retrieve")],
        [("a", "2024-01-01 20:00", "rewrite"), ("c", "2024-01-03 00:00", "accept")],  # b is idle since more than a day, and then a
        [("b", "2024-01-03 01:00", "rewrite"), ("c", "2024-01-03 00:30", "accept")],
    ]
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, "run_id string, ts string, route string").selectExpr("run_id", "cast(ts as timestamp) as ts", "route").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.run_available(streams.running_budgets(stream), out, "update", checkpoint)
    told = [(r.run_id, r.steps, r.rewrites, r.cost, r.closed) for r in spark.read.parquet(out).orderBy("batch", "run_id", "closed").collect()]
    assert told.count(("b", 1, 0, 0.0, True)) == 1 and told.count(("a", 3, 2, 6.0, True)) == 1
    assert ("b", 1, 1, 1.0, False) in told  # a run of the same name begins anew
    assert ("c", 2, 0, 0.0, False) in told and not any(t[0] == "c" and t[4] for t in told)


def test_upserts_read_the_touched_buckets(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    write = streams.upsert_into(table, buckets=16)
    batch = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "chunk_id long, text string")
    write(batch(range(200)), 0)
    files = spark.read.parquet(table).inputFiles()
    write(batch([*range(150, 200), *range(150, 200)]), 1)  # nothing is new: nothing is written
    assert spark.read.parquet(table).inputFiles() == files
    write(batch([3, 500]), 2)
    got = spark.read.parquet(table)
    assert sorted(r.chunk_id for r in got.collect()) == [*range(200), 500]
    touched = [r.bucket for r in batch([3, 500]).select(streams._bucket(16).alias("bucket")).collect()]
    known = streams.known_in(got, touched)
    plan = known._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<chunk_id:bigint>" in plan and known.select(F.input_file_name()).distinct().count() <= 3


def test_a_mirror_is_read_in_lanes_and_goes_on_where_it_stopped(spark, tmp_path):
    """Ids beyond five digits stay whole, and the entries are two batches, not one a page."""
    from tessera.plans import catalogue

    ids = [*range(0, 2500, 3), 99_999, 100_000, 1_234_567]
    spark.createDataFrame([(i, f"http://x/?a={i}&b=<{i}>") for i in ids], "page_id long, url string").repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    rows = catalogue.queries()["feed_entries"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.arxiv_id, r.title, r.copies) for r in rows) == sorted((f"2105.{i:05d}", f"http://x/?a={i}&b=<{i}>", 1) for i in ids)
    path = f"file://{tmp_path}/mirror"
    entries = spark.createDataFrame([(i, ENTRY.format(f"2105.{i:05d}", i, i)) for i in range(95)], "k long, entry string")
    assert documents.save_mirror(entries, path, "k", folder=10) == 95
    titles = lambda at, n: [r[1] for r in documents.parse_atom(documents.fetch_folder(path, at, n))]
    assert titles(8, 15) == [f"T {i}" for i in range(8, 23)] and titles(90, 20) == [f"T {i}" for i in range(90, 95)] and titles(95, 5) == []
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    for most in (43, 1000):  # the second run ends with the feed
        streams.run_available(documents.feed_stream(spark, path, "tessera.sources.documents:fetch_folder", most, 7, pause=0.0, hard_stop=1000, lanes=4), out, "append", checkpoint)
    got = spark.read.parquet(out)
    assert sorted(r.title for r in got.collect()) == sorted(f"T {i}" for i in range(95))
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {0: 43, 1: 52}


def test_percentiles_of_large_windows_are_exact(spark, tmp_path):
    """A window of many more values than a sketch holds, which come in several files."""
    rows = spark.range(60_000).selectExpr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 86400) as ts", "if(id % 3 = 0, 'a', 'b') as kind", "cast(id * 7919 % 60000 as double) / 4 as ms")
    rows.repartition(6).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    streams.run_available(streams.span_windows(stream, "1 day"), f"file://{tmp_path}/out", "complete", f"file://{tmp_path}/cp")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    last = out.where(out.batch == out.agg(F.max("batch")).first()[0])
    want = {}
    for r in rows.collect():
        want.setdefault(r.kind, []).append(r.ms)
    nth = lambda v, q: sorted(v)[-(-len(v) * q // 100) - 1]
    assert {r.kind: (r.n, r.p50, r.p95) for r in last.collect()} == {k: (len(v), nth(v, 50), nth(v, 95)) for k, v in want.items()}
