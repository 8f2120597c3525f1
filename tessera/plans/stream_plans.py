"""Registered queries that run as streams over all that is available."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.catalogue import query, rounded
from tessera.plans.fixtures import ROUTES, table
from tessera.session import new_table_path
from tessera.sources import documents
from tessera.streaming import streams

_ROUTE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items()) + " ELSE 'abstain' END"


def _run(s, stream, mode, sink=None):
    path = new_table_path(s, "stream")
    streams.run_available(stream, f"{path}/out", mode, f"{path}/checkpoint", sink)
    return f"{path}/out"


@query("stream_spans", "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50 FROM events GROUP BY 1, 2")
def stream_spans(s, d):
    """Latencies of the spans of each day, kept per window until the watermark passes it."""
    spans = streams.span_windows(streams.available(s, d, "events").selectExpr("ts", "event_type as kind", "value as ms"), "1 day")
    out = s.read.parquet(_run(s, spans, "complete"))
    last = out.withColumn("nth", F.row_number().over(W.partitionBy("start", "kind").orderBy(F.desc("batch")))).where("nth = 1")
    return rounded(last.select("start", "kind", "n", "p50"), "p50")


@query("stream_budgets", f"""WITH e AS (SELECT user_id::VARCHAR AS run_id, ts, {_ROUTE} AS route FROM events), b AS (SELECT run_id, count(*) AS steps, count(CASE WHEN route = 'rewrite' THEN 1 END) AS rewrites,
  count(CASE WHEN route = 're_retrieve' THEN 1 END) AS re_retrievals, sum(CASE route WHEN 'rewrite' THEN 1 WHEN 're_retrieve' THEN 4 ELSE 0 END)::DOUBLE AS cost, min(ts) AS started, max(ts) AS last FROM e GROUP BY 1)
SELECT *, steps >= 12 OR rewrites > 3 OR re_retrievals > 2 AS exhausted, last + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE AS closed FROM b""")
def stream_budgets(s, d):
    """Budgets of all runs, kept as state with a timer that closes a run after an idle day."""
    steps = streams.available(s, d, "events").selectExpr("cast(user_id as string) as run_id", "ts", f"{_ROUTE} as route")
    out = s.read.parquet(_run(s, streams.running_budgets(steps), "update"))
    last = out.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("run_id", "batch")]), F.struct("batch", "closed")).alias("row"))
    return last.select("run_id", "row.*").withColumns({c: F.col(c).cast("long") for c in ("steps", "rewrites", "re_retrievals")})


@query("stream_upserts", "SELECT user_id AS chunk_id, count(*) AS copies FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_upserts(s, d):
    """Chunks by id, each once, however often a stream brings them: the stream is run twice
    into one table."""
    path = new_table_path(s, "upserts")
    for k in (1, 2):
        chunks = streams.new_chunks(streams.available(s, d, "events").selectExpr("user_id as chunk_id", "ts", "value"), "1 day")
        streams.run_available(chunks, path, "append", f"{path}-checkpoint-{k}", streams.upsert_into(path))
    return s.read.parquet(path).groupBy("chunk_id").agg(F.count("*").alias("copies"))


@query("feed_entries", "SELECT printf('2105.%05d', page_id) AS arxiv_id, url AS title, 1::BIGINT AS copies FROM pages")
def feed_entries(s, d):
    """A feed made of the pages, read as a stream that is stopped and started again."""
    root, pages = new_table_path(s, "feed"), table(s, d, "pages")
    entry = "concat('<entry><id>http://arxiv.org/abs/2105.', format_string('%05d', page_id), 'v1</id><title>', replace(replace(url, '&', '&amp;'), '<', '&lt;'), '</title><summary>s</summary><published>2021-05-01T00:00:00Z</published></entry>') as entry"
    uri = f"{root}/entries"
    n = documents.save_mirror(pages.selectExpr("page_id", entry), uri, "page_id")
    for most in (n // 2, n):  # the first run ends in the middle
        stream = documents.feed_stream(s, uri, "tessera.sources.documents:fetch_folder", most, 20, pause=0.0, hard_stop=n, lanes=64)
        q = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return s.read.parquet(f"{root}/out").groupBy("arxiv_id", "title").agg(F.count("*").alias("copies"))
