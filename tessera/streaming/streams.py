"""Incremental forms: chunk upserts, windowed latencies, budgets of running loops."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.policy import MAX_RE_RETRIEVALS, MAX_REWRITES, MAX_STEPS, ROUTE_COST


def new_chunks(chunks: DataFrame, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """A stream's chunks, each id once; ids are remembered for ``delay``."""
    return chunks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["chunk_id"])


BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")


def upsert_into(path: str, buckets: int = BUCKETS):
    """For foreachBatch: appends the chunks of a batch that the table lacks. A batch that is
    run again appends nothing twice.

    The table has a folder for each bucket of ids, so a batch meets only the folders that
    can have its ids, and of these only the id column."""

    def write(batch: DataFrame, epoch: int) -> None:
        from tessera.sources.jsonl import exists

        spark = batch.sparkSession
        rows = batch.dropDuplicates(["chunk_id"]).withColumn("bucket", _bucket(buckets))
        if exists(spark, path):
            touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
            rows = rows.join(known_in(spark.read.parquet(path), touched), ["bucket", "chunk_id"], "left_anti")
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    return write


def known_in(table: DataFrame, touched: list[int]) -> DataFrame:
    """Ids of the given buckets of a table of chunks."""
    return table.where(F.col("bucket").isin(touched)).select("bucket", "chunk_id")


def span_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, p50, p95) of (ts, kind, ms) by event time. The percentiles are exact:
    the least value that has the share of the window's values up to it. A window keeps its
    distinct values with their counts."""
    exact = lambda q: F.expr(f"percentile_disc({q}) within group (order by ms)")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "kind")
        .agg(F.count("*").alias("n"), exact(0.5).alias("p50"), exact(0.95).alias("p95"))
        .select(F.col("window.start").alias("start"), "kind", "n", "p50", "p95")
    )


TOTALS = "steps int, rewrites int, re_retrievals int, cost double, started timestamp, last timestamp"
BUDGET = f"run_id string, {TOTALS}, exhausted boolean, closed boolean"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _budgets(idle_ms: int):
    """The processor that keeps a run's totals and closes a run that has been idle."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Budgets(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.totals = handle, handle.getValueState("totals", TOTALS)

        def _row(self, run_id: str, closed: bool) -> pd.DataFrame:
            n, rewrites, again, cost, started, last = self.totals.get()
            over = n >= MAX_STEPS or rewrites > MAX_REWRITES or again > MAX_RE_RETRIEVALS
            return pd.DataFrame([[run_id, n, rewrites, again, cost, started, last, over, closed]], columns=[c.split()[0] for c in BUDGET.split(", ")])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n, rewrites, again, cost, started, last = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.0, None, None)
            for frame in rows:
                routes = frame["route"]
                n += len(routes)
                rewrites += int((routes == "rewrite").sum())
                again += int((routes == "re_retrieve").sum())
                cost += float(routes.map(lambda r: ROUTE_COST.get(r, 1.0)).sum())
                started, last = min(frame["ts"].min(), started or frame["ts"].min()), max(frame["ts"].max(), last or frame["ts"].max())
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + idle_ms)
            self.totals.update((n, rewrites, again, cost, started, last))
            yield self._row(key[0], False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.totals.exists():
                row = self._row(key[0], True)
                self.totals.clear()
                yield row

        def close(self) -> None:
            pass

    return Budgets()


def running_budgets(steps: DataFrame, idle: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """The budget of every run of (run_id, ts, route) after each batch, kept as state until
    the run has been idle: then a last row has ``closed`` and the state is forgotten, so
    what is kept follows the runs that are under way, not all there have been."""
    import pandas as pd

    steps.sparkSession.conf.set(*STORE)
    timed = steps.select("run_id", F.col("ts").cast("timestamp").alias("ts"), "route").withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(_budgets(int(pd.Timedelta(idle).total_seconds() * 1000)), BUDGET, "Update", "EventTime")


def run_available(stream: DataFrame, path: str, mode: str, checkpoint: str, sink=None) -> None:
    """Run a stream over all there is and end. Without ``sink`` every batch is a folder
    batch=n under ``path``, written anew if the batch is run again."""

    def folder(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink or folder).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def available(spark, d: str, name: str) -> DataFrame:
    """A given table as a stream: its file, or the files of its folder."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")
