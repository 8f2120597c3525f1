"""Persisted indexes, vectors and runs as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieve import SparseIndex
from tessera.sources.jsonl import exists

FORMAT = 2


class FormatError(ValueError):
    """A stored index of another format."""


def save_index(index: SparseIndex, path: str) -> None:
    """Postings are laid out by term, so a query's terms read few row groups."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus.withColumn("format", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark: SparkSession, path: str) -> SparseIndex:
    corpus = spark.read.parquet(f"{path}/corpus")
    found = corpus.select("format").first().format if "format" in corpus.columns else None
    if found != FORMAT:
        raise FormatError(f"index of format {found}, expected {FORMAT}")
    return SparseIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/term_stats"), corpus.drop("format"))


class VectorStore:
    """Vectors by chunk_id under one path; every upsert writes a new version beside the old
    one and then points to it, so readers never see half a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same chunk_id."""
        rows = rows.dropDuplicates(["chunk_id"])
        old, found = self.read(), self._versions()
        if old is not None:
            rows = old.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows)
        rows.write.parquet(f"{self.path}/v{(found[-1] if found else 0) + 1}")

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("chunk_id").isin(ids))

    def count(self) -> int:
        now = self.read()
        return now.count() if now is not None else 0

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def flatten_metadata(chunks: DataFrame) -> DataFrame:
    """Metadata as scalars: authors as a JSON string, absent fields left out."""
    return chunks.select("chunk_id", F.to_json(F.struct("paper_id", "title", F.to_json("authors").alias("authors"), "year", "venue", "section", "page")).alias("metadata"))


def rebuild_metadata(flat: DataFrame) -> DataFrame:
    parsed = F.from_json("metadata", "paper_id string, title string, authors string, year int, venue string, section string, page int").alias("m")
    return flat.select("chunk_id", parsed).select("chunk_id", "m.paper_id", "m.title", F.from_json("m.authors", "array<string>").alias("authors"), "m.year", "m.venue", "m.section", "m.page")


def save_run(run: DataFrame, path: str) -> None:
    """A run's (run, query_id, metric, value); values that cannot be scored stay NULL."""
    run.select("run", "query_id", "metric", F.nanvl("value", F.lit(None).cast("double")).alias("value")).write.mode("overwrite").partitionBy("run").parquet(path)


def load_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run") == run)


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Finite values alone are logged."""
    value = F.col("value")
    metrics.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).write.mode("append").parquet(path)
