"""JSON-lines scans and sinks with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "filename string, paper_id string, title string, year int, venue string, why_included string"
QUERIES = "query_id string, query string, intent string, split string, notes string"
QRELS = "query_id string, chunk_id string, grade int, labeler string"
VERDICTS = (
    "query string, chunk_id string, grade int, confidence double, rationale string, "
    "meta struct<judge_model:string,prompt_version:string,temperature:double,created_at:timestamp>"
)
PAIRS = "query string, chosen_id string, chosen string, rejected_id string, rejected string, margin int, source string"
BAD = "_bad"


class BadRecord(ValueError):
    """A line that is not an object of the schema, named by file and line."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lenient: lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every non-empty line has to be an object of the schema; the first five that are not
    are named. A missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = whole.where(F.trim("value") != "")
    parsed = lines.select("file", (F.col("line") + 1).alias("line"), "value", F.from_json("value", schema + f", {BAD} string", {"columnNameOfCorruptRecord": BAD}).alias("r"))
    wrong = parsed.where(F.col("r").isNull() | F.col("r")[BAD].isNotNull() | ~F.trim("value").startswith("{"))
    bad = wrong.orderBy("file", "line").limit(5).collect()
    if bad:
        raise BadRecord("; ".join(f"{b.file}:{b.line}: {b.value[:80]}" for b in bad))
    return parsed.select("r.*").drop(BAD)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The corpus manifest, one row a filename (the last of a repeated one); no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return strict(spark, path, MANIFEST).dropDuplicates(["filename"])


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Queries that training must not have: field ``query``, else ``text``."""
    return strict(spark, path, "query string, text string").select(F.coalesce("query", "text").alias("query")).where("query is not null")


def judge_scores(spark: SparkSession, path: str, is_strict: bool = True) -> DataFrame:
    return strict(spark, path, VERDICTS) if is_strict else scan(spark, path, VERDICTS).where("query is not null and chunk_id is not null")


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).json(path)


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("grade > 0")


def for_split(queries: DataFrame, split: str) -> DataFrame:
    try:
        return queries.where(F.col("split") == split)
    except AnalysisException as e:
        raise ValueError("the queries have no split") from e
