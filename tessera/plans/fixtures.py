"""The driver's tables as the entities that the operators work on, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, sentences

ROUTES = {"view": "write", "click": "rewrite", "signup": "re_retrieve", "error": "escalate", "purchase": "accept"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """A document is a chunk: section = language, venue = source, some without a year."""
    return table(spark, d, "documents").selectExpr(
        "doc_id as chunk_id", "doc_id as paper_id", "lang as section", "source as venue",
        "case when doc_id % 13 = 0 then null else 2016 + doc_id % 11 end as year",
        "case when doc_id % 7 = 0 then null else n_chars % 97 end as char_start", "text",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark item is a query; some have filters; its vector is the one of its number."""
    v = table(spark, d, "embeddings").selectExpr("vec_id as item_id", "embedding")
    return table(spark, d, "benchmark").join(v, "item_id").selectExpr(
        "item_id as query_id", "text as query", "embedding",
        "case when item_id % 3 = 0 then 2018 end as year_min", "case when item_id % 4 = 0 then 2024 end as year_max",
        "case when item_id % 5 = 0 then array('en', 'fr') end as sections", "case when item_id % 7 = 0 then 'SRC3' end as venue_is",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id as chunk_id", "embedding")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Ranked results of every query: the 20 documents next in a hash order."""
    q = table(spark, d, "benchmark").selectExpr("item_id as query_id")
    n = table(spark, d, "documents").selectExpr("count(*) as n")
    return q.crossJoin(F.broadcast(n)).selectExpr("query_id", "n", "explode(sequence(1, 20)) as rank").selectExpr("query_id", "(query_id * 37 + rank * rank * 11) % n as chunk_id", "rank")


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Every query's labels: 12 documents of its result range, graded by their numbers."""
    q = table(spark, d, "benchmark").selectExpr("item_id as query_id")
    n = table(spark, d, "documents").selectExpr("count(*) as n")
    rows = q.crossJoin(F.broadcast(n)).selectExpr("query_id", "n", "explode(sequence(1, 12)) as k")
    return rows.selectExpr("query_id", "(query_id * 37 + k * k * 44) % n as chunk_id", "cast((query_id + k) % 4 as int) as grade").groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade")).where("query_id % 9 <> 0")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents judged for a question about their source, with a grade by hash."""
    return table(spark, d, "documents").selectExpr(
        "concat('  What does  ', upper(source), ' say ') as query", "doc_id as chunk_id",
        "cast(pmod(cast(conv(substr(sha2(concat('grade', doc_id), 256), 1, 8), 16, 10) as bigint), 4) as int) as grade",
    )


def steps(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a day are a run; the kind of event is the route."""
    route = F.expr("case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in ROUTES.items()) + " else 'abstain' end")
    return table(spark, d, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_id").alias("seq"), route.alias("route"), F.col("event_type").alias("trigger"),
    )


def drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("draft_id"), "text", sentences("text").alias("claims")
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    rows = drafts(spark, d).select("draft_id", "text", F.posexplode("claims").alias("nth", "claim"))
    return rows.selectExpr("draft_id", "text", "nth", "claim", "length(claim) % 2 = 0 as cited", "length(claim) % 3 <> 0 as supported")


def confidences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("(doc_id % 101) / 100D as confidence", "quality = 1 as correct")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as laid-out blocks: ten lines a page, every fifth line set large."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "text"))
    return rows.selectExpr(
        "doc_id as paper_id", "cast(nth div 10 + 1 as int) as page", "cast(nth % 10 as int) as block", "text",
        "case when nth % 5 = 0 then 14.0D else 10.0D + (nth % 3) / 100D end as size", "nth % 7 = 0 as bold",
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Paired values of users: the mean of their even and of their odd events of a kind."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("metric")).agg(
        F.avg(F.expr("case when event_id % 2 = 0 then value end")).alias("baseline"), F.avg(F.expr("case when event_id % 2 = 1 then value end")).alias("candidate")
    )
    return e.where("baseline is not null and candidate is not null").withColumn("diff", F.col("candidate") - F.col("baseline"))


STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def sql_terms(text: str) -> str:
    return f"list_filter({TOKENS.format(text)}, lambda x: x NOT IN {STOP})"


def sql_sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


SQL = {
    "chunks": "SELECT doc_id AS chunk_id, doc_id AS paper_id, lang AS section, source AS venue, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 2016 + doc_id % 11 END AS year, "
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 97 END AS char_start, text FROM documents",
    "requests": "SELECT item_id AS query_id, b.text AS query, embedding::DOUBLE[] AS embedding, CASE WHEN item_id % 3 = 0 THEN 2018 END AS year_min, CASE WHEN item_id % 4 = 0 THEN 2024 END AS year_max, "
    "CASE WHEN item_id % 5 = 0 THEN ['en', 'fr'] END AS sections, CASE WHEN item_id % 7 = 0 THEN 'SRC3' END AS venue_is FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id",
    "vectors": "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "results": "SELECT item_id AS query_id, (item_id * 37 + rank * rank * 11) % (SELECT count(*) FROM documents) AS chunk_id, rank FROM benchmark, (SELECT unnest(range(1, 21)) AS rank)",
    "qrels": "SELECT query_id, chunk_id, max(grade) AS grade FROM (SELECT item_id AS query_id, (item_id * 37 + k * k * 44) % (SELECT count(*) FROM documents) AS chunk_id, ((item_id + k) % 4)::INT AS grade "
    "FROM benchmark, (SELECT unnest(range(1, 13)) AS k)) WHERE query_id % 9 <> 0 GROUP BY 1, 2",
    "verdicts": "SELECT concat('  What does  ', upper(source), ' say ') AS query, doc_id AS chunk_id, (concat('0x', substr(sha256(concat('grade', doc_id)), 1, 8))::BIGINT % 4)::INT AS grade FROM documents",
    "steps": "SELECT concat(user_id, '/', strftime(ts, '%Y-%m-%d')) AS run_id, event_id AS seq, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items())
    + " ELSE 'abstain' END AS route, event_type AS trigger FROM events",
    "drafts": f"SELECT concat(conv_id, '-', turn) AS draft_id, text, {sql_sentences('text')} AS claims FROM conversations WHERE role = 'assistant'",
    "claims": "SELECT *, length(claim) % 2 = 0 AS cited, length(claim) % 3 <> 0 AS supported FROM (SELECT draft_id, text, unnest(range(len(claims))) AS nth, unnest(claims) AS claim FROM drafts)",
    "confidences": "SELECT (doc_id % 101) / 100.0::DOUBLE AS confidence, quality = 1 AS correct FROM labels",
    "blocks": "SELECT doc_id AS paper_id, (nth // 10 + 1)::INT AS page, (nth % 10)::INT AS block, text, CASE WHEN nth % 5 = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE + (nth % 3) / 100.0::DOUBLE END AS size, nth % 7 = 0 AS bold "
    "FROM (SELECT doc_id, unnest(range(len(lines))) AS nth, unnest(lines) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))",
    "runs": "SELECT *, candidate - baseline AS diff FROM (SELECT user_id AS query_id, event_type AS metric, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS baseline, "
    "avg(CASE WHEN event_id % 2 = 1 THEN value END) AS candidate FROM events GROUP BY 1, 2) WHERE baseline IS NOT NULL AND candidate IS NOT NULL",
}


def with_views(*names: str, more: str = "") -> str:
    """WITH clause over the named entities (claims needs drafts before it)."""
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    return "WITH " + ", ".join([*parts, *([more.strip().rstrip(",")] if more else [])]) + " "
