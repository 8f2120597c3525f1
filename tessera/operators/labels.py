"""Evaluation data: constraints on load, promotion of reviewed labels, simulated labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class BadEvalSet(ValueError):
    """An evaluation set that breaks a constraint."""


def constraint_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(rule, violations): repeated ids, labels of unknown queries, repeated labels, queries
    without a positive label, grades out of range."""
    q = queries.select("query_id")
    rules = {
        "duplicate_query": q.groupBy("query_id").count().where("count > 1"),
        "orphan_qrel": qrels.join(q.distinct(), "query_id", "left_anti"),
        "duplicate_qrel": qrels.groupBy("query_id", "chunk_id").count().where("count > 1"),
        "no_positive": q.distinct().join(qrels.where("grade > 0").select("query_id").distinct(), "query_id", "left_anti"),
        "bad_grade": qrels.where("grade is null or grade not between 0 and 3"),
    }
    rows = None
    for name, bad in rules.items():
        part = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def validate(queries: DataFrame, qrels: DataFrame, min_queries: int = 40, require_positive: bool = True) -> None:
    broken = {r.rule: r.violations for r in constraint_counts(queries, qrels).where("violations > 0").collect()}
    if not require_positive:
        broken.pop("no_positive", None)
    n = queries.count()
    if n < min_queries:
        broken["too_few_queries"] = n
    if broken:
        raise BadEvalSet(f"the evaluation set breaks: {broken}")


def promote(pool: DataFrame, frozen: DataFrame) -> DataFrame:
    """Reviewed pool rows (query_id, chunk_id, grade, reviewed, reviewer) against frozen
    labels: new, changed or unchanged. Reviewed rows need a reviewer."""
    done = pool.where("reviewed and reviewer is not null and grade is not null").select("query_id", "chunk_id", "grade")
    old = frozen.select("query_id", "chunk_id", F.col("grade").alias("old_grade"))
    rows = done.join(old, ["query_id", "chunk_id"], "left")
    kind = F.when(F.col("old_grade").isNull(), "new").when(F.col("old_grade") != F.col("grade"), "changed").otherwise("unchanged")
    return rows.withColumn("change", kind)


def merged_labels(frozen: DataFrame, promoted: DataFrame) -> DataFrame:
    both = frozen.select("query_id", "chunk_id", "grade", F.lit(0).alias("age")).unionByName(promoted.select("query_id", "chunk_id", "grade", F.lit(1).alias("age")))
    last = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(F.desc("age")))
    return both.withColumn("nth", last).where("nth = 1").drop("nth", "age")


def highest_grades(labels: DataFrame) -> DataFrame:
    return labels.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))


def pool_grades(pool: DataFrame, broad: int = 8) -> DataFrame:
    """Per query of (query_id, grade): how many of each grade, and a flag."""
    counts = pool.groupBy("query_id").agg(*[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in range(4)])
    flag = F.when(F.col("grade_3") == 0, "NO_GRADE3").when(F.col("grade_3") > broad, "BROAD")
    return counts.withColumn("flag", F.coalesce(flag, F.lit("")))


def simulated(pool: DataFrame, judged: DataFrame) -> DataFrame:
    """Pool rows of (query_id, chunk_id, draft_grade): a query's judged grades dealt, by a
    hash order, to its rows of draft grade 1; the others keep their draft grade."""
    by_hash = lambda *c: W.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", *[F.col(x).cast("string") for x in c])), c[-1])
    slots = pool.where("draft_grade = 1").withColumn("nth", F.row_number().over(by_hash("query_id", "chunk_id"))).select("query_id", "chunk_id", "nth")
    dealt = judged.select("query_id", "chunk_id", "grade").withColumn("nth", F.row_number().over(by_hash("query_id", "chunk_id"))).select("query_id", "grade", "nth")
    given = slots.join(dealt, ["query_id", "nth"]).select("query_id", "chunk_id", "grade")
    return pool.join(given, ["query_id", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", "draft_grade"))


def split_hygiene(queries: DataFrame) -> DataFrame:
    """Query texts that stand in more than one split."""
    from tessera.functions.text import normal_query

    return queries.groupBy(normal_query("query").alias("nq")).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
