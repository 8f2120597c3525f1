"""Preference pairs from graded verdicts, and the guard against evaluation leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import hash_slot, normal_query

GAP, CAP = 1, 4
USEFUL_PAIRS = 200


class EvalLeakage(RuntimeError):
    """Training data has evaluation queries."""


def leaked(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Normalised training queries that are evaluation queries."""
    t = training.select(normal_query("query").alias("nq")).distinct()
    return t.join(evaluation.select(normal_query("query").alias("nq")).distinct(), "nq", "left_semi")


def assert_no_leakage(training: DataFrame, evaluation: DataFrame) -> None:
    found = leaked(training, evaluation)
    n = found.count()
    if n:
        shown = [r.nq for r in found.orderBy("nq").limit(5).collect()]
        raise EvalLeakage(f"{n} evaluation queries in the training data, such as {shown}")


def ordered_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts with the normalised query and their position in (grade desc, chunk_id)."""
    one = verdicts.withColumn("nq", normal_query("query")).dropDuplicates(["nq", "chunk_id", "grade"])
    order = W.partitionBy("nq").orderBy(F.desc("grade"), "chunk_id")
    return one.withColumn("pos", F.row_number().over(order))


def candidate_pairs(verdicts: DataFrame, gap: int = GAP, cap: int | None = None) -> DataFrame:
    """(nq, chosen, rejected, margin, pos_a, pos_b): a chunk against each later one of its
    query that is graded at least ``gap`` lower.

    With a cap only chosen chunks that can have a pair below it are joined: a chunk has at
    most one row for each of the four grades, and if one has no pair, no later one has.
    """
    v = ordered_verdicts(verdicts).select("nq", "chunk_id", "grade", "pos")
    a = v.select("nq", F.col("chunk_id").alias("chosen"), F.col("grade").alias("ga"), F.col("pos").alias("pos_a"))
    if cap is not None:
        a = a.where(F.col("pos_a") <= 4 * cap)
    b = v.select("nq", F.col("chunk_id").alias("rejected"), F.col("grade").alias("gb"), F.col("pos").alias("pos_b"))
    far = a.join(b, "nq").where((F.col("pos_a") < F.col("pos_b")) & (F.col("ga") - F.col("gb") >= gap) & (F.col("chosen") != F.col("rejected")))
    return far.select("nq", "chosen", "rejected", (F.col("ga") - F.col("gb")).alias("margin"), "pos_a", "pos_b")


def preference_pairs(verdicts: DataFrame, chunks: DataFrame | None = None, gap: int = GAP, cap: int = CAP) -> DataFrame:
    """The first ``cap`` pairs of each query in order of position. Given ``chunks``, verdicts
    on chunks that have none of them go first, so a missing text costs no place."""
    if chunks is not None:
        verdicts = verdicts.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    pairs = candidate_pairs(verdicts, gap, cap)
    once = F.row_number().over(W.partitionBy("nq", "chosen", "rejected").orderBy("pos_a", "pos_b"))
    pairs = pairs.withColumn("nth", once).where("nth = 1").drop("nth")
    order = W.partitionBy("nq").orderBy("pos_a", "pos_b")
    pairs = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)
    if chunks is not None:
        text = chunks.select("chunk_id", "text")
        pairs = pairs.join(text.toDF("chosen", "chosen_text"), "chosen").join(text.toDF("rejected", "rejected_text"), "rejected")
    return pairs


def yield_sweep(verdicts: DataFrame, gaps: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(gap, pairs, queries, share_of_first): what each gap leaves after the cap."""
    rows = None
    for g in gaps:
        part = preference_pairs(verdicts, gap=g, cap=cap).agg(F.count("*").alias("pairs"), F.count_distinct("nq").alias("queries")).withColumn("gap", F.lit(g))
        rows = part if rows is None else rows.unionByName(part)
    base = F.broadcast(rows.where(F.col("gap") == gaps[0]).select(F.col("pairs").alias("base")))  # one row
    return rows.crossJoin(base).select("gap", "pairs", "queries", F.coalesce(F.try_divide("pairs", "base"), F.lit(0.0)).alias("share_of_first"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("margin").agg(F.count("*").alias("pairs"), F.count_distinct("nq").alias("queries"))


def train_split(rows: DataFrame, key: str, seed: int = 0, share: float = 0.1, buckets: int = 1024) -> DataFrame:
    """Rows with ``held_out``: the first max(1, n * share) in a seeded hash order (none of a
    single row). Only the bucket that the boundary falls into is ranked."""
    keyed = rows.withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    keyed = keyed.withColumn("bucket", hash_slot(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 1 << 32) * buckets / (1 << 32))
    keyed = keyed.withColumn("bucket", F.floor("bucket").cast("int"))  # the leading bits of order_key
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))  # at most ``buckets`` rows
    sizes = sizes.selectExpr("bucket", "sum(n) over (order by bucket) - n as before", "sum(n) over () as total")
    nth = F.col("before") + F.row_number().over(W.partitionBy("bucket").orderBy("order_key", key))
    want = F.when(F.col("total") <= 1, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("total") * share)))
    return keyed.join(F.broadcast(sizes), "bucket").withColumn("held_out", nth <= want).drop("order_key", "bucket", "before", "total")
