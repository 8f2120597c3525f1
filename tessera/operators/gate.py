"""The promotion gate: paired runs, bootstrap, step-down correction, thresholds.

Runs are long tables (run, query_id, metric, value).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import detectable_effect, required_queries_column
from tessera.session import materialize, ship

RESAMPLES, CONFIDENCE, ALPHA = 1000, 0.95, 0.05
MIN_EFFECT = 0.04
PRIME = (1 << 31) - 1
DRAWS = 512  # draws of every resample that are one block of work
GATHERED = 1 << 21  # differences that a task may hold
STAMPS = ("corpus_version", "embedding_model", "reranker_version")


class GateRefusal(RuntimeError):
    """The runs cannot be compared; not the same as a negative verdict."""


def aligned(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(query_id, metric, baseline, candidate, diff) where both runs have a value. Runs over
    different queries are refused with the first five of each side."""
    both = baseline.select("query_id", "metric", F.col("value").alias("baseline"), F.lit(1).alias("in_b")).join(
        candidate.select("query_id", "metric", F.col("value").alias("candidate"), F.lit(1).alias("in_c")), ["query_id", "metric"], "full"
    )
    alone = both.where("in_b is null or in_c is null").select("query_id", "in_b").distinct().orderBy("query_id").limit(10).collect()
    if alone:
        raise GateRefusal(f"queries of one run only: {[(r.query_id, 'candidate' if r.in_b is None else 'baseline') for r in alone][:5]}")
    rows = both.where("baseline is not null and candidate is not null")
    return rows.select("query_id", "metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("diff"))


def check_stamps(baseline: dict, candidate: dict) -> None:
    for s in STAMPS:
        if baseline.get(s) != candidate.get(s):
            raise GateRefusal(f"{s} differs: {baseline.get(s)!r} and {candidate.get(s)!r}")


def shared_metrics(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select("metric").intersect(candidate.select("metric"))


def _coefficients(seed: int, metric: str, resamples: int):
    """Four numbers below ``PRIME`` for each resample: a row each."""
    import hashlib

    import numpy as np

    made = [hashlib.md5(f"{seed}:{metric}:{r}".encode()).hexdigest() for r in range(resamples)]
    return np.array([[int(h[k : k + 8], 16) % PRIME for h in made] for k in (0, 8, 16, 24)], np.int64).T


def _drawn(c: list, i, n):
    """The slot that draw i of a resample takes: a cubic of i modulo a prime, modulo n. Any four
    draws of a resample are independent, so its mean has the variance and the fourth moment
    of free draws. The same on columns and on arrays."""
    return (((c[0] * i + c[1]) % PRIME * i + c[2]) % PRIME * i + c[3]) % PRIME % n


def _resampled_sums(diffs: dict, seed: int, resamples: int):
    """For rows (metric, block): the sum of each resample's draws of this block, as a vector."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        made: dict[str, object] = {}
        for batch in batches:
            for metric, block in zip(batch.column("metric").to_pylist(), batch.column("block").to_pylist()):
                own = diffs[metric]
                if metric not in made:
                    made[metric] = _coefficients(seed, metric, resamples)
                i = np.arange(block * DRAWS, min((block + 1) * DRAWS, len(own)), dtype=np.int64)
                sums = own[_drawn(list(made[metric].T[:, :, None]), i, len(own))].sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([metric]), pa.array([sums])], names=["metric", "sums"])

    return run


def paired_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0, most: int = GATHERED) -> DataFrame:
    """Per metric: means, observed difference, percentile interval, two-sided p.

    A resample draws n rows with replacement; which one its draw i takes is computed from
    (seed, metric, resample, i), so the result is the same on any cluster. Up to ``most``
    differences in all are arrays that tasks hold: a task takes a block of draws, looks its rows up and
    adds them up to one vector with a number for each resample; vectors are summed. Beyond
    that, draws are joined to rows by their number.
    """
    order = W.partitionBy("metric").orderBy("query_id")
    rows = materialize(pairs.withColumn("slot", F.row_number().over(order) - 1).select("metric", "slot", "baseline", "candidate", "diff"), "paired-rows")
    size = rows.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg("diff").alias("observed_diff")
    )
    if rows.count() <= most:
        ship(pairs.sparkSession)
        table = rows.select("metric", "slot", "diff").orderBy("metric", "slot").toArrow()
        names, values = table.column("metric").to_pylist(), table.column("diff").to_numpy()
        starts = {m: k for k, m in reversed(list(enumerate(names)))}
        diffs = {m: values[at : at + names.count(m)] for m, at in starts.items()}
        blocks = size.select("metric", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / DRAWS).cast("int"))).alias("block")).repartition("metric", "block")
        sums = blocks.mapInArrow(_resampled_sums(diffs, seed, resamples), "metric string, sums array<double>")
        summed = sums.select("metric", F.posexplode("sums").alias("resample", "part")).groupBy("metric", "resample").agg(F.sum("part").alias("total"))
        means = summed.join(size.select("metric", "n"), "metric").select("metric", "resample", (F.col("total") / F.col("n")).alias("mean"))
    else:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), "metric", F.col("resample").cast("string")))
        c = [F.conv(F.substring(key, k, 8), 16, 10).cast("long") % PRIME for k in (1, 9, 17, 25)]
        draws = size.select("metric", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select("metric", "n", "resample", F.array(*c).alias("c"))
        draws = draws.select("metric", "n", "resample", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
        draws = draws.select("metric", "resample", _drawn([F.col("c")[k] for k in range(4)], F.col("i"), F.col("n")).alias("slot"))
        means = draws.join(rows.select("metric", F.col("slot").cast("long").alias("slot"), "diff"), ["metric", "slot"]).groupBy("metric", "resample").agg(F.avg("diff").alias("mean"))
    tail = (1 - confidence) / 2
    index = lambda q: max(0, min(resamples - 1, round(q * (resamples - 1)))) + 1  # noqa: E731  half to even
    placed = means.withColumn("nth", F.row_number().over(W.partitionBy("metric").orderBy("mean")))
    bounds = placed.groupBy("metric").agg(
        F.max(F.when(F.col("nth") == index(tail), F.col("mean"))).alias("ci_low"),
        F.max(F.when(F.col("nth") == index(1 - tail), F.col("mean"))).alias("ci_high"),
        (F.count_if(F.col("mean") <= 0) / resamples).alias("below"),
        (F.count_if(F.col("mean") >= 0) / resamples).alias("above"),
    )
    p = F.least(F.lit(1.0), F.greatest(2 * F.least("below", "above"), F.lit(1.0 / resamples)))
    return size.join(bounds, "metric").select("metric", "n", "baseline_mean", "candidate_mean", "observed_diff", "ci_low", "ci_high", p.alias("p_value"))


def paired_bootstrap_exact(pairs: DataFrame, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """The same with Python's seeded random stream, for comparison with results that were
    made with it. One metric's differences have to fit into one task."""
    import pandas as pd

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        import random
        from statistics import fmean

        diffs = frame.sort_values("query_id")["diff"].tolist()
        rng = random.Random(seed)
        means = sorted(fmean([diffs[rng.randrange(len(diffs))] for _ in diffs]) for _ in range(resamples))
        at = lambda q: means[max(0, min(resamples - 1, round(q * (resamples - 1))))]
        tail = (1 - confidence) / 2
        below, above = (sum(m <= 0 for m in means) / resamples, sum(m >= 0 for m in means) / resamples)
        p = min(1.0, max(2 * min(below, above), 1 / resamples))
        return pd.DataFrame([[frame["metric"].iloc[0], len(diffs), fmean(diffs), at(tail), at(1 - tail), p]], columns=["metric", "n", "observed_diff", "ci_low", "ci_high", "p_value"])

    return pairs.select("metric", "query_id", "diff").groupBy("metric").applyInPandas(one, "metric string, n long, observed_diff double, ci_low double, ci_high double, p_value double")


def holm(results: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds rank (by p, then metric) and significant: p within alpha / (m - rank + 1) for
    this and every smaller p. The family is the metrics of one comparison."""
    order = W.orderBy("p_value", "metric")
    one = results.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy()))
    one = one.withColumn("within", F.col("p_value") <= alpha / (F.col("m") - F.col("rank") + 1))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    return one.withColumn("significant", F.bool_and("within").over(running)).drop("within", "m")


def widened(results: DataFrame) -> DataFrame:
    """Intervals of metrics that the correction rejects are widened to include 0."""
    keep = F.col("significant")
    return results.withColumn("ci_low", F.when(keep, F.col("ci_low")).otherwise(F.least("ci_low", F.lit(0.0)))).withColumn(
        "ci_high", F.when(keep, F.col("ci_high")).otherwise(F.greatest("ci_high", F.lit(0.0)))
    )


def decide(results: DataFrame, min_effect: float = MIN_EFFECT) -> DataFrame:
    """One row (promote, reason): any significant regression rejects; promotion needs an
    interval without 0 whose lower end reaches ``min_effect``."""
    significant = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    worse = F.when(significant & (F.col("observed_diff") < 0), F.col("metric"))
    better = F.when((F.col("ci_low") > 0) & (F.col("ci_low") >= min_effect), F.col("metric"))
    one = results.agg(
        F.array_join(F.array_sort(F.collect_list(worse)), ", ").alias("worse"),  # one entry a metric
        F.array_join(F.array_sort(F.collect_list(better)), ", ").alias("better"),
        F.max_by("metric", F.struct("observed_diff", "metric")).alias("best"),
        F.count("*").alias("n_metrics"),
    )
    reason = (
        F.when(F.col("n_metrics") == 0, "no metrics compared")
        .when(F.col("worse") != "", F.concat(F.lit("significant regression in "), "worse"))
        .when(F.col("better") != "", F.concat(F.lit("significant improvement in "), "better"))
        .otherwise(F.concat(F.lit("no metric improved enough; best: "), "best"))
    )
    return one.select(((F.col("n_metrics") > 0) & (F.col("worse") == "") & (F.col("better") != "")).alias("promote"), reason.alias("reason"))


def compare(baseline: DataFrame, candidate: DataFrame, min_queries: int = 50, **options) -> DataFrame:
    """The whole gate: same queries, enough of them, bootstrap, correction, verdict."""
    pairs = aligned(baseline, candidate)
    n = pairs.select("query_id").distinct().count()
    if n < min_queries:
        raise GateRefusal(f"{n} queries, at least {min_queries} are needed")
    return decide(widened(holm(paired_bootstrap(pairs, **options))))


def sensitivity(pairs: DataFrame, effect: float = MIN_EFFECT) -> DataFrame:
    """Per metric: n, deviation of the differences, detectable effect, queries needed."""
    one = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.stddev_samp("diff").alias("sd"))
    return one.select(
        "metric", "n", "sd", detectable_effect(F.col("sd"), F.col("n")).alias("detectable"),
        required_queries_column(F.col("sd"), F.lit(effect)).alias("needed"), (F.col("sd") == 0).alias("identical"),
    )


def threshold_compare(values: DataFrame, thresholds: DataFrame, champion: DataFrame) -> DataFrame:
    """Per metric of thresholds (metric, floor, tolerance): value, shortfall, delta, excess,
    reasons, passed. A metric without a tolerance is held to its floor only; a missing or
    NaN value fails."""
    v = values.select("metric", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    rows = thresholds.join(v, "metric", "left").join(champion.select("metric", F.col("value").alias("champion")), "metric", "left")
    short = F.greatest(F.lit(0.0), F.col("floor") - F.col("value"))
    delta = F.col("value") - F.col("champion")
    excess = F.when(F.col("tolerance").isNotNull(), F.greatest(F.lit(0.0), -delta - F.col("tolerance")))
    rows = rows.select("metric", "value", "floor", "tolerance", "champion", short.alias("shortfall"), delta.alias("delta"), excess.alias("excess"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("value").isNull(), "missing"),
            F.when(F.col("shortfall") > 0, "below floor"),
            F.when(F.col("excess") > 0, "regressed"),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def threshold_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
