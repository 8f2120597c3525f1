"""Agreement between raters and calibration of confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEGENERATE = 0.8
WORSE = "worse than chance"  # as a rule a sign that labels are in another order
BINS = 10
GRID, GRID_MAX = 200, 10.0
KAPPA_FLOOR, MIN_LABELS = 0.5, 30


def confusion(pairs: DataFrame) -> DataFrame:
    """(human, judge, n) of (human, judge)."""
    return pairs.where("human is not null and judge is not null").groupBy("human", "judge").agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row: Cohen's kappa (1 where chance agreement is certain), agreement, expected
    agreement, whether one label dominates the human's, and the usual band."""
    cells = confusion(pairs)
    total = F.broadcast(cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("human") == F.col("judge"), F.col("n")).otherwise(0)).alias("same")))
    rows = cells.groupBy(F.col("human").alias("label")).agg(F.sum("n").alias("h"))
    cols = cells.groupBy(F.col("judge").alias("label")).agg(F.sum("n").alias("j"))
    both = rows.join(cols, "label", "full").na.fill(0, ["h", "j"]).crossJoin(total)
    one = both.groupBy("total", "same").agg(
        (F.sum(F.col("h") * F.col("j")) / F.first(F.col("total") * F.col("total"))).alias("expected"),
        (F.max("h") / F.first("total")).alias("prevalence"),
    )
    one = one.withColumn("observed", F.col("same") / F.col("total"))
    value = F.when(F.col("expected") >= 1, F.lit(1.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    one = one.withColumn("kappa", value)
    band = F.when(F.col("kappa") < 0, WORSE).when(F.col("kappa") < 0.2, "slight").when(F.col("kappa") < 0.4, "fair")
    band = band.when(F.col("kappa") < 0.6, "moderate").when(F.col("kappa") < 0.8, "substantial").otherwise("almost perfect")
    return one.select("total", "observed", "expected", "kappa", (F.col("prevalence") > DEGENERATE).alias("degenerate"), band.alias("band"))


def disagreements(pairs: DataFrame, n: int = 5) -> DataFrame:
    return confusion(pairs).where("human <> judge").orderBy(F.desc("n"), "human", "judge").limit(n)


def tripwire(kappas: DataFrame) -> DataFrame:
    """pass, fail, or refused where there are too few labels."""
    verdict = F.when(F.col("total") < MIN_LABELS, "refused").when(F.col("kappa") >= KAPPA_FLOOR, "pass").otherwise("fail")
    return kappas.withColumn("verdict", verdict)


def krippendorff(ratings: DataFrame) -> DataFrame:
    """One row over (item, annotator, rating): nominal alpha of items with two or more
    ratings; gaps are allowed."""
    counts = ratings.where("rating is not null").groupBy("item", "rating").agg(F.count("*").alias("c"))
    units = counts.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).where("m >= 2")
    totals = units.agg(F.sum("m").alias("n"), F.sum(F.col("agree") / (F.col("m") - 1)).alias("agree"))
    usable = counts.join(units.select("item"), "item", "left_semi").groupBy("rating").agg(F.sum("c").alias("nc"))
    chance = usable.agg(F.sum(F.col("nc") * (F.col("nc") - 1)).alias("pairs"))
    observed, expected = F.col("agree") / F.col("n"), F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    alpha = F.when(expected >= 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))
    return totals.crossJoin(F.broadcast(chance)).select("n", observed.alias("observed"), expected.alias("expected"), alpha.alias("alpha"))


def temperature(rows: DataFrame) -> DataFrame:
    """One row over (confidence, correct): the temperature of a fixed grid with the least
    mean negative log likelihood (the first of a tie). Equal rows are counted once."""
    counted = rows.groupBy("confidence", "correct").agg(F.count("*").alias("n"))
    c = F.greatest(F.least(F.col("confidence"), F.lit(1 - 1e-6)), F.lit(1e-6))
    logit = counted.select("correct", "n", F.log(c / (1 - c)).alias("logit"))
    grid = rows.sparkSession.range(1, GRID + 1).select((F.col("id") * GRID_MAX / GRID).alias("t"))
    p = 1 / (1 + F.exp(-F.col("logit") / F.col("t")))
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = F.when(F.col("correct"), -F.log(p)).otherwise(-F.log(1 - p))
    sums = logit.crossJoin(F.broadcast(grid)).groupBy("t").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"))
    return sums.orderBy(F.round("nll", 12), "t").limit(1)


def calibrated(confidence, t: float):
    c = F.greatest(F.least(confidence, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-F.log(c / (1 - c)) / t))


def reliability(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, lo, hi, n, mean_confidence, accuracy) for equal bins [lo, hi), the last closed;
    empty bins are reported as zeros."""
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    inside = (F.col("confidence") >= F.col("lo")) & ((F.col("confidence") < F.col("hi")) | ((F.col("bin") == bins - 1) & (F.col("confidence") <= 1)))
    counted = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    filled = counted.join(F.broadcast(spine), inside).groupBy("bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("mean_confidence"), (F.sum("right") / F.sum("n")).alias("accuracy")
    )
    return spine.join(filled, "bin", "left").na.fill(0, ["n", "mean_confidence", "accuracy"])


def calibration_error(bins: DataFrame) -> DataFrame:
    weight = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg(F.coalesce(F.try_divide(F.sum(weight), F.sum("n")), F.lit(0.0)).alias("ece"), F.sum("n").alias("n"))


def escalation_threshold(rows: DataFrame, target: float = 0.9) -> DataFrame:
    """One row over (confidence, correct): the smallest confidence, rounded half to even to
    two places, from which on the accepted precision reaches the target; NULL if none does."""
    counted = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    thresholds = counted.select(F.bround("confidence", 2).alias("threshold")).distinct()  # at most 101
    accepted = counted.join(F.broadcast(thresholds), F.col("confidence") >= F.col("threshold")).groupBy("threshold").agg(
        (F.sum("right") / F.sum("n")).alias("precision")
    )
    return accepted.agg(F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def stability(repeats: DataFrame) -> DataFrame:
    """Per item of (item, label): whether repeated judgements gave one label."""
    return repeats.groupBy("item").agg((F.count_distinct("label") == 1).alias("stable"), F.count("*").alias("n"))
