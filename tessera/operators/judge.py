"""Verdicts: the deterministic stub judge, the pass rule, panels, triage, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: which violations a rewrite can repair, and which need other evidence
SHALLOW = ("missing_citation", "overstated_certainty", "misattributed_citation")
DEEP = ("unsupported_claim", "inferential_leap", "contradicts_source")
MIN_PRECISION, MIN_COVERAGE = 0.95, 0.80
LABELS = ("sufficient", "partial", "conflicting", "insufficient")


def _seed(prompt: Column) -> Column:
    return F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long")


def stub_grade(prompt: Column) -> Column:
    """The stub's relevance grade: a function of the prompt alone."""
    return (_seed(prompt) % 4).cast("int")


def stub_confidence(prompt: Column) -> Column:
    return F.round(0.5 + (_seed(prompt) % 50) / 100, 2)


def depth(kind: Column) -> Column:
    return F.when(kind.isin(*SHALLOW), "shallow").when(kind.isin(*DEEP), "deep").otherwise("unclassified")


def passes(precision: Column, coverage: Column, deep: Column, major: Column) -> Column:
    """The derived rule: the judge never says itself whether a draft passes."""
    return (deep == 0) & (major == 0) & (precision >= MIN_PRECISION) & (coverage >= MIN_COVERAGE)


def panel(votes: DataFrame) -> DataFrame:
    """Per draft of (draft_id, member, passed, citation_precision, coverage, confidence):
    majority, medians, and the mean confidence scaled by the agreement."""
    yes, n = F.count_if("passed"), F.count("*")
    return votes.groupBy("draft_id").agg(
        (yes * 2 > n).alias("passed"),
        F.percentile("citation_precision", 0.5).alias("citation_precision"),
        F.percentile("coverage", 0.5).alias("coverage"),
        (F.avg("confidence") * F.abs(2 * yes - n) / n).alias("confidence"),
        n.alias("members"),
    )


def panel_violations(violations: DataFrame) -> DataFrame:
    """Union over the members of (draft_id, member, kind, claim, ...): the first of each
    kind and claim."""
    first = F.row_number().over(W.partitionBy("draft_id", "kind", "claim").orderBy("member"))
    return violations.withColumn("nth", first).where("nth = 1").drop("nth")


def claim_grounding(claims: DataFrame, evidence: DataFrame, claim_text: Column | None = None) -> DataFrame:
    """Claims of (draft_id, draft, claim, chunk_id) with two checks: the claim (or
    ``claim_text``) stands in its draft word for word, and the cited chunk is in the draft's
    evidence."""
    known = evidence.select("draft_id", "chunk_id").distinct().withColumn("known", F.lit(True))
    return claims.join(known, ["draft_id", "chunk_id"], "left").select(
        "draft_id", "claim", "chunk_id",
        F.coalesce(F.contains(F.col("draft"), F.col("claim") if claim_text is None else claim_text), F.lit(False)).alias("verbatim"),
        F.coalesce("known", F.lit(False)).alias("cites_evidence"),
    )


def triage(assessments: DataFrame) -> DataFrame:
    """Reconciled label over (n_evidence, label, confidence, failed, conflicts, known): no
    evidence is insufficient; a failed or unknown judgement is partial; conflicts count only
    if all their chunks were retrieved, and then override all but insufficient."""
    valid = F.filter("conflicts", lambda c: F.forall(c["chunk_ids"], lambda x: F.array_contains("known", x)))
    said = F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise("partial")
    label = (
        F.when(F.col("n_evidence") == 0, "insufficient")
        .when(F.col("failed"), "partial")
        .when((F.size(valid) > 0) & (said != "insufficient"), "conflicting")
        .otherwise(said)
    )
    sure = F.when(F.col("n_evidence") == 0, F.lit(1.0)).when(F.col("failed"), F.lit(0.0)).otherwise(F.col("confidence"))
    return assessments.withColumn("conflicts", valid).withColumn("label", label).withColumn("confidence", sure)


def draft_grade(judged: Column, is_target: Column, is_survey: Column, matches_all: Column) -> Column:
    """The judged grade, else 1 for a target paper or a survey that matches all, else 0."""
    return F.coalesce(judged, F.when(is_target | (is_survey & matches_all), 1).otherwise(0))
