"""Retrieval and generation metrics over tables of results, labels and runs.

Undefined values differ by family, on purpose: retrieval metrics are NULL where a query
cannot be scored, attribution is 0, context recall is 1.

results: (query_id, chunk_id, rank); qrels: (query_id, chunk_id, grade); queries: (query_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, CANDIDATE_K, GOOD = 5, 20, 2
NDCG_FLOOR = 0.4


def metric_names(k: int = K, candidate_k: int = CANDIDATE_K) -> dict[str, str]:
    return {"ndcg": f"ndcg_at_{k}", "mrr": "mrr", "recall": f"recall_at_{candidate_k}", "citation_precision": "retrieval_citation_precision"}


def _gain(grade: str, rank: str):
    return (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(rank) + 1)


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with grades; unlisted chunks have grade 0."""
    return results.join(qrels, ["query_id", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ideal_gains(qrels: DataFrame, k: int = K) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")
    best = qrels.where("grade > 0").withColumn("best", F.row_number().over(order)).where(F.col("best") <= k)
    return best.groupBy("query_id").agg(F.sum(_gain("grade", "best")).alias("ideal"))


def search_results(found: DataFrame) -> DataFrame:
    """What a search returns as (query_id, chunk_id, rank). Accepted are rows with a rank,
    rows with a score, and a row a query with a list of chunk ids in order; a chunk that is
    listed again keeps its first place."""
    if "chunk_ids" in found.columns:
        rows = found.select("query_id", F.posexplode("chunk_ids").alias("rank", "chunk_id"))
    elif "rank" in found.columns:
        rows = found.select("query_id", "chunk_id", "rank")
    elif "score" in found.columns:
        order = W.partitionBy("query_id").orderBy(F.round("score", 10).desc(), "chunk_id")
        rows = found.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))
    else:
        raise ValueError(f"a search returns a rank, a score or chunk_ids, not {found.columns}")
    once = rows.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "chunk_id"))
    return once.select("query_id", "chunk_id", place.alias("rank"))


def evaluate_search(search, queries: DataFrame, qrels: DataFrame, k: int = K, candidate_k: int = CANDIDATE_K) -> DataFrame:
    """Metrics of each query for a search: a function of the queries that returns any shape
    that :func:`search_results` accepts."""
    return per_query(queries, search_results(search(queries)), qrels, k, candidate_k)


def per_query(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = K, candidate_k: int = CANDIDATE_K, good: int = GOOD) -> DataFrame:
    """All retrieval metrics of every query, one aggregation over the judged results."""
    names = metric_names(k, candidate_k)
    hit = F.col("grade") >= good
    scored = judged(results, qrels).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, _gain("grade", "rank"))).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first_good"),
        F.count_distinct(F.when(hit & (F.col("rank") <= candidate_k), F.col("chunk_id"))).alias("found"),
        F.count_if(hit & (F.col("rank") <= k)).alias("cited_good"),
        F.count_if(F.col("rank") <= k).alias("cited"),
    )
    wanted = qrels.where(F.col("grade") >= good).groupBy("query_id").agg(F.count_distinct("chunk_id").alias("wanted"))
    rows = queries.select("query_id").join(scored, "query_id", "left").join(ideal_gains(qrels, k), "query_id", "left").join(wanted, "query_id", "left")
    any_good = F.col("wanted") > 0
    return rows.select(
        "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias(names["ndcg"]),
        F.when(any_good, F.coalesce(1 / F.col("first_good"), F.lit(0.0))).alias(names["mrr"]),
        F.when(any_good, F.coalesce("found", F.lit(0)) / F.col("wanted")).alias(names["recall"]),
        F.when(any_good, F.coalesce(F.try_divide("cited_good", "cited"), F.lit(0.0))).alias(names["citation_precision"]),
    )


def summary(per: DataFrame) -> DataFrame:
    """(metric, mean, n, n_queries): means over the queries that the metric can score."""
    metrics = [c for c in per.columns if c != "query_id"]
    one = per.agg(F.count("*").alias("n_queries"), *[F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in metrics])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c)["mean"].alias("mean"), F.col(c)["n"].alias("n")) for c in metrics]))
    return one.select("n_queries", pairs.alias("m")).select("m.metric", "m.mean", "m.n", "n_queries")


def failure_breakdown(per: DataFrame, floor: float = NDCG_FLOOR, k: int = K, candidate_k: int = CANDIDATE_K) -> DataFrame:
    """(failure, n): never found, found but ranked too low, not scoreable, fine."""
    names = metric_names(k, candidate_k)
    recall, ndcg = F.col(names["recall"]), F.col(names["ndcg"])
    kind = F.when(recall.isNull(), "unscored").when(recall == 0, "recall").when(ndcg < floor, "ranking").otherwise("none")
    return per.withColumn("failure", kind).groupBy("failure").agg(F.count("*").alias("n"))


def by_group(per: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    metrics = [c for c in per.columns if c != "query_id"]
    return per.join(groups, "query_id").groupBy(group).agg(*[F.avg(c).alias(c) for c in metrics], F.count("*").alias("n"))


def context_recall(results: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of the relevant chunks (grade above 0) that were retrieved; 1 where none is."""
    relevant = qrels.where("grade > 0").select("query_id", "chunk_id").distinct()
    found = relevant.join(results.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    shares = found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("r"))
    return queries.select("query_id").join(shares, "query_id", "left").select("query_id", F.coalesce("r", F.lit(1.0)).alias("context_recall"))


def claim_attribution(claims: DataFrame) -> DataFrame:
    """Per draft of (draft_id, cited, supported): precision of the cited claims and coverage
    of all claims; 0 where there are none."""
    good = F.count_if(F.col("cited") & F.col("supported"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return claims.groupBy("draft_id").agg(
        zero(F.try_divide(good, F.count_if("cited"))).alias("claim_citation_precision"),
        zero(F.try_divide(F.count_if("cited"), F.count("*"))).alias("coverage"),
        F.count("*").alias("n_claims"),
    )


def answer_relevance(grades: DataFrame) -> DataFrame:
    return grades.agg(F.coalesce(F.avg("grade") / 3, F.lit(0.0)).alias("answer_relevance"))


def abstention(outcomes: DataFrame) -> DataFrame:
    """One row over (answerable, abstained): the four cells and their rates (undefined: 0)."""
    cells = outcomes.agg(
        F.count_if(~F.col("answerable") & F.col("abstained")).alias("right_abstentions"),
        F.count_if(~F.col("answerable") & ~F.col("abstained")).alias("missed_abstentions"),
        F.count_if(F.col("answerable") & F.col("abstained")).alias("over_abstentions"),
        F.count_if(F.col("answerable") & ~F.col("abstained")).alias("answered"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return cells.select(
        "*",
        rate("right_abstentions", "missed_abstentions").alias("recall"),
        rate("right_abstentions", "over_abstentions").alias("precision"),
        rate("over_abstentions", "answered").alias("over_abstention_rate"),
    )


def claim_granularity(drafts: DataFrame) -> DataFrame:
    """Per draft of (draft_id, text, claims): claims a sentence (of at least one) and mean
    words a claim."""
    from tessera.functions.text import sentences, words

    n_sentences = F.greatest(F.size(sentences("text")), F.lit(1))
    n_words = F.aggregate(F.transform("claims", lambda c: F.size(words(c))), F.lit(0), lambda a, x: a + x)
    return drafts.select(
        "draft_id",
        (F.size("claims") / n_sentences).alias("claims_per_sentence"),
        F.coalesce(F.try_divide(n_words, F.size("claims")), F.lit(0.0)).alias("words_per_claim"),
    )


def best_level(scores: DataFrame) -> DataFrame:
    """Of (level, score): the level with the best mean; the first in order of a tie. Levels
    must have as many scores each."""
    sizes = [r.n for r in scores.groupBy("level").agg(F.count("*").alias("n")).select("n").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"levels have different numbers of scores: {sorted(sizes)}")
    means = scores.groupBy("level").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return means.orderBy(F.desc("mean"), "level").limit(1)


def trajectory_metrics(steps: DataFrame) -> DataFrame:
    """One row over (run_id, step, route): means, first-pass accepts, escalations."""
    redo = F.col("route").isin("rewrite", "re_retrieve")
    runs = steps.groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("route") == "rewrite").alias("rewrites"),
        F.count_if(F.col("route") == "re_retrieve").alias("re_retrievals"),
        F.count_if(F.col("route") == "escalate").alias("escalations"),
        F.count_if(F.col("route") == "abstain").alias("abstentions"),
        F.max_by("route", "step").alias("last"),
        F.count_if(redo).alias("redone"),
    )
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.avg("steps").alias("mean_steps"),
        F.avg("rewrites").alias("mean_rewrites"),
        F.avg("re_retrievals").alias("mean_re_retrievals"),
        (F.count_if((F.col("last") == "accept") & (F.col("redone") == 0)) / F.count("*")).alias("first_pass_accept_rate"),
        (F.sum("escalations") / F.count("*")).alias("escalation_rate"),
        (F.sum("abstentions") / F.count("*")).alias("abstention_rate"),
    )


def trigger_rates(steps: DataFrame) -> DataFrame:
    runs = steps.agg(F.count_distinct("run_id").alias("n_runs"))
    return steps.groupBy("trigger").agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs)).select("trigger", (F.col("n") / F.col("n_runs")).alias("per_run"))


def retrieval_gain(rounds: DataFrame) -> DataFrame:
    """Change of value from one round of a query to the next."""
    w = W.partitionBy("query_id").orderBy("round")
    return rounds.withColumn("gain", F.col("value") - F.lag("value").over(w))


def span_percentiles(spans: DataFrame) -> DataFrame:
    return spans.groupBy("kind").agg(
        *[F.percentile("ms", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.count("*").alias("n")
    )
