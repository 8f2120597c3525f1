"""The agent loop over a batch of questions: all runs step together until each has ended.

A run researches, has its evidence judged, writes, has its draft judged, and goes round
until it is accepted, abstains or is escalated. Each round takes one decision of every
live run, by the same policy columns as :mod:`policy`, and is a written table: what has ended leaves, the rest
goes on. A run takes at most ``MAX_STEPS`` decisions before the policy escalates it, so the
number of rounds has a bound that does not depend on the batch; a run that is still
live then is escalated by the loop itself.

What nodes do is given by functions over tables: ``search`` gets the live runs that
research and returns their evidence, ``verdicts`` adds the judges' replies to live runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import policy
from tessera.session import materialize

#: what the policy reads of the judges' replies; a reply that failed has ``failed``
REPLIES = ("label", "confidence", "failed", "kinds", "passed", "faithfulness_confidence", "relevance", "answer_confidence", "evidence_sufficient")
DECISION = "array<struct<step:int,node:string,route:string,trigger:string>>"


def begin(questions: DataFrame) -> DataFrame:
    """Runs of (run_id, question), each once, before their first step."""
    one = questions.groupBy("run_id").agg(F.min("question").alias("question"))
    zero = lambda name: F.lit(0).alias(name)
    return one.select(
        "run_id", "question", F.lit("triage").alias("node"), F.lit(True).alias("researches"), zero("rounds"), F.lit(0).cast("long").alias("n_evidence"),
        zero("steps_used"), zero("rewrites_used"), zero("re_retrievals_used"), zero("discoveries_used"), F.lit(0.0).alias("cost_spent"), zero("drafts"),
        F.lit(None).cast("string").alias("outcome"), F.array().cast(DECISION).alias("trajectory"),
    )


def reformulated(question: Column, rounds: Column) -> Column:
    """The query of a round: the question itself, then the question aimed elsewhere. (A model
    would write it; this stands in, and never repeats a query.)"""
    return F.when(rounds == 0, question).otherwise(F.concat(question, F.lit(" #"), rounds.cast("string")))


def _decision(min_confidence: float, max_discoveries: int) -> Column:
    """struct(route, trigger) of a live run; a failed reply of a judge is never guessed at."""
    lost = F.struct(F.lit("escalate").alias("route"), F.lit("unexplained_failure").alias("trigger"))
    evidence = policy.decide_evidence(min_confidence, max_discoveries)
    draft = F.when(F.col("failed"), lost).otherwise(policy.decide_route(min_confidence, min_confidence))
    return F.when(F.col("node") == "triage", evidence).otherwise(draft)


def _reconciled(judged: DataFrame) -> DataFrame:
    """No evidence is insufficient for sure; a failed triage is partial and unsure."""
    none, failed = F.col("n_evidence") == 0, F.coalesce(F.col("failed"), F.lit(False))
    return judged.withColumns({
        "failed": failed,
        "label": F.when(none, "insufficient").when(failed, "partial").otherwise(F.col("label")),
        "confidence": F.when(none, F.lit(1.0)).when(failed, F.lit(0.0)).otherwise(F.col("confidence")),
    })


def step(live: DataFrame, verdicts: Callable[[DataFrame], DataFrame], min_confidence: float, max_discoveries: int) -> DataFrame:
    """Live runs after one decision each."""
    judged = _reconciled(verdicts(live)).withColumn("d", _decision(min_confidence, max_discoveries))
    route, c = F.col("d.route"), F.col
    spent = lambda name, of: (c(name) + F.when(route == of, 1).otherwise(0)).alias(name)
    writes = route.isin("write", "rewrite")
    entry = F.array(F.struct(c("steps_used").alias("step"), c("node").alias("node"), route.alias("route"), c("d.trigger").alias("trigger")))
    return judged.select(
        "run_id", "question",
        F.when(writes, "editor").otherwise("triage").alias("node"), route.isin("re_retrieve", "discover").alias("researches"), "rounds", "n_evidence",
        (c("steps_used") + 1).alias("steps_used"), spent("rewrites_used", "rewrite"), spent("re_retrievals_used", "re_retrieve"), spent("discoveries_used", "discover"),
        (c("cost_spent") + policy.route_cost(route)).alias("cost_spent"), (c("drafts") + writes.cast("int")).alias("drafts"),
        policy.outcome(route).alias("outcome"), F.concat("trajectory", entry).alias("trajectory"),
    )


def run(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], verdicts: Callable[[DataFrame], DataFrame],
    min_confidence: float = 0.0, max_discoveries: int = policy.MAX_DISCOVERIES,
) -> tuple[DataFrame, DataFrame]:
    """(runs at their end, evidence of all rounds).

    ``search``: (run_id, round, query) -> (run_id, chunk_id, rank). ``verdicts``: live runs ->
    the same rows with ``REPLIES``. Evidence of a run counts once, in its first round.
    """
    live = materialize(begin(questions), "loop-runs")
    ended, evidence = [], None
    for _ in range(policy.MAX_STEPS + 1):
        if live.isEmpty():
            break
        asks = live.where("researches").select("run_id", F.col("rounds").alias("round"), reformulated(F.col("question"), F.col("rounds")).alias("query"))
        found = search(asks).select("run_id", "chunk_id", "rank").join(asks.select("run_id", "round"), "run_id")
        found = found.groupBy("run_id", "round", "chunk_id").agg(F.min("rank").alias("rank"))
        if evidence is not None:
            found = found.join(evidence.select("run_id", "chunk_id"), ["run_id", "chunk_id"], "left_anti").select(*evidence.columns)
        new = materialize(found, "loop-evidence")
        evidence = new if evidence is None else evidence.unionByName(new)
        counts = new.groupBy("run_id").agg(F.count("*").alias("more"))
        live = live.join(counts, "run_id", "left").withColumns({"n_evidence": F.col("n_evidence") + F.coalesce("more", F.lit(0)), "rounds": F.col("rounds") + F.col("researches").cast("int")}).drop("more")
        after = materialize(step(live, verdicts, min_confidence, max_discoveries), "loop-runs")
        ended.append(after.where("outcome is not null"))
        live = after.where("outcome is null")
    stop = F.array(F.struct(F.col("steps_used").alias("step"), F.lit("loop").alias("node"), F.lit("escalate").alias("route"), F.lit("step_budget_exhausted").alias("trigger")))
    ended.append(live.withColumns({"outcome": F.lit("escalated"), "trajectory": F.concat("trajectory", stop)}))
    return reduce(DataFrame.unionByName, ended), evidence


def handovers(runs: DataFrame, evidence: DataFrame, next_steps: dict[str, str]) -> DataFrame:
    """What a person is given of runs that escalated or abstained."""
    last = F.element_at("trajectory", -1)
    ids = evidence.groupBy("run_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("evidence_ids"))  # a run's rounds times its top
    steps = F.transform("trajectory", lambda t: F.concat_ws(". ", t["step"].cast("string"), F.concat_ws(" ", t["route"], t["trigger"])))
    return runs.where("outcome <> 'accepted'").join(ids, "run_id", "left").select(
        "run_id", "question", "outcome", last["trigger"].alias("trigger"),
        policy.lookup(next_steps, last["trigger"], "Unrecognised trigger: read the trajectory").alias("next_step"),
        F.coalesce("evidence_ids", F.array().cast(ids.schema["evidence_ids"].dataType)).alias("evidence_ids"), F.array_join(steps, "\n").alias("trajectory"),
    )
