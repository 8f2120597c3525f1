"""Control policy as columns: routes, evidence routes, budgets, handovers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.judge import DEEP, SHALLOW
from tessera.session import drop, materialize, ship

# fixed values: what a route costs, and what a person's time costs in the same units
ROUTE_COST = {"accept": 0.0, "write": 0.0, "abstain": 0.0, "escalate": 0.0, "rewrite": 1.0, "re_retrieve": 4.0, "discover": 20.0}
HUMAN_COST = 50.0
MAX_REWRITES, MAX_RE_RETRIEVALS, MAX_DISCOVERIES, MAX_STEPS = 3, 2, 0, 12
NODES = {"accept": "done", "rewrite": "writer", "write": "writer", "re_retrieve": "researcher", "discover": "researcher", "abstain": "flag_for_human", "escalate": "flag_for_human"}
# fixed values: which node may write a field of a run's state; others are set at its start
WRITERS = {
    "evidence": ("researcher",), "queries_issued": ("researcher",), "draft": ("writer",), "claims": ("writer",),
    "assessment": ("editor",), "faithfulness": ("editor",), "answer": ("editor",), "decisions": ("editor",), "budget": ("editor",),
    "outcome": ("editor", "flag_for_human"),
}
PLACES = 1 << 23  # counts by which the tokens of queries are ordered
MEETINGS = 3  # rare tokens that two sets must share before they are looked at
BITS = 1024  # of a set of tokens, for a bound of how many tokens two sets differ in
OUTCOMES = {"accept": "accepted", "abstain": "abstained", "escalate": "escalated"}


def lookup(table: dict[str, str | float], key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def route_cost(route: Column) -> Column:
    return lookup(ROUTE_COST, route, 1.0)


def node(route: Column) -> Column:
    return lookup(NODES, route, "flag_for_human")


def outcome(route: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), route)


def _out(route: str, trigger: str) -> Column:
    return F.struct(F.lit(route).alias("route"), F.lit(trigger).alias("trigger"))


def decide_route(min_faithfulness: float = 0.0, min_answer: float = 0.0, cost_aware: bool = False) -> Column:
    """struct(route, trigger) of a drafted answer, from the columns steps_used,
    rewrites_used, re_retrievals_used, discoveries_used, cost_spent, kinds (of violations),
    passed, faithfulness_confidence, answer_confidence, relevance, evidence_sufficient. The
    order matters: the budget first, then what is not understood, then what is unsure."""
    c = F.col
    left = lambda used, most: F.greatest(F.lit(0), most - c(used))
    retrieve = left("re_retrievals_used", MAX_RE_RETRIEVALS)
    rewrite = left("rewrites_used", MAX_REWRITES)
    discover = left("discoveries_used", MAX_DISCOVERIES)
    to_come = rewrite * ROUTE_COST["rewrite"] + retrieve * ROUTE_COST["re_retrieve"] + discover * ROUTE_COST["discover"]
    has = lambda kinds: F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds]))
    unknown = F.exists("kinds", lambda k: ~k.isin(*SHALLOW, *DEEP))
    answered = c("relevance").isNotNull()
    if_left = lambda n, yes, no: F.when(n > 0, yes).otherwise(no)
    failed = (
        F.when(F.size("kinds") == 0, _out("escalate", "unexplained_failure"))
        .when(has(DEEP), if_left(retrieve, _out("re_retrieve", "deep_violation"), _out("escalate", "re_retrieval_budget_exhausted")))
        .otherwise(if_left(rewrite, _out("rewrite", "shallow_violation"), _out("escalate", "rewrite_budget_exhausted")))
    )
    return (
        F.when(c("steps_used") >= MAX_STEPS, _out("escalate", "step_budget_exhausted"))
        .when(F.lit(cost_aware) & (c("cost_spent") + to_come > HUMAN_COST), _out("escalate", "cost_ceiling"))
        .when(unknown, _out("escalate", "unclassified_violation"))
        .when(c("faithfulness_confidence") < min_faithfulness, _out("escalate", "low_faithfulness_confidence"))
        .when(answered & (c("answer_confidence") < min_answer), _out("escalate", "low_answer_confidence"))
        .when(answered & ~c("evidence_sufficient"), if_left(discover, _out("discover", "live_discovery_attempt"), _out("abstain", "evidence_insufficient")))
        .when(~c("passed"), failed)
        .when(answered & (c("relevance") < 2), if_left(retrieve, _out("re_retrieve", "answer_incomplete"), _out("escalate", "re_retrieval_budget_exhausted")))
        .otherwise(_out("accept", "passed"))
    )


def decide_evidence(min_confidence: float = 0.0, max_discoveries: int = MAX_DISCOVERIES) -> Column:
    """struct(route, trigger) of a retrieved set before anything is written, from label,
    confidence, steps_used, re_retrievals_used, discoveries_used."""
    c = F.col
    no_evidence = (
        F.when(c("re_retrievals_used") < MAX_RE_RETRIEVALS, _out("re_retrieve", "evidence_unusable"))
        .when(c("discoveries_used") < max_discoveries, _out("discover", "live_discovery_attempt"))
        .otherwise(_out("abstain", "evidence_insufficient"))
    )
    return (
        F.when(c("steps_used") >= MAX_STEPS, _out("escalate", "step_budget_exhausted"))
        .when(c("confidence") < min_confidence, _out("write", "evidence_ok"))
        .when(c("label") == "conflicting", _out("write", "evidence_conflicting"))
        .when(c("label") == "insufficient", no_evidence)
        .otherwise(_out("write", "evidence_ok"))
    )


def running_budget(steps: DataFrame) -> DataFrame:
    """Steps of (run_id, seq, route) with their index and the budget spent up to each."""
    w = W.partitionBy("run_id").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    count = lambda r: F.sum(F.when(F.col("route") == r, 1).otherwise(0)).over(upto)
    return steps.select(
        "*",
        (F.row_number().over(w) - 1).alias("step"),
        count("rewrite").alias("rewrites_used"),
        count("re_retrieve").alias("re_retrievals_used"),
        F.sum(route_cost(F.col("route"))).over(upto).alias("cost_spent"),
    )


class StateViolation(RuntimeError):
    """A node wrote a field that it does not own."""


def unowned_writes(writes: DataFrame, writers: dict[str, tuple[str, ...]] = WRITERS) -> DataFrame:
    """Writes (node, field, ...) that break the ownership, with why: a field that no node
    may write, or another node's."""
    owners = F.create_map(*[x for field, nodes in writers.items() for x in (F.lit(field), F.array(*[F.lit(n) for n in nodes]))])
    own = F.try_element_at(owners, F.col("field"))
    reason = F.when(own.isNull(), F.lit("not writable")).when(~F.array_contains(own, F.col("node")), F.concat(F.lit("owned by "), F.array_join(own, ", ")))
    return writes.withColumn("violation", reason).where("violation is not null")


def assert_owned(writes: DataFrame, writers: dict[str, tuple[str, ...]] = WRITERS) -> None:
    found = unowned_writes(writes, writers).limit(5).collect()
    if found:
        raise StateViolation("; ".join(f"{r.node} may not write {r.field}: {r.violation}" for r in found))


def handover(steps: DataFrame) -> DataFrame:
    """What a person is given of each run: its last step, outcome, number of steps, cost."""
    last = F.max_by(F.struct("route", "trigger"), "step")
    return steps.groupBy("run_id").agg(
        last["route"].alias("route"), last["trigger"].alias("trigger"), F.count("*").alias("steps"), F.sum(route_cost(F.col("route"))).alias("cost")
    ).withColumn("outcome", outcome(F.col("route")))


def novel_queries(queries: DataFrame, most: float = 0.8) -> DataFrame:
    """(session, query_id, seq, tokens) with novel: fewer than ``most`` of its tokens shared,
    as sets, with every earlier query of its session. A query without tokens is never novel.

    Queries of one session with equal sets are one class, known by its first one: what is
    compared is classes. They meet on their rarest tokens: two sets of such a similarity
    share at least ``most`` of either, so one of the first n - ceil(most * n) + 1 in any
    common order. At the first token that two sets share, what is left of each bounds how
    many they can share; only classes that may share enough are compared, once each pair.

    Sets are moved when classes are made, and those of classes that may still be alike when
    they are compared. In between a class is one row: numbers of its rarest tokens, and bits
    that tell how many tokens two sets differ in at least.
    """
    tokens = F.array_distinct("tokens")
    listed = F.to_json(F.array_sort(tokens))
    keyed = queries.withColumn("set", F.md5(listed)).withColumn("n", F.size(tokens))
    sets = keyed.withColumn("listed", listed).where(F.col("n") > 0).groupBy("session", "set").agg(F.min("seq").alias("first"), F.first("n").alias("n"), F.first("listed").alias("listed"))
    sets = materialize(sets.withColumn("class", F.monotonically_increasing_id()), "novelty-sets")
    kind = queries.schema["tokens"].dataType.simpleString()
    back = lambda c: F.from_json(c, kind)
    numbers = sets.select("session", "class", "n", F.transform(back("listed"), lambda w: F.xxhash64("session", w)).alias("numbers"))
    rarest = materialize(_rarest(numbers, most), "novelty-rarest")
    rare = rarest.select("session", "class", "n", "skipped", F.posexplode("numbers").alias("at", "w")).select("session", "class", "n", "w", (F.col("skipped") + F.col("at") + 1).alias("nth"))
    bits = rarest.select("class", "n", "bits")
    both = _may_be_alike(rare, most, MEETINGS).join(bits, "class").join(bits.toDF("other", "other_n", "other_bits"), "other")
    differ = F.aggregate(F.zip_with("bits", "other_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda done, x: done + x)
    near = differ <= (1 - most) / (1 + most) * (F.col("n") + F.col("other_n")) + 1e-9
    pairs = materialize(both.where(near).select("class", "other"), "novelty-pairs")
    drop(rarest)
    wanted = pairs.select("class").union(pairs.select("other")).distinct()
    own = materialize(sets.join(wanted, "class", "left_semi").select("class", "session", "set", "first", "listed"), "novelty-wanted")
    both = pairs.join(own, "class").join(own.toDF("other", "other_session", "other_set", "other_first", "other_listed"), "other")
    both = both.withColumns({"t": back("listed"), "u": back("other_listed")}).withColumn("shared", F.size(F.array_intersect("t", "u")))
    alike = F.col("shared") / (F.size("t") + F.size("u") - F.col("shared")) >= most
    alike = materialize(both.where(alike).select("session", "set", "first", "other_set", "other_first"), "novelty-alike")
    drop(own)
    links = alike.select("session", "set", F.col("other_first").alias("at")).union(alike.select("session", F.col("other_set").alias("set"), F.col("first").alias("at")))
    earliest = links.union(sets.select("session", "set", F.col("first").alias("at"))).groupBy("session", "set").agg(F.min("at").alias("at"))
    told = keyed.join(earliest, ["session", "set"], "left")
    return told.withColumn("novel", (F.col("n") > 0) & (F.col("at") >= F.col("seq"))).select(*queries.columns, "novel")


def _rarest(classes: DataFrame, most: float) -> DataFrame:
    """(session, class, n, skipped, numbers, bits) of (session, class, n, numbers): a class's
    first n - ceil(most * n) + MEETINGS numbers from the rarest on, but for the ``skipped`` ones
    first, which no other class has; and the parities of its numbers dealt to BITS bits.

    How rare a number is, is told by the count of all numbers at its place, of PLACES:
    any common order is right, and those counts are a table of fixed size that tasks hold.
    """
    spark, places = classes.sparkSession, PLACES
    ship(spark)
    counts = classes.select(F.explode("numbers").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(places - 1)).alias("place")).agg(F.count("*").alias("df"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("df")))
    found = counts.where("df > 1").select((F.col("place") * 256 + level).cast("int").alias("x")).toArrow().column("x").to_numpy()
    table = np.zeros(places, np.uint8)  # 0: of one class
    table[found >> 8] = found & 255
    held = spark.sparkContext.broadcast(table)

    def run(batches: Iterator) -> Iterator:
        levels = held.value
        for batch in batches:
            lists = batch.column("numbers")
            size = pc.list_value_length(lists).to_numpy()
            number = lists.flatten().to_numpy()
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            level = levels[number & (places - 1)]
            n = size.astype(np.int64)
            kept = np.minimum(n, n - np.ceil(n * most - 1e-9).astype(np.int64) + MEETINGS)
            order = np.lexsort((number, level, row))
            nth = np.arange(len(number)) - start[row]
            first = (nth < kept[row]) & (level[order] > 0)
            skipped = np.minimum(np.bincount(row[level == 0], minlength=len(n)), kept)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int32)
            odd = np.bincount(row * BITS + (number >> 40 & (BITS - 1)), minlength=len(n) * BITS) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "session": batch.column("session"), "class": batch.column("class"), "n": batch.column("n"), "skipped": skipped.astype(np.int32),
                "numbers": pa.ListArray.from_arrays(ends, number[order][first]), "bits": pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64), bits),
            })

    kind = classes.schema["session"].dataType.simpleString()
    return classes.mapInArrow(run, f"session {kind}, class long, n int, skipped int, numbers array<long>, bits array<long>")


def _may_be_alike(rare: DataFrame, most: float, times: int = 1) -> DataFrame:
    """Pairs (class, other) of (session, class, n, w, nth): rare tokens with their places.
    The first one's set is not the larger, so fewer of its tokens are needed.

    Sets that may be alike meet on ``times`` tokens, or on all that they must share: each of
    the first ones leaves enough of both sets, if it counts as the last of them. So each
    set needs ``times`` - 1 tokens more, and sets that meet by chance mostly do so once.
    """
    other = rare.toDF("session", "other", "other_n", "w", "other_nth")
    once = (F.col("n") < F.col("other_n")) | (F.col("n") == F.col("other_n")) & (F.col("class") < F.col("other"))
    near = F.col("n") >= most * F.col("other_n") - 1e-9
    left = times + F.least(F.col("n") - F.col("nth"), F.col("other_n") - F.col("other_nth"))  # of either set, from this token on
    needed = most / (1 + most) * (F.col("n") + F.col("other_n")) - 1e-9
    first = rare.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * (2 * most / (1 + most)) - 1e-9) + times)
    # Spark's size check does not know how many tokens a class has: without the hint it broadcasts them
    met = first.join(other.hint("merge"), ["session", "w"]).where(once & near & (left >= needed))
    met = met.groupBy("class", "other", "n", "other_n").agg(F.count("*").alias("shared"))
    return met.where(F.col("shared") >= F.least(F.lit(times), F.ceil(needed))).select("class", "other")
