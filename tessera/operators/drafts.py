"""Drafting aids: what a labeller reads, what a writer is given, what a trainer takes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import hash_slot, normal_query, sentences, words
from tessera.operators.pairs import CAP, GAP

# fixed values: words that say nothing about a question's subject
DRAFT_STOP = tuple(
    """a an the of and or to in for on with is are was were be by from at as how what which
    why does do did this that these those it its their they into when whose who whom
    than then""".split()
)
QUOTE = 220
WINDOW = 5


def subject_terms(text: Column | str) -> Column:
    """Distinct subject words: longer than two letters, hyphens inside, no stop words."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9\-]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in DRAFT_STOP])
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2)))


def focus_view(specs: DataFrame, chunks: DataFrame, per_paper: int = 2) -> DataFrame:
    """For each spec of (query_id, query, targets): the chunks of each target paper that
    share most subject words with the query, each with its two best sentences."""
    q = specs.select("query_id", subject_terms("query").alias("q"), F.explode("targets").alias("paper_id"))
    rows = q.join(chunks.select("paper_id", "chunk_id", "text"), "paper_id")
    rows = rows.withColumn("overlap", F.size(F.array_intersect("q", subject_terms("text"))))
    nth = F.row_number().over(W.partitionBy("query_id", "paper_id").orderBy(F.desc("overlap"), "chunk_id"))
    best = rows.withColumn("nth", nth).where(F.col("nth") <= per_paper)
    # by overlap, then by place; the sort key is (-overlap, place)
    ordered = F.array_sort(
        F.transform(sentences(F.regexp_replace(F.col("text"), r"\s+", " ")), lambda s, i: F.struct((-F.size(F.array_intersect("q", subject_terms(s)))).alias("o"), i.alias("i"), s.alias("s")))
    )
    view = F.array_join(F.transform(F.slice(ordered, 1, 2), lambda x: F.substring(x["s"], 1, QUOTE)), " ... ")
    return best.select("query_id", "paper_id", "chunk_id", "overlap", "nth", view.alias("view"))


def context_window(evidence: DataFrame, n: int = WINDOW) -> DataFrame:
    """(query_id, context): the first n pieces of (query_id, rank, chunk_id, title, section,
    text), each under its source."""
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "chunk_id"))
    some = evidence.withColumn("nth", nth).where(F.col("nth") <= n)
    head = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] ("), F.col("title"), F.lit(", "), F.coalesce("section", F.lit("n/a")), F.lit(")\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("nth", head.alias("t"))))  # n entries
    return some.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def matches_all(patterns: list[str], text: Column) -> Column:
    """Every pattern, without regard to case; no patterns match nothing."""
    if not patterns:
        return F.lit(False)
    out = F.lit(True)
    for p in patterns:
        out = out & text.rlike(f"(?i){p}")
    return out


def matches_any(patterns: list[str], text: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?i){p}")
    return out


def on_topic(topic: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(topic.lower()))


def answers_question(relevance: Column) -> Column:
    return relevance >= 2


def should_abstain(evidence_sufficient: Column) -> Column:
    return ~evidence_sufficient


def can_write(label: Column) -> Column:
    return label.isin("sufficient", "partial", "conflicting")


def conflict_lines(conflicts: Column) -> Column:
    """An array of struct(kind, summary, newer) as what a writer is told about each."""

    def line(c: Column) -> Column:
        newer = F.coalesce(c["newer"], F.lit("the later one"))
        return (
            F.when(c["kind"] == "freshness", F.concat(F.lit("superseded: "), c["summary"], F.lit(" Lead with "), newer, F.lit(" and say that the earlier result was superseded.")))
            .when(c["kind"] == "disagreement", F.concat(F.lit("disagreement: "), c["summary"], F.lit(" Give both positions with their citations.")))
            .otherwise(F.concat(F.lit("scope: "), c["summary"], F.lit(" Say what each one measured.")))
        )

    return F.array_join(F.transform(conflicts, line), "\n")


def shuffled(rows: DataFrame, seed: Column | str = "query") -> DataFrame:
    """Rows of a query in an order that depends on the query and the chunk alone."""
    key = F.col(seed) if isinstance(seed, str) else seed
    order = W.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.substring(F.sha2(key, 256), 1, 8), F.col("chunk_id").cast("string"))), "chunk_id")
    return rows.withColumn("turn", F.row_number().over(order))


def training_rows(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected of pairs with texts."""
    return pairs.select(F.col("query").alias("prompt"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"))


def resolved_labels(labels: DataFrame, queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with query text and chunk text, and one row that counts what was dropped."""
    rows = labels.join(queries.select("query_id", "query"), "query_id", "left").join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    dropped = rows.agg(F.count_if(F.col("query").isNull()).alias("no_query"), F.count_if(F.col("query").isNotNull() & F.col("text").isNull()).alias("no_chunk"))
    return rows.where("query is not null and text is not null"), dropped


def any_rejected(verdicts: DataFrame, negatives: DataFrame, cap: int = CAP, gap: int = GAP) -> DataFrame:
    """The ablation without hard negatives: a query's chunks, best first, against any
    judged chunk of the corpus that is graded at least ``gap`` lower, in order of (grade,
    chunk_id); the first ``cap`` pairs of a query, each pair once.

    The negatives that a grade admits are the first ones of that order, and only a chosen
    chunk itself is left out. So the first cap + 1 negatives hold all that one chosen
    chunk can use, and of cap + 1 chosen chunks at most one is without a pair while later
    ones have some: neither bound changes the result.
    """
    known = F.col("chunk_id").isNotNull() & F.col("grade").isNotNull()
    least = negatives.where(known).groupBy(F.col("chunk_id").alias("rejected")).agg(F.min("grade").alias("gb"))
    least = least.orderBy("gb", "rejected").limit(cap + 1)
    best = verdicts.where(known).groupBy(normal_query("query").alias("nq"), F.col("chunk_id").alias("chosen")).agg(F.max("grade").alias("ga"))
    best = best.withColumn("pos", F.row_number().over(W.partitionBy("nq").orderBy(F.desc("ga"), "chosen"))).where(F.col("pos") <= cap + 1)
    met = best.crossJoin(F.broadcast(least)).where((F.col("ga") - F.col("gb") >= gap) & (F.col("chosen") != F.col("rejected")))  # cap + 1 rows
    nth = F.row_number().over(W.partitionBy("nq").orderBy("pos", "gb", "rejected"))
    return met.withColumn("nth", nth).where(F.col("nth") <= cap).select("nq", "chosen", "rejected", "nth")


PREFIXES = {"query": "query: ", "passage": "passage: "}  # fixed values: what the two kinds of text begin with


def stub_embeddings(texts: DataFrame, key: str, kind: str = "passage", dim: int = 64) -> DataFrame:
    """(key, embedding) of (key, text): unit vectors of hashed words, the stand-in for a
    model. Queries and passages get the prefixes of their kinds, as an asymmetric model
    wants them, so the same text has two vectors. Texts of one key count as one."""
    prefixed = F.concat(F.lit(PREFIXES[kind]), F.coalesce("text", F.lit("")))
    slots = texts.select(key, F.explode(words(prefixed)).alias("word")).select(key, hash_slot(F.col("word"), dim).cast("int").alias("slot"))
    counts = slots.groupBy(key, "slot").agg(F.count("*").cast("double").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))  # dim at most
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("embedding"))


#: worked examples of every task that a model is asked: (situation, given, reply)
EXAMPLES = {
    "relevance": (
        ("States the asked figure", "QUESTION: How large was the test set?\nPASSAGE (p1): We held out 2,000 samples.", {"grade": 3, "confidence": 0.9, "rationale": "gives the size"}),
        ("On the subject without an answer", "QUESTION: How large was the test set?\nPASSAGE (p2): Test sets must not leak.", {"grade": 1, "confidence": 0.7, "rationale": "no size is given"}),
    ),
    "answer": (
        ("All is answered", "QUESTION: Which metric?\nDRAFT: Recall is used [p1].", {"relevance": 3, "evidence_sufficient": True, "missing_aspects": [], "confidence": 0.9, "rationale": "names it"}),
        ("A part is missing", "QUESTION: Which metrics, and why?\nDRAFT: Recall is used [p1].", {"relevance": 1, "evidence_sufficient": True, "missing_aspects": ["why"], "confidence": 0.8, "rationale": "no reason"}),
    ),
    "faithfulness": (
        ("Every claim is supported", "DRAFT: Recall is used [p1].\nPASSAGE (p1): We report recall.", {"violations": [], "total_claims": 1, "cited_claims": 1, "supported_cited_claims": 1, "confidence": 0.9}),
        ("A claim says more than its source", "DRAFT: It always works [p1].\nPASSAGE (p1): It may work.", {"violations": [{"kind": "overstated_certainty", "claim": "It always works"}], "total_claims": 1, "cited_claims": 1, "supported_cited_claims": 0, "confidence": 0.8}),
    ),
    "triage": (
        ("The passages suffice", "QUESTION: Which metric?\nPASSAGES: p1: We report recall.", {"label": "sufficient", "confidence": 0.9, "conflicts": []}),
        ("They contradict each other", "QUESTION: Which is better?\nPASSAGES: p1: A wins. p2: B wins.", {"label": "conflicting", "confidence": 0.8, "conflicts": [{"kind": "disagree", "chunk_ids": ["p1", "p2"]}]}),
    ),
    "reformulate": (("Another vocabulary", "QUESTION: Does it forget?\nALREADY TRIED: Does it forget?", {"query": "catastrophic forgetting in fine-tuning", "rationale": "the literature's term"}),),
}
FORMAT = "\n\nReply with one JSON object and nothing else."


def rendered_examples(task: str) -> str:
    """The examples of a task as text of a prompt."""
    if task not in EXAMPLES:
        raise KeyError(f"no examples for {task!r}; known: {sorted(EXAMPLES)}")
    parts = [f"\n\nExample {i}: {situation}\n{given}\nReply: {json.dumps(reply, sort_keys=True)}" for i, (situation, given, reply) in enumerate(EXAMPLES[task], 1)]
    return "".join(parts)


def with_examples(system: Column | str, task: str) -> Column:
    """The system prompt with the worked examples of the task and what a reply looks like."""
    system = F.lit(system) if isinstance(system, str) else system
    return F.concat(F.rtrim(system), F.lit(rendered_examples(task) + FORMAT))


def category_report(entries: DataFrame) -> DataFrame:
    """(category, n, first_year, last_year) of fetched entries."""
    return entries.groupBy("category").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
