"""What a caller sees: citations, partial lookups, readiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CITATION = r"\[([A-Za-z0-9_-]+)\]"
QUOTE = 300
STYLES = ("apa", "inline", "bibtex")


def citation(style: str) -> Column:
    """A chunk's citation from authors, year, title, venue, page, source_uri, paper_id."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; known: {STYLES}")
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit("Anon.")))
    lead = F.when(F.element_at(authors, 1) != "", F.element_at(F.split(F.element_at(authors, 1), r"\s+"), -1)).otherwise("Anon.")
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("n.d."))
    if style == "inline":
        name = F.when(F.size(authors) > 1, F.concat(lead, F.lit(" et al."))).otherwise(lead)
        return F.concat(F.lit("("), name, F.lit(", "), year, F.lit(")"))
    if style == "apa":
        venue = F.coalesce(F.concat(F.lit(" "), F.nullif("venue", F.lit("")), F.lit(".")), F.lit(""))
        page = F.coalesce(F.concat(F.lit(" p. "), F.nullif(F.col("page"), F.lit(0)).cast("string"), F.lit(".")), F.lit(""))
        return F.concat(F.array_join(authors, ", "), F.lit(" ("), year, F.lit("). "), "title", F.lit("."), venue, page)
    note = F.coalesce(F.nullif("venue", F.lit("")), F.col("source_uri"), F.col("paper_id"))
    lines = [
        F.concat(F.lit("@article{"), F.lower(lead), year, F.lit(",")),
        F.concat(F.lit("  title  = {"), "title", F.lit("},")),
        F.concat(F.lit("  author = {"), F.array_join(authors, " and "), F.lit("},")),
        F.concat(F.lit("  year   = {"), year, F.lit("},")),
        F.concat(F.lit("  note   = {"), note, F.lit("}")),
        F.lit("}"),
    ]
    return F.concat_ws("\n", *lines)


def resolve_citations(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that each draft of (draft_id, text) cites, in order of first mention; one that
    is unknown stays, with found = false."""
    cited = drafts.select("draft_id", F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1))).alias("pos", "chunk_id"))
    once = cited.groupBy("draft_id", "chunk_id").agg(F.min("pos").alias("pos"))
    known = chunks.select("chunk_id", "paper_id", "year", F.substring(F.trim("text"), 1, QUOTE).alias("quote"), F.lit(True).alias("found"))
    rows = once.join(known, "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    order = W.partitionBy("draft_id").orderBy("pos")
    return rows.withColumn("nth", F.row_number().over(order)).drop("pos")


def lookup_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per request of (request_id, chunk_ids): the found ids in order and an error struct
    that names the missing ones (NULL if none is)."""
    asked = requests.select("request_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    known = chunks.select("chunk_id").distinct().withColumn("ok", F.lit(True))
    rows = asked.join(known, "chunk_id", "left")
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "chunk_id")))), lambda x: x["chunk_id"])  # noqa: E731  one request's ids
    one = rows.groupBy("request_id").agg(pick(F.col("ok").isNotNull()).alias("found"), pick(F.col("ok").isNull()).alias("missing"))
    error = F.when(
        F.size("missing") > 0,
        F.struct(F.lit("not_found").alias("code"), F.concat(F.lit("unknown chunks: "), F.array_join("missing", ", ")).alias("message"), F.lit(False).alias("retryable"), (F.size("found") > 0).alias("partial")),
    )
    return one.select("request_id", "found", error.alias("error"))


def readiness(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, status): whether each table can be read and has rows."""
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows", F.when(F.col("rows") > 0, "ok").otherwise("degraded").alias("status"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def prefer_catalogue(candidates: DataFrame, sparse: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates with their text from the sparse catalogue, else from the store; those in
    neither are left out."""
    a = sparse.select("chunk_id", F.col("text").alias("a"))
    b = store.select("chunk_id", F.col("text").alias("b"))
    found = candidates.join(a, "chunk_id", "left").join(b, "chunk_id", "left").withColumn("text", F.coalesce("a", "b"))
    return found.where("text is not null").drop("a", "b")


def repair_brief(claims: DataFrame, violations: DataFrame) -> DataFrame:
    """Claims with what to do about each: fix those that a violation names word for word."""
    bad = violations.select("draft_id", F.col("claim").alias("text"), "kind").dropDuplicates(["draft_id", "text"])
    return claims.join(bad, ["draft_id", "text"], "left").withColumn("action", F.when(F.col("kind").isNotNull(), "fix").otherwise("keep"))


FENCED = r"(?s)```(?:json)?\s*(.*?)```"


def reply_object(text: Column) -> Column:
    """The JSON object in a model's reply, out of prose or a fence, as a string: from the
    first opening to the last closing brace. NULL where there is none."""
    inside = F.when(text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)).otherwise(text)
    start, end = F.instr(inside, "{"), F.length(inside) - F.instr(F.reverse(inside), "}") + 1
    return F.when((start > 0) & F.contains(inside, F.lit("}")) & (end >= start), F.substring(inside, start, end - start + 1))


def parsed_reply(text: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """struct(reply, error): the reply's object read by ``schema``, or what is wrong with it.
    A reply that cannot be read is an error and never a default value."""
    found = reply_object(text)
    reply = F.from_json(found, schema)
    missing = F.array_compact(F.array(*[F.when(reply[c].isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    error = (
        F.when(found.isNull(), F.lit("no object"))
        .when(F.try_parse_json(found).isNull(), F.lit("not JSON"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    return F.struct(F.when(error.isNull(), reply).alias("reply"), error.alias("error"))


@dataclass(frozen=True)
class Reply:
    """What a judge's reply has: its schema, the fields that it must have, and the least and
    largest value of numbers; other fields are an error."""

    schema: str
    required: tuple[str, ...]
    ranges: dict[str, tuple[float, float | None]]


_VIOLATIONS = "array<struct<kind:string,claim:string,explanation:string>>"
REPLIES = {
    "relevance": Reply("grade int, confidence double, rationale string", ("grade",), {"grade": (0, 3), "confidence": (0, 1)}),
    "faithfulness": Reply(
        f"violations {_VIOLATIONS}, total_claims int, cited_claims int, supported_cited_claims int, confidence double",
        ("total_claims", "cited_claims", "supported_cited_claims"),
        {"total_claims": (0, None), "cited_claims": (0, None), "supported_cited_claims": (0, None), "confidence": (0, 1)},
    ),
    "answer": Reply("relevance int, evidence_sufficient boolean, missing_aspects array<string>, confidence double, rationale string", ("relevance", "evidence_sufficient"), {"relevance": (0, 3), "confidence": (0, 1)}),
    "triage": Reply("label string, confidence double, conflicts array<struct<kind:string,chunk_ids:array<string>>>", ("label",), {"confidence": (0, 1)}),
    "reformulate": Reply("query string, rationale string", ("query",), {}),
}


def judge_replies(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds reply and error: each row's ``text`` read by the schema of its judge. The first
    that is wrong is told: no object, not JSON, a field that is missing, one that is not known, a number
    out of its range; then there is no reply. (Step by step, so that each text is parsed once.)"""
    of = REPLIES[kind]
    fields = [c.split(" ")[0] for c in of.schema.split(", ")]
    found = rows.withColumn("_object", reply_object(F.col(text)))
    read = found.withColumns({"_reply": F.from_json("_object", of.schema), "_keys": F.json_object_keys("_object")})
    r, some = F.col("_reply"), lambda parts: F.array_compact(F.array(F.lit(None).cast("string"), *parts))
    missing = some([F.when(r[c].isNull(), F.lit(c)) for c in of.required])
    outside = some([F.when((r[c] < low) | (F.lit(False) if high is None else r[c] > high), F.lit(c)) for c, (low, high) in of.ranges.items()])
    strange = F.array_sort(F.array_except("_keys", F.array(*[F.lit(c) for c in fields])))
    lists = read.withColumns({"_missing": missing, "_outside": outside, "_strange": strange})
    told = lambda name, column: F.when(F.size(column) > 0, F.concat(F.lit(f"{name}: "), F.array_join(column, ", ")))
    error = F.when(F.col("_object").isNull(), F.lit("no object")).when(F.try_parse_json("_object").isNull(), F.lit("not JSON"))
    error = F.coalesce(error, told("missing", "_missing"), told("unknown", "_strange"), told("out of range", "_outside"))
    judged = lists.withColumn("error", error)
    return judged.withColumn("reply", F.when(F.col("error").isNull(), r)).drop("_object", "_reply", "_keys", "_missing", "_outside", "_strange")


def report_lines() -> Column:
    """An ask report as text, from question, outcome, answer, references (array<struct<
    chunk_id, found, title, year, page>>), reason, next_step, draft, steps, n_evidence."""
    c = F.col
    line = lambda r: F.when(
        r["found"],
        F.concat(F.lit("  ["), r["chunk_id"], F.lit("] "), r["title"], F.lit(" ("), F.coalesce(r["year"].cast("string"), F.lit("n.d.")), F.lit(")"),
                 F.coalesce(F.concat(F.lit(", p. "), r["page"].cast("string")), F.lit(""))),
    ).otherwise(F.concat(F.lit("  ["), r["chunk_id"], F.lit("] NOT FOUND IN INDEX")))
    accepted = F.concat(F.array(c("answer"), F.lit(""), F.lit("References:")), F.transform("references", line))
    label = F.when(c("outcome") == "abstained", "ABSTAINED").otherwise("ESCALATED TO A PERSON")
    refused = F.concat(
        F.array(label, F.concat(F.lit("  why:  "), F.coalesce("reason", F.lit("n/a"))), F.concat(F.lit("  next: "), F.coalesce("next_step", F.lit("n/a")))),
        F.when(c("draft").isNotNull(), F.array(F.lit(""), F.lit("Unverified draft (do not rely on it):"), c("draft"))).otherwise(F.array().cast("array<string>")),
    )
    foot = F.concat(F.lit("["), c("outcome"), F.lit("] "), c("steps").cast("string"), F.lit(" routing steps, "), c("n_evidence").cast("string"), F.lit(" passages"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Q: "), c("question")), F.lit("")), F.when(c("outcome") == "accepted", accepted).otherwise(refused), F.array(F.lit(""), foot)), "\n")
