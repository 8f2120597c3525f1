"""Registered queries over prompts, replies and laid-out pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import drafts, tools
from tessera.plans import fixtures as X
from tessera.plans.catalogue import query
from tessera.sources import documents

#: lines of a document as spans: three lines a block, ten blocks a page, a span for each part between commas
_SPANS = """l AS (SELECT doc_id, unnest(range(len(ls))) AS nth, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT doc_id, nth, unnest(range(len(ss))) AS span, unnest(ss) AS text FROM (SELECT doc_id, nth, string_split(t, ',') AS ss FROM l)),
b AS (SELECT doc_id AS paper_id, (nth // 30 + 1)::INT AS page, (nth // 3 % 10)::INT AS block, trim(string_agg(text, ' ' ORDER BY nth, span)) AS text, max(8 + length(text) % 7)::DOUBLE AS size, bool_or(length(text) % 11 = 0) AS bold FROM s GROUP BY 1, 2, 3)"""


@query("page_blocks", f"WITH {_SPANS} SELECT paper_id, page, block, md5(text) AS digest, size, bold FROM b WHERE text <> ''")
def page_blocks(s, d):
    """Blocks with the largest size and any bold font of their spans."""
    lines = X.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "t"))
    spans = lines.select("doc_id", "nth", F.posexplode(F.split("t", ",")).alias("span", "text")).selectExpr(
        "doc_id as paper_id", "cast(nth div 30 + 1 as int) as page", "cast(nth div 3 % 10 as int) as block", "nth as line", "span", "text",
        "cast(8 + length(text) % 7 as double) as size", "case when length(text) % 11 = 0 then 'Times-Bold' else 'Times' end as font",
    )
    return documents.page_blocks(spans).select("paper_id", "page", "block", F.md5("text").alias("digest"), "size", "bold")


def _text(task: str) -> str:
    return (drafts.rendered_examples(task) + drafts.FORMAT).replace("'", "''")


@query("few_shot_prompts", "WITH p AS (SELECT doc_id, kind, concat(rtrim(concat('Judge the source ', source, '  ')), CASE kind " + " ".join(f"WHEN '{t}' THEN '{_text(t)}'" for t in sorted(drafts.EXAMPLES)) + " END, chr(10), text) AS prompt FROM documents, (SELECT unnest([" + ", ".join(f"'{t}'" for t in sorted(drafts.EXAMPLES)) + "]) AS kind)) SELECT doc_id, kind, length(prompt) AS n_chars, md5(prompt) AS digest FROM p")
def few_shot_prompts(s, d):
    """The prompt of every task for every document, with the task's worked examples."""
    docs, out = X.table(s, d, "documents"), None
    for task in sorted(drafts.EXAMPLES):
        system = drafts.with_examples(F.concat(F.lit("Judge the source "), F.coalesce("source", F.lit("")), F.lit("  ")), task)
        part = docs.select("doc_id", F.lit(task).alias("kind"), F.concat(system, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "kind", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


#: replies of the answer judge, some of them wrong in one of the ways that are told apart
_ANSWER = "concat(CASE event_id % 4 WHEN 0 THEN 'Verdict: ' ELSE '' END, '{\"relevance\": ', event_id % 7 - 1, CASE WHEN event_id % 5 > 0 THEN concat(', \"evidence_sufficient\": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) ELSE '' END, CASE WHEN event_id % 11 = 0 THEN ', \"mood\": 1' ELSE '' END, ', \"confidence\": ', event_id % 13 / 10, CASE WHEN event_id % 17 = 0 THEN ']' ELSE '}' END, CASE event_id % 17 WHEN 0 THEN '}' ELSE '' END)"


@query("judge_replies", f"""WITH r AS (SELECT event_id, {_ANSWER} AS t FROM events), j AS (SELECT event_id, regexp_extract(t, '(?s)\\{{.*\\}}') AS j FROM r),
v AS (SELECT event_id, CASE WHEN NOT json_valid(j) THEN 'not JSON' WHEN json_extract(j, '$.evidence_sufficient') IS NULL THEN 'missing: evidence_sufficient' WHEN json_extract(j, '$.mood') IS NOT NULL THEN 'unknown: mood'
  WHEN NOT (json_extract(j, '$.relevance')::INT BETWEEN 0 AND 3) OR NOT (json_extract(j, '$.confidence')::DOUBLE BETWEEN 0 AND 1) THEN concat('out of range: ', concat_ws(', ', CASE WHEN NOT (json_extract(j, '$.relevance')::INT BETWEEN 0 AND 3) THEN 'relevance' END, CASE WHEN NOT (json_extract(j, '$.confidence')::DOUBLE BETWEEN 0 AND 1) THEN 'confidence' END)) END AS error, j FROM j)
SELECT event_id, error, CASE WHEN error IS NULL THEN json_extract(j, '$.relevance')::INT END AS relevance, CASE WHEN error IS NULL THEN json_extract(j, '$.evidence_sufficient')::BOOLEAN END AS evidence_sufficient FROM v""")
def judge_replies(s, d):
    """Replies of the answer judge read by its own schema."""
    text = F.expr(_ANSWER.replace("event_id % 13 / 10", "cast(event_id % 13 / 10 as string)"))
    read = tools.judge_replies(X.table(s, d, "events").select("event_id", text.alias("text")), "text", "answer")
    return read.select("event_id", "error", "reply.relevance", "reply.evidence_sufficient")
