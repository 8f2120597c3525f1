"""Registered queries over stored indexes, added chunks, joint scores and the agent loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import block_index, increment, joint, loop, retrieve, vector_index
from tessera.plans import fixtures as X
from tessera.plans.catalogue import _RANK, _SQL, query, rounded
from tessera.plans.fixtures import TOKENS, with_views
from tessera.session import new_table_path


@query("block_topk", _SQL["bm25_topk"])
def block_topk(s, d):
    """The sparse ranking from a stored index of blocks."""
    path, chunks = new_table_path(s, "blocks"), X.chunks(s, d)
    clusters = chunks.selectExpr("chunk_id", "section as cluster")
    block_index.save_blocks(block_index.block_index(retrieve.sparse_index(chunks, persist=True), clusters), path)
    return rounded(block_index.top_blocks(X.requests(s, d), block_index.load_blocks(s, path), retrieve.ARM), "score")


def _stored_vectors(s, d):
    path = new_table_path(s, "vectors")
    vector_index.build(X.vectors(s, d), path)
    return vector_index.load(s, path)


@query("index_exact_topk", _SQL["cosine_topk"])
def index_exact_topk(s, d):
    """The dense ranking from a stored vector index, certified by its bounds."""
    return rounded(vector_index.search(X.requests(s, d), _stored_vectors(s, d), retrieve.ARM, exact=True), "score")


@query("index_recall", with_views("requests") + "SELECT count(*) AS n_requests, true AS reached FROM requests")
def index_recall(s, d):
    """Whether the bounded probes find 0.95 of the true neighbours of all requests."""
    truth = retrieve.cosine_top(X.requests(s, d), X.vectors(s, d), retrieve.ARM)
    found = vector_index.recall(vector_index.search(X.requests(s, d), _stored_vectors(s, d), retrieve.ARM), truth)
    return found.agg(F.count("*").alias("n_requests"), (F.avg("recall") >= 0.95).alias("reached"))


@query("incremental_topk", _SQL["bm25_topk"])
def incremental_topk(s, d):
    """An index of the English documents, extended by all that it lacks, is the index of all."""
    chunks = X.chunks(s, d).select("chunk_id", "text", "section")
    base = chunks.where("section = 'en'")
    index = increment.extend(retrieve.sparse_index(base, persist=True), chunks, base)
    return rounded(retrieve.bm25_top(X.requests(s, d), index, retrieve.ARM), "score")


_JOINT = f"""p AS (SELECT query_id, chunk_id, list_distinct({TOKENS.format('b.text')}) AS qs, {TOKENS.format('c.text')} AS cs FROM (SELECT DISTINCT query_id, chunk_id FROM results) JOIN benchmark b ON item_id = query_id JOIN documents c ON doc_id = chunk_id),
sc AS (SELECT query_id, chunk_id, coalesce(list_sum(list_transform(list_filter(qs, lambda w: list_contains(cs, w)), lambda w: 1 / (1 + (list_position(cs, w) - 1) / 100))), 0) / len(qs) AS score FROM p)"""


@query("joint_rerank", with_views("results", more=_JOINT) + f"SELECT query_id, chunk_id, round(score, 6) AS rerank_score, rank FROM (SELECT *, {_RANK} AS rank FROM sc)")
def joint_rerank(s, d):
    """Results of every query in the order of the joint scorer."""
    found = X.results(s, d).select("query_id", "chunk_id").distinct()
    asked = X.table(s, d, "benchmark").selectExpr("item_id as query_id", "text as query")
    return rounded(joint.joint_rerank(found, asked, X.chunks(s, d)), "rerank_score")


#: a user's events in turn are what the judges say of the user's run
_REPLIES = """list_element(['sufficient', 'partial', 'conflicting', 'insufficient', 'sufficient'], list_position(['view', 'click', 'signup', 'error', 'purchase'], event_type)) AS said, event_id % 10 / 10 AS sure, event_id % 29 = 0 AS failed,
  CASE event_id % 5 WHEN 1 THEN ['missing_citation'] WHEN 2 THEN ['unsupported_claim'] WHEN 3 THEN ['overstated_certainty', 'contradicts_source'] ELSE [] END AS kinds, event_id % 5 = 4 AS passed,
  event_id // 10 % 10 / 10 AS fc, event_id // 7 % 4 AS rel, event_id // 3 % 10 / 10 AS ac, event_id // 11 % 9 > 0 AS suff"""
_LOOP = f"""WITH RECURSIVE ev AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, {_REPLIES} FROM events),
st AS (SELECT DISTINCT u, 'triage' AS node, 0 AS steps, 0 AS rw, 0 AS rr, 0.0::DOUBLE AS cost, 1 AS rounds, 0 AS drafts, '' AS d, '' AS traj FROM ev
UNION ALL SELECT u, CASE WHEN split_part(nd, ' ', 1) IN ('write', 'rewrite') THEN 'editor' ELSE 'triage' END, steps + 1, rw + (nd LIKE 'rewrite %')::INT, rr + (nd LIKE 're_retrieve %')::INT,
  cost + CASE split_part(nd, ' ', 1) WHEN 'rewrite' THEN 1 WHEN 're_retrieve' THEN 4 ELSE 0 END, rounds + (nd LIKE 're_retrieve %')::INT, drafts + (nd LIKE 'write %' OR nd LIKE 'rewrite %')::INT, nd, concat(traj, '>', steps, ' ', node, ' ', nd)
FROM (SELECT *, CASE WHEN node = 'triage' THEN CASE WHEN steps >= 12 THEN 'escalate step_budget_exhausted' WHEN conf < 0.15 THEN 'write evidence_ok' WHEN lab = 'conflicting' THEN 'write evidence_conflicting'
    WHEN lab = 'insufficient' THEN CASE WHEN rr < 2 THEN 're_retrieve evidence_unusable' ELSE 'abstain evidence_insufficient' END ELSE 'write evidence_ok' END
  WHEN failed THEN 'escalate unexplained_failure' WHEN steps >= 12 THEN 'escalate step_budget_exhausted' WHEN fc < 0.15 THEN 'escalate low_faithfulness_confidence' WHEN ac < 0.15 THEN 'escalate low_answer_confidence'
  WHEN NOT suff THEN 'abstain evidence_insufficient'
  WHEN NOT passed THEN CASE WHEN len(kinds) = 0 THEN 'escalate unexplained_failure' WHEN list_has_any(kinds, ['unsupported_claim', 'contradicts_source']) THEN CASE WHEN rr < 2 THEN 're_retrieve deep_violation' ELSE 'escalate re_retrieval_budget_exhausted' END
    WHEN rw < 3 THEN 'rewrite shallow_violation' ELSE 'escalate rewrite_budget_exhausted' END
  WHEN rel < 2 THEN CASE WHEN rr < 2 THEN 're_retrieve answer_incomplete' ELSE 'escalate re_retrieval_budget_exhausted' END ELSE 'accept passed' END AS nd
  FROM (SELECT st.*, ev.failed, kinds, passed, fc, rel, ac, suff, CASE WHEN st.u % 6 = 0 THEN 'insufficient' WHEN ev.failed THEN 'partial' ELSE said END AS lab, CASE WHEN st.u % 6 = 0 THEN 1 WHEN ev.failed THEN 0 ELSE sure END AS conf
    FROM st JOIN ev ON ev.u = st.u AND ev.k = st.steps % ev.n WHERE split_part(d, ' ', 1) NOT IN ('accept', 'abstain', 'escalate'))))
SELECT u AS run_id, CASE split_part(d, ' ', 1) WHEN 'accept' THEN 'accepted' WHEN 'abstain' THEN 'abstained' ELSE 'escalated' END AS outcome, steps, rw AS rewrites, rr AS re_retrievals, cost, rounds, drafts,
  (CASE WHEN u % 6 = 0 THEN 0 ELSE 2 * rounds + 1 END)::BIGINT AS n_evidence, traj AS trajectory FROM st WHERE split_part(d, ' ', 1) IN ('accept', 'abstain', 'escalate')"""


def _loop_runs(s, d):
    events = X.table(s, d, "events")
    w = "(partition by user_id order by event_id)"
    replies = events.selectExpr(
        "user_id as run_id", f"row_number() over {w} - 1 as k", "count(*) over (partition by user_id) as n",
        "element_at(array('sufficient', 'partial', 'conflicting', 'insufficient', 'sufficient'), cast(array_position(array('view', 'click', 'signup', 'error', 'purchase'), event_type) as int)) as label",
        "event_id % 10 / 10D as confidence", "event_id % 29 = 0 as failed",
        "case event_id % 5 when 1 then array('missing_citation') when 2 then array('unsupported_claim') when 3 then array('overstated_certainty', 'contradicts_source') else cast(array() as array<string>) end as kinds",
        "event_id % 5 = 4 as passed", "event_id div 10 % 10 / 10D as faithfulness_confidence", "event_id div 7 % 4 as relevance",
        "event_id div 3 % 10 / 10D as answer_confidence", "event_id div 11 % 9 > 0 as evidence_sufficient",
    )
    n_docs = X.table(s, d, "documents").count()

    def search(asks):
        some = asks.where("run_id % 6 <> 0").select("run_id", "round", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
        return some.selectExpr("run_id", f"(run_id * 7 + round * 2 + j) % {n_docs} as chunk_id", "j + 1 as rank")

    def verdicts(live):
        sized = replies.where("k = 0").select("run_id", "n")
        placed = live.join(sized, "run_id").withColumn("k", F.col("steps_used") % F.col("n")).drop("n")
        return placed.join(replies.drop("n"), ["run_id", "k"]).drop("k")

    questions = events.selectExpr("user_id as run_id", "concat('what of ', user_id) as question")
    return loop.run(questions, search, verdicts, min_confidence=0.15)


@query("agent_runs", _LOOP)
def agent_runs(s, d):
    """Every user's run to its end, judged by the user's events in turn."""
    runs, _ = _loop_runs(s, d)
    told = F.transform("trajectory", lambda t: F.concat(F.lit(">"), F.concat_ws(" ", t["step"].cast("string"), t["node"], t["route"], t["trigger"])))
    return runs.select(
        "run_id", "outcome", F.col("steps_used").alias("steps"), F.col("rewrites_used").alias("rewrites"), F.col("re_retrievals_used").alias("re_retrievals"),
        F.col("cost_spent").alias("cost"), "rounds", "drafts", "n_evidence", F.array_join(told, "").alias("trajectory"),
    )
