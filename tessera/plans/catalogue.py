"""The registered queries of the engine and, where SQL expresses them, DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.stats import Z_95, Z_POWER_80
from tessera.operators import agreement, drafts, gate, ingest, judge, labels, metrics, pairs, policy, retrieve, tools
from tessera.plans import fixtures as X
from tessera.plans.fixtures import sql_sentences, sql_terms, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


#: positions are 64-bit in both engines' results
LONGS = ("rank", "bm25_rank", "vector_rank", "position", "nth", "step", "n_chars")


def query(name: str, sql: str | None = None):
    def add(f):
        def run(s: SparkSession, d: str) -> DataFrame:
            df = f(s, d)
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if c in LONGS and kind == "int"})

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def _register_more() -> None:
    from tessera.plans import reply_plans, search_plans, stream_plans  # noqa: F401  they add their queries to this catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register_more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_more()
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- text -----------------------------------------------------------------------------


@query("tokenize_terms", f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_terms('text')} AS t FROM documents)")
def tokenize_terms(s, d):
    t = T.terms("text")
    return X.table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(
    "chunk_identity",
    "SELECT doc_id, substr(sha256(concat(doc_id, ':', 0, ':', length(text), ':', text)), 1, 16) AS chunk_id, substr(sha1(source), 1, 10) AS paper_id, concat('d', doc_id % 4, '-', substr(sha256(text), 1, 8)) AS draft_id FROM documents",
)
def chunk_identity(s, d):
    return X.table(s, d, "documents").select(
        "doc_id", T.chunk_identity("doc_id", F.lit(0), F.length("text"), "text").alias("chunk_id"), T.paper_identity("source").alias("paper_id"),
        T.draft_identity(F.col("doc_id") % 4, "text").alias("draft_id"),
    )


_PARAGRAPHS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '\n([A-Z])', concat(chr(1), '\1'), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("paragraph_split", f"SELECT doc_id, nth, length(p) AS n_chars, md5(p) AS digest FROM (SELECT doc_id, unnest(range(len(ps))) AS nth, unnest(ps) AS p FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE [trim(text)] END AS ps FROM (SELECT doc_id, text, {_PARAGRAPHS} AS f FROM documents)))")
def paragraph_split(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("nth", "p"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


@query("sentence_split", f"SELECT doc_id, nth, length(p) AS n_chars, md5(p) AS digest FROM (SELECT doc_id, unnest(range(len(ps))) AS nth, unnest(ps) AS p FROM (SELECT doc_id, {sql_sentences('text')} AS ps FROM documents))")
def sentence_split(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("nth", "p"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


@query("paragraph_spans", f"""WITH RECURSIVE ps AS (SELECT doc_id, text, CASE WHEN len(f) > 0 THEN f ELSE [trim(text)] END AS l FROM (SELECT doc_id, text, {_PARAGRAPHS} AS f FROM documents)),
pr AS (SELECT doc_id, unnest(range(len(l))) AS nth, unnest(l) AS p FROM ps),
sp AS (SELECT doc_id, 0::BIGINT AS nth, 0::BIGINT AS "start", 0::BIGINT AS "end", true AS seed FROM ps
  UNION ALL SELECT a.doc_id, pr.nth, a."end" + greatest(instr(substr(text, (a."end" + 1)::INT), p), 1) - 1, a."end" + greatest(instr(substr(text, (a."end" + 1)::INT), p), 1) - 1 + length(p), false
  FROM sp a JOIN pr ON pr.doc_id = a.doc_id AND pr.nth = CASE WHEN a.seed THEN 0 ELSE a.nth + 1 END JOIN documents d ON d.doc_id = a.doc_id)
SELECT doc_id, nth, "start"::INT AS "start", "end"::INT AS "end" FROM sp WHERE NOT seed""")
def paragraph_spans(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(T.spans("text", T.paragraphs("text"))).alias("nth", "span"))
    return rows.select("doc_id", "nth", "span.start", "span.end")


@query("normal_forms", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) = '' AS no_title, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS fingerprint, md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS query FROM documents")
def normal_forms(s, d):
    return X.table(s, d, "documents").select(
        "doc_id", (T.normal_title("text") == "").alias("no_title"), F.md5(T.normal_title("text")).alias("title"), F.md5(T.fingerprint("text")).alias("fingerprint"), F.md5(T.normal_query("text")).alias("query")
    )


# --- ingestion ------------------------------------------------------------------------

_BODY = """
sizes AS (SELECT paper_id, round(size, 1) AS s, count(*) AS n, min(page * 100 + block) AS seen FROM blocks GROUP BY 1, 2),
body AS (SELECT paper_id, s AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, seen) AS r FROM sizes) WHERE r = 1)"""
_MARKED = _BODY + r""",
marked AS (SELECT b.*, body_size, trim(text) AS t,
  coalesce(trim(text) <> '' AND length(trim(text)) <= 90 AND len(regexp_split_to_array(trim(text), '\s+')) <= 12
    AND (size > body_size + 0.8 OR (bold AND size >= body_size))
    AND (regexp_matches(trim(text), '^\s*(\d+(\.\d+)*)[\.\)]?\s+[A-Z]')
      OR (len(regexp_extract_all(trim(text), '\p{L}')) / length(trim(text)) >= 0.5 AND regexp_matches(trim(text), '[A-Za-z]{3,}'))), false) AS heading
  FROM blocks b JOIN body USING (paper_id)),
sectioned AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN t END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, block ROWS UNBOUNDED PRECEDING), 'FRONT_MATTER') AS section FROM marked)"""
_RECORDS = _MARKED + """,
bodies AS (SELECT * FROM sectioned WHERE NOT heading AND trim(text) <> ''),
changed AS (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY paper_id, page ORDER BY block) IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS step FROM bodies),
segmented AS (SELECT *, sum(step) OVER (PARTITION BY paper_id, page ORDER BY block ROWS UNBOUNDED PRECEDING) AS segment FROM changed),
parts AS (SELECT paper_id, page, section, segment, string_agg(text, chr(10) ORDER BY block) AS text FROM segmented GROUP BY 1, 2, 3, 4),
records AS (SELECT paper_id, page, section, text, length(text) AS n_chars,
  contains(lower(section), 'references') OR contains(lower(section), 'bibliography') OR contains(lower(section), 'acknowledg') OR contains(lower(section), 'appendix') AS dropped,
  sum(length(text)) OVER (PARTITION BY paper_id, page) < 200 AS thin, row_number() OVER (PARTITION BY paper_id, page ORDER BY segment) - 1 AS ordinal FROM parts)"""


@query("body_font", with_views("blocks", more=_BODY) + "SELECT paper_id, body_size FROM body")
def body_font(s, d):
    return ingest.body_size(X.blocks(s, d))


@query("heading_flags", with_views("blocks", more=_MARKED) + "SELECT paper_id, page, block, heading, md5(section) AS section FROM sectioned")
def heading_flags(s, d):
    return ingest.sectioned(X.blocks(s, d)).select("paper_id", "page", "block", "heading", F.md5("section").alias("section"))


@query("page_flags", with_views("blocks", more=_RECORDS) + "SELECT paper_id, page, ordinal::INT AS ordinal, md5(section) AS section, n_chars, dropped, thin, md5(text) AS digest FROM records")
def page_flags(s, d):
    return ingest.page_records(X.blocks(s, d)).select("paper_id", "page", "ordinal", F.md5("section").alias("section"), "n_chars", "dropped", "thin", F.md5("text").alias("digest"))


_ISLANDS = _RECORDS + """,
istep AS (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY paper_id ORDER BY page, ordinal) IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS st FROM records),
iunit AS (SELECT *, sum(st) OVER (PARTITION BY paper_id ORDER BY page, ordinal ROWS UNBOUNDED PRECEDING) AS unit FROM istep),
units AS (SELECT paper_id, unit, section, string_agg(text, chr(10) ORDER BY page, ordinal) AS text, min(page) AS page_start, max(page) AS page_end, count(DISTINCT page) AS n_pages FROM iunit GROUP BY 1, 2, 3)"""


@query("section_islands", with_views("blocks", more=_ISLANDS) + "SELECT paper_id, unit::BIGINT AS unit, md5(section) AS section, md5(text) AS digest, page_start, page_end, n_pages::INT AS n_pages FROM units")
def section_islands(s, d):
    units = ingest.islands(ingest.page_records(X.blocks(s, d)))
    return units.select("paper_id", "unit", F.md5("section").alias("section"), F.md5("text").alias("digest"), "page_start", "page_end", F.size("pages").alias("n_pages"))


@query("parse_report", with_views("blocks", more=_RECORDS) + "SELECT paper_id, count(DISTINCT page) AS pages, count(*) AS records, count(CASE WHEN NOT dropped AND NOT thin THEN 1 END) AS kept, count(DISTINCT CASE WHEN thin THEN page END) AS thin_pages, count(DISTINCT section) AS n_sections FROM records GROUP BY 1")
def parse_report(s, d):
    report = ingest.parse_report(ingest.page_records(X.blocks(s, d)))
    return report.select("paper_id", "pages", "records", "kept", "thin_pages", F.size("sections").cast("long").alias("n_sections"))


@query("packed_chunks")
def packed_chunks(s, d):
    units = ingest.islands(ingest.page_records(X.blocks(s, d)).withColumn("paper_id", F.col("paper_id").cast("string")))
    return ingest.build_chunks(ingest.absorbed(units)).select("chunk_id", "paper_id", "char_start", "char_end", "n_tokens", "page")


@query("fixed_window_chunks", "WITH p AS (SELECT doc_id AS paper_id, nth AS pos, len(regexp_extract_all(line, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS n FROM (SELECT doc_id, unnest(range(len(ls))) AS nth, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))), w AS (SELECT *, floor((sum(n) OVER (PARTITION BY paper_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - n) / 350)::BIGINT AS win FROM p) SELECT paper_id, win AS \"window\", min(pos) AS \"first\", max(pos) AS \"last\", sum(n)::BIGINT AS n FROM w GROUP BY 1, 2")
def fixed_window_chunks(s, d):
    lines = X.table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ingest.fixed_windows(lines.select("paper_id", F.col("pos").cast("long").alias("pos"), T.token_count("line").alias("n_tokens")))


_TITLES = "SELECT page_id AS paper_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"


def _titles(s, d):
    return X.table(s, d, "pages").select(F.col("page_id").alias("paper_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("canonical_exact", f"WITH t AS (SELECT paper_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS nt FROM ({_TITLES})) SELECT paper_id, CASE WHEN nt <> '' THEN min(paper_id) OVER (PARTITION BY nt) ELSE paper_id END AS canonical_id FROM t")
def canonical_exact(s, d):
    return ingest.canonical_exact(_titles(s, d))


@query("canonical_fuzzy")
def canonical_fuzzy(s, d):
    return ingest.canonical_fuzzy(_titles(s, d))


@query("token_distribution", """WITH v AS (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::BIGINT AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM v),
q AS (SELECT k, n, greatest(least(floor((n + 1) * k / 4)::BIGINT, n - 1), 1) AS j, (n + 1) * k / 4.0::DOUBLE AS spot FROM (SELECT DISTINCT n FROM r), (SELECT unnest([1, 2, 3]) AS k)),
x AS (SELECT k, round(CASE WHEN n = 1 THEN max(CASE WHEN i = j THEN v END) ELSE max(CASE WHEN i = j THEN v END) * (1 - (spot - j)) + max(CASE WHEN i = j + 1 THEN v END) * (spot - j) END, 1) AS v FROM q JOIN r USING (n) GROUP BY k, n, j, spot)
SELECT (SELECT count(*) FROM v) AS n, (SELECT min(v) FROM v) AS min, (SELECT max(v) FROM v) AS max, (SELECT round(avg(v), 6) FROM v) AS mean, max(CASE WHEN k = 1 THEN v END) AS p25, max(CASE WHEN k = 2 THEN v END) AS median, max(CASE WHEN k = 3 THEN v END) AS p75 FROM x""")
def token_distribution(s, d):
    return rounded(ingest.exclusive_quartiles(X.table(s, d, "documents").select(T.token_count("text").cast("long").alias("v"))), "mean")


# --- retrieval ------------------------------------------------------------------------

_POSTINGS = f"""
tok AS (SELECT doc_id AS chunk_id, {sql_terms('text')} AS ts FROM documents),
len AS (SELECT chunk_id, greatest(len(ts), 1) AS dl FROM tok),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM len),
stats AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""
_BM25 = _POSTINGS + f""",
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM stats, corpus),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark) GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN len USING (chunk_id), corpus GROUP BY 1, 2) WHERE score > 0)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id)"
_COSINE = """
cosine AS (SELECT query_id, chunk_id, list_cosine_similarity(r.embedding, v.embedding) AS score FROM requests r, vectors v)"""
_ARMS = _BM25 + "," + _COSINE + f""",
s AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM bm25) WHERE rank <= 30),
v AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM cosine) WHERE rank <= 30)"""
_RRF = _ARMS + """,
rrf AS (SELECT coalesce(s.query_id, v.query_id) AS query_id, coalesce(s.chunk_id, v.chunk_id) AS chunk_id, coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + v.rank), 0) AS score,
  s.rank AS bm25_rank, v.rank AS vector_rank, s.score AS bm25_score, v.score AS vector_score FROM s FULL JOIN v ON s.query_id = v.query_id AND s.chunk_id = v.chunk_id)"""


@query("term_stats", with_views(more=_POSTINGS) + "SELECT term, df, sum(tf)::BIGINT AS cf FROM stats JOIN post USING (term) GROUP BY 1, 2")
def term_stats(s, d):
    return retrieve.sparse_index(X.chunks(s, d)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("bm25_topk", with_views(more=_BM25) + f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM bm25) WHERE rank <= 30")
def bm25_topk(s, d):
    return rounded(retrieve.bm25_top(X.requests(s, d), retrieve.sparse_index(X.chunks(s, d), persist=True), retrieve.ARM), "score")


#: every chunk has a score with every query, most often 0
_STUB = f"""tok AS (SELECT doc_id AS chunk_id, {X.TOKENS.format('text')} AS ts FROM documents), len AS (SELECT chunk_id, greatest(len(ts), 1) AS dl FROM tok),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY 1, 2), corpus AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM len), stats AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({X.TOKENS.format('query')}) AS term FROM asked) GROUP BY 1, 2),
hit AS (SELECT query_id, chunk_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score FROM qt JOIN post USING (term) JOIN stats USING (term) JOIN len USING (chunk_id), corpus GROUP BY 1, 2),
sc AS (SELECT a.query_id, c.chunk_id, coalesce(score, 0) AS score FROM asked a JOIN chunks c ON (a.year_min IS NULL OR coalesce(c.year >= a.year_min, false)) AND (a.year_max IS NULL OR coalesce(c.year <= a.year_max, false)) LEFT JOIN hit h ON h.query_id = a.query_id AND h.chunk_id = c.chunk_id)"""
_STUB_TOP = f" SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM sc) WHERE rank <= 5"
#: the texts of items, and for each the same with words that no document has, alone
_ASKED = "SELECT item_id * 2 AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id * 2 + 1, concat('zzzq', item_id, 'x') FROM benchmark"


def _asked(s, d):
    own = X.table(s, d, "benchmark")
    return own.selectExpr("item_id * 2 as query_id", "text as query").unionByName(own.selectExpr("item_id * 2 + 1 as query_id", "concat('zzzq', item_id, 'x') as query"))


@query("stub_bm25_topk", with_views("chunks", more=f"asked AS (SELECT *, NULL::INT AS year_min, NULL::INT AS year_max FROM ({_ASKED})), " + _STUB) + _STUB_TOP)
def stub_bm25_topk(s, d):
    asked = _asked(s, d).selectExpr("*", "cast(null as int) as year_min", "cast(null as int) as year_max")
    return rounded(retrieve.stub_search(asked, X.chunks(s, d)), "score")


@query("cosine_topk", with_views("requests", "vectors", more=_COSINE) + f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM cosine) WHERE rank <= 30")
def cosine_topk(s, d):
    return rounded(retrieve.cosine_top(X.requests(s, d), X.vectors(s, d), retrieve.ARM), "score")


def _arm_pair(s, d):
    sparse = retrieve.bm25_top(X.requests(s, d), retrieve.sparse_index(X.chunks(s, d), persist=True), retrieve.ARM).drop("rank")
    return sparse, retrieve.cosine_top(X.requests(s, d), X.vectors(s, d), retrieve.ARM).drop("rank")


@query("rrf_fusion", with_views("requests", "vectors", more=_RRF) + f"SELECT query_id, chunk_id, round(score, 8) AS score, bm25_rank, vector_rank, array_to_string(list_filter([CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN vector_rank IS NOT NULL THEN 'vector' END], lambda x: x IS NOT NULL), '+') AS arms, rank FROM (SELECT *, {_RANK} AS rank FROM rrf) WHERE rank <= 20")
def rrf_fusion(s, d):
    fused = retrieve.fuse("rrf", *_arm_pair(s, d))
    return fused.select("query_id", "chunk_id", F.round("score", 8).alias("score"), "bm25_rank", "vector_rank", F.array_join("arms", "+").alias("arms"), "rank")


@query("weighted_fusion", with_views("requests", "vectors", more=_ARMS + f""",
ns AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM s WINDOW w AS (PARTITION BY query_id)),
nv AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM v WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(ns.query_id, nv.query_id) AS query_id, coalesce(ns.chunk_id, nv.chunk_id) AS chunk_id, 0.4::DOUBLE * coalesce(ns.x, 0) + 0.6::DOUBLE * coalesce(nv.x, 0) AS score FROM ns FULL JOIN nv ON ns.query_id = nv.query_id AND ns.chunk_id = nv.chunk_id)""") + f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 20")
def weighted_fusion(s, d):
    return rounded(retrieve.fuse("weighted", *_arm_pair(s, d)), "score")


_FILTER = """(r.year_min IS NULL OR coalesce(c.year >= r.year_min, false)) AND (r.year_max IS NULL OR coalesce(c.year <= r.year_max, false))
  AND (r.sections IS NULL OR coalesce(list_contains(r.sections, c.section), false)) AND (r.venue_is IS NULL OR coalesce(lower(c.venue) = lower(r.venue_is), false))"""


@query("metadata_filter_topk", with_views("requests", "chunks", "vectors", more=_COSINE + f""", kept AS (SELECT x.* FROM cosine x JOIN chunks c USING (chunk_id) JOIN requests r USING (query_id) WHERE {_FILTER})""") + f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM kept) WHERE rank <= 5")
def metadata_filter_topk(s, d):
    return rounded(retrieve.filtered_cosine(X.requests(s, d), X.vectors(s, d), X.chunks(s, d)), "score")


@query("hybrid_search", with_views("requests", "chunks", "vectors", more=_RRF + f""", kept AS (SELECT x.*, c.year, c.section, c.venue FROM rrf x JOIN chunks c USING (chunk_id) JOIN requests r USING (query_id) WHERE {_FILTER})""") + f"SELECT query_id, chunk_id, round(score, 8) AS score, bm25_rank, vector_rank, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, year, section, venue, rank FROM (SELECT *, {_RANK} AS rank FROM kept) WHERE rank <= 5")
def hybrid_search(s, d):
    found = retrieve.hybrid_search(X.requests(s, d), X.chunks(s, d), retrieve.sparse_index(X.chunks(s, d), persist=True), X.vectors(s, d))
    return rounded(found.drop("arms").withColumn("score", F.round("score", 8)), "bm25_score", "vector_score")


def _backends(s, d):
    """All results, and those in English from another backend with other scores."""
    rows = X.results(s, d).withColumn("score", 1 / F.col("rank")).drop("rank")
    english = rows.join(X.chunks(s, d).where("section = 'en'").select("chunk_id"), "chunk_id", "left_semi")
    return rows.withColumn("origin", F.lit("a")), english.select("query_id", "chunk_id", (F.col("score") / 2).alias("score"), F.lit("b").alias("origin"))


@query("union_backends", with_views("results", more=f"""a AS (SELECT query_id, chunk_id, 1 / rank AS score, 'a' AS origin FROM results), b AS (SELECT query_id, chunk_id, score / 2 AS score, 'b' AS origin FROM a WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY origin DESC, score DESC) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b))""") + f"SELECT query_id, chunk_id, round(score, 6) AS score, origin, rank FROM (SELECT *, {_RANK} AS rank FROM u WHERE r = 1) WHERE rank <= 10")
def union_backends(s, d):
    a, b = (x.groupBy("query_id", "chunk_id", "origin").agg(F.max("score").alias("score")) for x in _backends(s, d))
    return rounded(retrieve.union_backends(a, b, 10).select("query_id", "chunk_id", "score", "origin", "rank"), "score")


@query("pool_union", with_views("results", "requests", "vectors", more=_COSINE + f""", c AS (SELECT query_id, chunk_id FROM (SELECT *, {_RANK} AS rank FROM cosine) WHERE rank <= 10),
p AS (SELECT query_id, chunk_id, 'read' AS source FROM results UNION ALL SELECT *, 'vector' FROM c UNION ALL SELECT query_id, chunk_id, 'bm25' FROM results WHERE rank <= 5)""") + "SELECT query_id, chunk_id, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM p GROUP BY 1, 2")
def pool_union(s, d):
    read = X.results(s, d)
    dense = retrieve.cosine_top(X.requests(s, d), X.vectors(s, d), 10)
    return retrieve.pool_union(read=read, vector=dense, bm25=read.where("rank <= 5")).select("query_id", "chunk_id", F.array_join("sources", "+").alias("sources"))


@query("evidence_merge", with_views("results", more=f"""e AS (SELECT query_id, chunk_id, rank, chunk_id % 3 AS round, md5(array_to_string({X.TOKENS.format('text')}, ' ')) AS fingerprint FROM results JOIN documents ON doc_id = chunk_id),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round, rank, chunk_id) AS r FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY round, rank, chunk_id) AS r2 FROM a WHERE r = 1)""") + "SELECT query_id, chunk_id, round, rank, fingerprint FROM b WHERE r2 = 1")
def evidence_merge(s, d):
    texts = X.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5(T.fingerprint("text")).alias("fingerprint"))
    rounds = X.results(s, d).join(texts, "chunk_id").withColumn("round", F.col("chunk_id") % 3)
    return retrieve.evidence_merge(rounds).select("query_id", "chunk_id", "round", "rank", "fingerprint")


@query("section_read", with_views("chunks") + "SELECT chunk_id, paper, section, row_number() OVER (PARTITION BY paper, lower(section) ORDER BY coalesce(char_start, 0), chunk_id) AS position FROM (SELECT *, venue AS paper FROM chunks)")
def section_read(s, d):
    return retrieve.section_read(X.chunks(s, d).withColumn("paper_id", F.col("venue"))).select("chunk_id", F.col("paper_id").alias("paper"), "section", "position")


@query("baseline_rerank", with_views("results") + "SELECT query_id, chunk_id, rank, round(1 / rank, 6) AS rerank_score FROM results")
def baseline_rerank(s, d):
    return rounded(retrieve.baseline_rerank(X.results(s, d)), "rerank_score")


@query("query_novelty", f"""WITH q AS (SELECT doc_id AS query_id, doc_id AS seq, source AS session, list_distinct({X.TOKENS.format('text')}) AS t FROM documents),
w AS (SELECT session, query_id, seq, len(t) AS n, unnest(t) AS w FROM q), p AS (SELECT a.query_id, a.n, b.n AS m, b.query_id AS old, count(*) AS c FROM w a JOIN w b ON a.session = b.session AND a.w = b.w AND b.seq < a.seq GROUP BY 1, 2, 3, 4)
SELECT query_id, len(t) > 0 AND query_id NOT IN (SELECT query_id FROM p WHERE c / (n + m - c) >= 0.8) AS novel FROM q""")
def query_novelty(s, d):
    rows = X.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("seq"), F.col("source").alias("session"), T.words("text").alias("tokens"))
    return policy.novel_queries(rows).select("query_id", "novel")


# --- metrics --------------------------------------------------------------------------

_JUDGED = """
j AS (SELECT r.query_id, r.chunk_id, r.rank, coalesce(l.grade, 0) AS grade FROM results r LEFT JOIN qrels l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id),
agg AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1) END) AS dcg, min(CASE WHEN grade >= 2 THEN rank END) AS fg, count(DISTINCT CASE WHEN grade >= 2 AND rank <= 20 THEN chunk_id END) AS found,
  count(CASE WHEN grade >= 2 AND rank <= 5 THEN 1 END) AS cg, count(CASE WHEN rank <= 5 THEN 1 END) AS c FROM j GROUP BY 1),
best AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(b + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS b FROM qrels WHERE grade > 0) WHERE b <= 5 GROUP BY 1),
want AS (SELECT query_id, count(DISTINCT chunk_id) AS wanted FROM qrels WHERE grade >= 2 GROUP BY 1),
per AS (SELECT item_id AS query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END AS ndcg_at_5, CASE WHEN wanted > 0 THEN coalesce(1 / fg, 0) END AS mrr, CASE WHEN wanted > 0 THEN coalesce(found, 0) / wanted END AS recall_at_20,
  CASE WHEN wanted > 0 THEN coalesce(cg / nullif(c, 0), 0) END AS retrieval_citation_precision FROM benchmark LEFT JOIN agg ON item_id = agg.query_id LEFT JOIN best ON item_id = best.query_id LEFT JOIN want ON item_id = want.query_id)"""


def _per(s, d):
    return metrics.per_query(X.table(s, d, "benchmark").select(F.col("item_id").alias("query_id")), X.results(s, d), X.qrels(s, d))


def _metric(name: str):
    @query(name, with_views("results", "qrels", more=_JUDGED) + f"SELECT query_id, round({name}, 6) AS {name} FROM per")
    def one(s, d):
        return rounded(_per(s, d).select("query_id", name), name)


for _name in metrics.metric_names().values():
    _metric(_name)


@query("eval_summary", with_views("results", "qrels", more=_JUDGED) + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, count({m}) AS n, count(*) AS n_queries FROM per" for m in metrics.metric_names().values()))
def eval_summary(s, d):
    return rounded(metrics.summary(_per(s, d)), "mean")


@query("failure_breakdown", with_views("results", "qrels", more=_JUDGED) + "SELECT CASE WHEN recall_at_20 IS NULL THEN 'unscored' WHEN recall_at_20 = 0 THEN 'recall' WHEN ndcg_at_5 < 0.4 THEN 'ranking' ELSE 'none' END AS failure, count(*) AS n FROM per GROUP BY 1")
def failure_breakdown(s, d):
    return metrics.failure_breakdown(_per(s, d))


@query("metrics_by_group", with_views("results", "qrels", more=_JUDGED) + "SELECT query_id % 3 AS shape, round(avg(ndcg_at_5), 6) AS ndcg_at_5, round(avg(mrr), 6) AS mrr, round(avg(recall_at_20), 6) AS recall_at_20, round(avg(retrieval_citation_precision), 6) AS retrieval_citation_precision, count(*) AS n FROM per GROUP BY 1")
def metrics_by_group(s, d):
    shapes = X.table(s, d, "benchmark").selectExpr("item_id as query_id", "item_id % 3 as shape")
    return rounded(metrics.by_group(_per(s, d), shapes, "shape"), *metrics.metric_names().values())


@query("context_recall", with_views("results", "qrels") + "SELECT item_id AS query_id, round(coalesce((SELECT count(CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.query_id = q.query_id AND r.chunk_id = q.chunk_id) THEN 1 END) / nullif(count(*), 0) FROM qrels q WHERE q.query_id = item_id AND grade > 0), 1), 6) AS context_recall FROM benchmark")
def context_recall(s, d):
    q = X.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return rounded(metrics.context_recall(X.results(s, d), X.qrels(s, d), q), "context_recall")


@query("claim_attribution", with_views("drafts", "claims") + "SELECT draft_id, round(coalesce(count(CASE WHEN cited AND supported THEN 1 END) / nullif(count(CASE WHEN cited THEN 1 END), 0), 0), 6) AS claim_citation_precision, round(count(CASE WHEN cited THEN 1 END) / count(*), 6) AS coverage, count(*) AS n_claims FROM claims GROUP BY 1")
def claim_attribution(s, d):
    return rounded(metrics.claim_attribution(X.claims(s, d)), "claim_citation_precision", "coverage")


@query("abstention_scores", "WITH c AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), x AS (SELECT count(CASE WHEN NOT a AND b THEN 1 END) AS ra, count(CASE WHEN NOT a AND NOT b THEN 1 END) AS ma, count(CASE WHEN a AND b THEN 1 END) AS oa, count(CASE WHEN a AND NOT b THEN 1 END) AS an FROM c) SELECT ra AS right_abstentions, ma AS missed_abstentions, oa AS over_abstentions, an AS answered, round(coalesce(ra / nullif(ra + ma, 0), 0), 6) AS recall, round(coalesce(ra / nullif(ra + oa, 0), 0), 6) AS precision, round(coalesce(oa / nullif(oa + an, 0), 0), 6) AS over_abstention_rate FROM x")
def abstention_scores(s, d):
    rows = X.table(s, d, "labels").selectExpr("quality = 1 as answerable", "toxic = 1 as abstained")
    return rounded(metrics.abstention(rows), "recall", "precision", "over_abstention_rate")


@query("claim_granularity", with_views("drafts") + f"SELECT draft_id, round(len(claims) / greatest(len(claims), 1), 6) AS claims_per_sentence, round(coalesce(list_sum(list_transform(claims, lambda c: len({X.TOKENS.format('c')}))) / nullif(len(claims), 0), 0), 6) AS words_per_claim FROM drafts")
def claim_granularity(s, d):
    return rounded(metrics.claim_granularity(X.drafts(s, d)), "claims_per_sentence", "words_per_claim")


@query("granularity_sweep", "SELECT \"level\", round(mean, 6) AS mean, n FROM (SELECT \"level\", avg(score) AS mean, count(*) AS n FROM (SELECT unnest(['draft', 'fine', 'whole']) AS \"level\", unnest([value, value * 2 - 30, 50 - value / 2]) AS score FROM events) GROUP BY 1) ORDER BY mean DESC, \"level\" LIMIT 1")
def granularity_sweep(s, d):
    return rounded(metrics.best_level(X.table(s, d, "events").selectExpr("stack(3, 'draft', value, 'fine', value * 2 - 30, 'whole', 50 - value / 2) as (level, score)")), "mean")


@query("answer_relevance", with_views("verdicts") + "SELECT round(avg(grade) / 3, 6) AS answer_relevance FROM verdicts")
def answer_relevance(s, d):
    return rounded(metrics.answer_relevance(X.verdicts(s, d)), "answer_relevance")


_RUNS = """g AS (SELECT run_id, count(*) AS n, count(CASE WHEN route = 'rewrite' THEN 1 END) AS rw, count(CASE WHEN route = 're_retrieve' THEN 1 END) AS rr, count(CASE WHEN route = 'escalate' THEN 1 END) AS es, count(CASE WHEN route = 'abstain' THEN 1 END) AS ab, arg_max(route, seq) AS last FROM steps GROUP BY 1)"""


@query("trajectory_metrics", with_views("steps", more=_RUNS) + "SELECT count(*) AS n_runs, round(avg(n), 6) AS mean_steps, round(avg(rw), 6) AS mean_rewrites, round(avg(rr), 6) AS mean_re_retrievals, round(count(CASE WHEN last = 'accept' AND rw + rr = 0 THEN 1 END) / count(*), 6) AS first_pass_accept_rate, round(sum(es) / count(*), 6) AS escalation_rate, round(sum(ab) / count(*), 6) AS abstention_rate FROM g")
def trajectory_metrics(s, d):
    one = metrics.trajectory_metrics(X.steps(s, d).withColumn("step", F.col("seq")))
    return rounded(one, *[c for c in one.columns if c != "n_runs"])


@query("trigger_rates", with_views("steps") + "SELECT trigger, round(count(*) / (SELECT count(DISTINCT run_id) FROM steps), 6) AS per_run FROM steps GROUP BY 1")
def trigger_rates(s, d):
    return rounded(metrics.trigger_rates(X.steps(s, d)), "per_run")


@query("retrieval_gain", "SELECT query_id, round, round(value - lag(value) OVER (PARTITION BY query_id ORDER BY round), 6) AS gain FROM (SELECT user_id AS query_id, event_id AS round, value FROM events)")
def retrieval_gain(s, d):
    rows = metrics.retrieval_gain(X.table(s, d, "events").selectExpr("user_id as query_id", "event_id as round", "value"))
    return rounded(rows.select("query_id", "round", "gain"), "gain")


@query("span_percentiles", "SELECT event_type AS kind, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY 1")
def span_percentiles(s, d):
    return rounded(metrics.span_percentiles(X.table(s, d, "events").selectExpr("event_type as kind", "value as ms")), "p50", "p95", "p99")


# --- agreement and calibration --------------------------------------------------------

_CELLS = "SELECT quality AS human, toxic AS judge, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2"


def _raters(s, d):
    return X.table(s, d, "labels").selectExpr("quality as human", "toxic as judge")


@query("kappa_matrix", _CELLS)
def kappa_matrix(s, d):
    return agreement.confusion(_raters(s, d))


_KAPPA = f"""WITH c AS ({_CELLS}), t AS (SELECT sum(n) AS total, sum(CASE WHEN human = judge THEN n ELSE 0 END) AS same FROM c),
m AS (SELECT label, sum(h) AS h, sum(j) AS j FROM (SELECT human AS label, n AS h, 0 AS j FROM c UNION ALL SELECT judge, 0, n FROM c) GROUP BY 1),
e AS (SELECT total, same / total AS observed, sum(h * j) / (total * total) AS expected, max(h) / total AS prevalence FROM m, t GROUP BY total, same),
k AS (SELECT *, CASE WHEN expected >= 1 THEN 1 ELSE (observed - expected) / (1 - expected) END AS kappa FROM e)
"""


@query("cohen_kappa", _KAPPA + "SELECT total::BIGINT AS total, round(observed, 6) AS observed, round(expected, 6) AS expected, round(kappa, 6) AS kappa, prevalence > 0.8 AS degenerate, CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band, CASE WHEN total < 30 THEN 'refused' WHEN kappa >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM k")
def cohen_kappa(s, d):
    return rounded(agreement.tripwire(agreement.kappa(_raters(s, d))), "observed", "expected", "kappa")


@query("worst_disagreements", f"SELECT * FROM ({_CELLS}) WHERE human <> judge ORDER BY n DESC, human, judge LIMIT 5")
def worst_disagreements(s, d):
    return agreement.disagreements(_raters(s, d))


@query("krippendorff_alpha", "WITH r AS (SELECT doc_id AS item, quality AS rating FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 2)::INT END FROM labels), c AS (SELECT item, rating, count(*) AS c FROM r WHERE rating IS NOT NULL GROUP BY 1, 2), u AS (SELECT item, sum(c) AS m, sum(c * (c - 1)) AS a FROM c GROUP BY 1 HAVING sum(c) >= 2), n AS (SELECT sum(m) AS n, sum(a / (m - 1)) / sum(m) AS o FROM u), x AS (SELECT sum(nc * (nc - 1)) AS p FROM (SELECT rating, sum(c) AS nc FROM c WHERE item IN (SELECT item FROM u) GROUP BY 1)) SELECT n::BIGINT AS n, round(o, 6) AS observed, round(p / (n * (n - 1)), 6) AS expected, round((o - p / (n * (n - 1))) / (1 - p / (n * (n - 1))), 6) AS alpha FROM n, x")
def krippendorff_alpha(s, d):
    rows = X.table(s, d, "labels").selectExpr("doc_id as item", "stack(3, 'q', quality, 't', toxic, 'x', case when doc_id % 3 > 0 then cast(doc_id % 2 as int) end) as (annotator, rating)")
    return rounded(agreement.krippendorff(rows), "observed", "expected", "alpha")


@query("temperature_fit", with_views("confidences", more="l AS (SELECT correct, ln(c / (1 - c)) AS x FROM (SELECT correct, greatest(least(confidence, 1 - 1e-6), 1e-6) AS c FROM confidences)), g AS (SELECT i * 10.0::DOUBLE / 200 AS t FROM (SELECT unnest(range(1, 201)) AS i)), p AS (SELECT t, correct, greatest(least(1 / (1 + exp(-x / t)), 1 - 1e-9), 1e-9) AS p FROM l, g), s AS (SELECT t, avg(CASE WHEN correct THEN -ln(p) ELSE -ln(1 - p) END) AS nll FROM p GROUP BY 1)") + "SELECT t, round(nll, 6) AS nll FROM s ORDER BY round(nll, 12), t LIMIT 1")
def temperature_fit(s, d):
    return rounded(agreement.temperature(X.confidences(s, d)), "nll")


_BINS = "b AS (SELECT i::INT AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM (SELECT unnest(range(10)) AS i)), f AS (SELECT bin, lo, hi, count(confidence) AS n, coalesce(avg(confidence), 0) AS mean_confidence, coalesce(count(CASE WHEN correct THEN 1 END) / nullif(count(confidence), 0), 0) AS accuracy FROM b LEFT JOIN confidences ON confidence >= lo AND (confidence < hi OR (bin = 9 AND confidence <= 1)) GROUP BY 1, 2, 3)"


@query("reliability_bins", with_views("confidences", more=_BINS) + "SELECT bin, lo, hi, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM f")
def reliability_bins(s, d):
    return rounded(agreement.reliability(X.confidences(s, d)), "mean_confidence", "accuracy")


@query("calibration_error", with_views("confidences", more=_BINS) + "SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM f")
def calibration_error(s, d):
    return rounded(agreement.calibration_error(agreement.reliability(X.confidences(s, d))), "ece")


@query("escalation_threshold", with_views("confidences", more="t AS (SELECT DISTINCT round_even(confidence, 2) AS t FROM confidences), p AS (SELECT t, count(CASE WHEN correct THEN 1 END) / count(*) AS p FROM confidences JOIN t ON confidence >= t GROUP BY 1)") + "SELECT min(CASE WHEN p >= 0.8 THEN t END) AS threshold FROM p")
def escalation_threshold(s, d):
    return agreement.escalation_threshold(X.confidences(s, d), 0.8)


@query("judgement_stability", "SELECT user_id AS item, count(DISTINCT event_type) = 1 AS stable, count(*) AS n FROM events GROUP BY 1")
def judgement_stability(s, d):
    return agreement.stability(X.table(s, d, "events").selectExpr("user_id as item", "event_type as label"))


# --- verdicts -------------------------------------------------------------------------


@query("stub_judge", "SELECT doc_id, (h % 4)::INT AS grade, round(0.5 + (h % 50) / 100, 2) AS confidence FROM (SELECT doc_id, concat('0x', substr(sha256(concat('judge', text)), 1, 8))::BIGINT AS h FROM documents)")
def stub_judge(s, d):
    p = F.concat(F.lit("judge"), "text")
    return X.table(s, d, "documents").select("doc_id", judge.stub_grade(p).alias("grade"), judge.stub_confidence(p).alias("confidence"))


_VOTES = "votes AS (SELECT doc_id // 5 AS draft_id, doc_id AS member, quality = 1 AS passed, (doc_id % 17) / 16.0::DOUBLE AS citation_precision, (doc_id % 11) / 10.0::DOUBLE AS coverage, (doc_id % 7) / 6.0::DOUBLE AS confidence FROM labels)"


def _votes(s, d):
    return X.table(s, d, "labels").selectExpr("doc_id div 5 as draft_id", "doc_id as member", "quality = 1 as passed", "(doc_id % 17) / 16D as citation_precision", "(doc_id % 11) / 10D as coverage", "(doc_id % 7) / 6D as confidence")


@query("panel_vote", f"WITH {_VOTES} SELECT draft_id, count(CASE WHEN passed THEN 1 END) * 2 > count(*) AS passed, round(quantile_cont(citation_precision, 0.5), 6) AS citation_precision, round(quantile_cont(coverage, 0.5), 6) AS coverage, round(avg(confidence) * abs(2 * count(CASE WHEN passed THEN 1 END) - count(*)) / count(*), 6) AS confidence, count(*) AS members FROM votes GROUP BY 1")
def panel_vote(s, d):
    return rounded(judge.panel(_votes(s, d)), "citation_precision", "coverage", "confidence")


@query("panel_violations", "SELECT draft_id, kind, claim, min(member) AS member FROM (SELECT user_id % 50 AS draft_id, event_id AS member, event_type AS kind, user_id % 7 AS claim FROM events) GROUP BY 1, 2, 3")
def panel_violations(s, d):
    rows = X.table(s, d, "events").selectExpr("user_id % 50 as draft_id", "event_id as member", "event_type as kind", "user_id % 7 as claim")
    return judge.panel_violations(rows).select("draft_id", "kind", "claim", "member")


_KINDS = (*judge.SHALLOW, *judge.DEEP, "other")
_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


@query("pass_rule", f"WITH {_VOTES}, v AS (SELECT *, CASE WHEN member % 4 = 0 THEN {_KIND_LIST}[(member % 7 + 1)::INT] END AS kind, member % 9 = 0 AS major FROM votes) SELECT member, coalesce(CASE WHEN kind IN ('missing_citation', 'overstated_certainty', 'misattributed_citation') THEN 'shallow' WHEN kind IN ('unsupported_claim', 'inferential_leap', 'contradicts_source') THEN 'deep' WHEN kind IS NOT NULL THEN 'unclassified' END, 'none') AS depth, (kind IS NULL OR kind NOT IN ('unsupported_claim', 'inferential_leap', 'contradicts_source')) AND NOT major AND citation_precision >= 0.95 AND coverage >= 0.80 AS passed FROM v")
def pass_rule(s, d):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    rows = _votes(s, d).withColumn("kind", F.when(F.col("member") % 4 == 0, F.element_at(kinds, (F.col("member") % 7 + 1).cast("int")))).withColumn("major", (F.col("member") % 9 == 0).cast("int"))
    depth = F.when(F.col("kind").isNull(), "none").otherwise(judge.depth(F.col("kind")))
    deep = (depth == "deep").cast("int")
    return rows.select("member", depth.alias("depth"), judge.passes(F.col("citation_precision"), F.col("coverage"), deep, F.col("major")).alias("passed"))


@query("claim_grounding", with_views("drafts", "claims", more="evidence AS (SELECT DISTINCT draft_id, nth % 4 AS chunk_id FROM claims)") + "SELECT c.draft_id, nth, contains(text, claim) AS verbatim, e.chunk_id IS NOT NULL AS cites_evidence FROM claims c LEFT JOIN evidence e ON e.draft_id = c.draft_id AND e.chunk_id = c.nth % 6")
def claim_grounding(s, d):
    rows = X.claims(s, d)
    evidence = rows.selectExpr("draft_id", "nth % 4 as chunk_id")
    asked = rows.selectExpr("draft_id", "text as draft", "nth", "claim", "nth % 6 as chunk_id")
    # a claim may stand twice in a draft: its number keeps the rows apart
    found = judge.claim_grounding(asked.withColumn("claim", F.struct("nth", "claim")), evidence, claim_text=F.col("claim.claim"))
    return found.select("draft_id", F.col("claim.nth").cast("long").alias("nth"), "verbatim", "cites_evidence")


@query("evidence_triage", "WITH a AS (SELECT doc_id, doc_id % 5 AS n, ['sufficient', 'partial', 'conflicting', 'insufficient', 'strange'][(doc_id % 5 + 1)::INT] AS label, (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 8 = 0 AS failed, doc_id % 6 = 0 AS conflict, doc_id % 12 = 0 AS known FROM documents), s AS (SELECT *, CASE WHEN label = 'strange' THEN 'partial' ELSE label END AS said FROM a) SELECT doc_id, CASE WHEN n = 0 THEN 'insufficient' WHEN failed THEN 'partial' WHEN conflict AND known AND said <> 'insufficient' THEN 'conflicting' ELSE said END AS label, CASE WHEN n = 0 THEN 1.0 WHEN failed THEN 0.0 ELSE confidence END AS confidence FROM s")
def evidence_triage(s, d):
    rows = X.table(s, d, "documents").selectExpr(
        "doc_id", "doc_id % 5 as n_evidence", "element_at(array('sufficient', 'partial', 'conflicting', 'insufficient', 'strange'), cast(doc_id % 5 + 1 as int)) as label",
        "(doc_id % 10) / 10D as confidence", "doc_id % 8 = 0 as failed",
        "case when doc_id % 6 = 0 then array(named_struct('kind', 'disagree', 'chunk_ids', array('a', 'b'))) else array() end as conflicts",
        "case when doc_id % 12 = 0 then array('a', 'b', 'c') else array('a') end as known",
    )
    return judge.triage(rows).select("doc_id", "label", "confidence")


# --- preference data ------------------------------------------------------------------

_PAIRS = """v AS (SELECT DISTINCT regexp_replace(lower(trim(query)), '\\s+', ' ', 'g') AS nq, chunk_id, grade FROM verdicts),
o AS (SELECT *, row_number() OVER (PARTITION BY nq ORDER BY grade DESC, chunk_id) AS pos FROM v)"""


def _sql_pairs(gap: int) -> str:
    return f"(SELECT * FROM (SELECT a.nq, a.chunk_id AS chosen, b.chunk_id AS rejected, a.grade - b.grade AS margin, row_number() OVER (PARTITION BY a.nq ORDER BY a.pos, b.pos) AS nth FROM o a JOIN o b ON a.nq = b.nq AND a.pos < b.pos AND a.grade - b.grade >= {gap}) WHERE nth <= 4)"


@query("preference_pairs", with_views("verdicts", more=_PAIRS) + f"SELECT nq, chosen, rejected, margin, nth FROM {_sql_pairs(1)}")
def preference_pairs(s, d):
    return pairs.preference_pairs(X.verdicts(s, d)).select("nq", "chosen", "rejected", "margin", "nth")


@query("pair_yield_sweep", with_views("verdicts", more=_PAIRS + ", y AS (" + " UNION ALL ".join(f"SELECT {g} AS gap, count(*) AS pairs, count(DISTINCT nq) AS queries FROM {_sql_pairs(g)}" for g in (1, 2, 3)) + ")") + "SELECT gap, pairs, queries, round(coalesce(pairs / nullif((SELECT pairs FROM y WHERE gap = 1), 0), 0), 6) AS share_of_first FROM y")
def pair_yield_sweep(s, d):
    return rounded(pairs.yield_sweep(X.verdicts(s, d)), "share_of_first")


@query("pair_summary", with_views("verdicts", more=_PAIRS) + f"SELECT margin, count(*) AS pairs, count(DISTINCT nq) AS queries FROM {_sql_pairs(1)} GROUP BY 1")
def pair_summary(s, d):
    return pairs.pair_summary(pairs.preference_pairs(X.verdicts(s, d)))


@query("leakage_guard", "WITH t AS (SELECT DISTINCT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS nq FROM conversations), e AS (SELECT DISTINCT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS nq FROM conversations WHERE role = 'user') SELECT md5(nq) AS digest FROM t WHERE nq IN (SELECT nq FROM e)")
def leakage_guard(s, d):
    turns = X.table(s, d, "conversations").withColumnRenamed("text", "query")
    return pairs.leaked(turns, turns.where("role = 'user'")).select(F.md5("nq").alias("digest"))


@query("train_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('0:', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r <= CASE WHEN n <= 1 THEN 0 ELSE greatest(1, floor(n * 0.1)) END AS held_out FROM r")
def train_split(s, d):
    return pairs.train_split(X.table(s, d, "documents").select("doc_id"), "doc_id")


# --- labels ---------------------------------------------------------------------------


@query("eval_constraints", with_views("qrels") + "SELECT 'duplicate_query' AS rule, (SELECT count(*) FROM (SELECT item_id FROM benchmark GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'orphan_qrel', (SELECT count(*) FROM qrels WHERE query_id NOT IN (SELECT item_id FROM benchmark)) UNION ALL SELECT 'duplicate_qrel', (SELECT count(*) FROM (SELECT query_id, chunk_id FROM qrels GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'no_positive', (SELECT count(DISTINCT item_id) FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM qrels WHERE grade > 0)) UNION ALL SELECT 'bad_grade', (SELECT count(*) FROM qrels WHERE grade IS NULL OR grade NOT BETWEEN 0 AND 3)")
def eval_constraints(s, d):
    return labels.constraint_counts(X.table(s, d, "benchmark").select(F.col("item_id").alias("query_id")), X.qrels(s, d))


#: labels of English chunks are reviewed, by their source; those of longer chunks are frozen already
_POOL = """pool AS (SELECT query_id, chunk_id, CASE WHEN n_chars % 5 = 0 THEN (grade + 1) % 4 ELSE grade END AS grade, coalesce(lang = 'en', false) AS reviewed, source AS reviewer FROM qrels JOIN documents ON doc_id = chunk_id),
frozen AS (SELECT query_id, chunk_id, grade FROM qrels JOIN documents ON doc_id = chunk_id WHERE n_chars > 500)"""


def _pool(s, d):
    q = X.qrels(s, d).join(X.table(s, d, "documents").selectExpr("doc_id as chunk_id", "lang", "source", "n_chars"), "chunk_id")
    pool = q.selectExpr("query_id", "chunk_id", "case when n_chars % 5 = 0 then (grade + 1) % 4 else grade end as grade", "coalesce(lang = 'en', false) as reviewed", "source as reviewer")
    return pool, q.where("n_chars > 500").select("query_id", "chunk_id", "grade")


@query("qrel_promotion", with_views("qrels", more=_POOL) + "SELECT p.query_id, p.chunk_id, p.grade, f.grade AS old_grade, CASE WHEN f.grade IS NULL THEN 'new' WHEN f.grade <> p.grade THEN 'changed' ELSE 'unchanged' END AS change FROM pool p LEFT JOIN frozen f ON p.query_id = f.query_id AND p.chunk_id = f.chunk_id WHERE reviewed AND reviewer IS NOT NULL")
def qrel_promotion(s, d):
    return labels.promote(*_pool(s, d)).select("query_id", "chunk_id", "grade", "old_grade", "change")


@query("merged_labels", with_views("qrels", more=_POOL) + "SELECT query_id, chunk_id, arg_max(grade, age) AS grade FROM (SELECT query_id, chunk_id, grade, 0 AS age FROM frozen UNION ALL SELECT query_id, chunk_id, grade, 1 FROM pool WHERE reviewed AND reviewer IS NOT NULL) GROUP BY 1, 2")
def merged_labels(s, d):
    pool, frozen = _pool(s, d)
    return labels.merged_labels(frozen, labels.promote(pool, frozen))


@query("pool_grades", with_views("qrels") + "SELECT *, CASE WHEN grade_3 = 0 THEN 'NO_GRADE3' WHEN grade_3 > 8 THEN 'BROAD' ELSE '' END AS flag FROM (SELECT query_id, count(CASE WHEN grade = 0 THEN 1 END) AS grade_0, count(CASE WHEN grade = 1 THEN 1 END) AS grade_1, count(CASE WHEN grade = 2 THEN 1 END) AS grade_2, count(CASE WHEN grade = 3 THEN 1 END) AS grade_3 FROM qrels GROUP BY 1)")
def pool_grades(s, d):
    return labels.pool_grades(X.qrels(s, d))


@query("simulated_labels", with_views("qrels", more="sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat(query_id, ':', chunk_id)), chunk_id) AS nth FROM qrels WHERE grade = 1), j AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat(query_id, ':', chunk_id)), chunk_id) AS nth FROM qrels WHERE grade >= 2)") + "SELECT q.query_id, q.chunk_id, coalesce(j.grade, q.grade) AS grade FROM qrels q LEFT JOIN sl ON sl.query_id = q.query_id AND sl.chunk_id = q.chunk_id LEFT JOIN j ON j.query_id = sl.query_id AND j.nth = sl.nth")
def simulated_labels(s, d):
    q = X.qrels(s, d)
    return labels.simulated(q.withColumnRenamed("grade", "draft_grade"), q.where("grade >= 2")).select("query_id", "chunk_id", "grade")


@query("split_hygiene", "SELECT md5(nq) AS digest, splits FROM (SELECT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS nq, count(DISTINCT source) AS splits FROM documents GROUP BY 1) WHERE splits > 1")
def split_hygiene(s, d):
    rows = labels.split_hygiene(X.table(s, d, "documents").selectExpr("text as query", "source as split"))
    return rows.select(F.md5("nq").alias("digest"), "splits")


# --- gate -----------------------------------------------------------------------------

_BOOT = """n AS (SELECT metric, count(*) AS n, avg(baseline) AS bm, avg(candidate) AS cm, avg(diff) AS od FROM runs GROUP BY 1),
sl AS (SELECT metric, diff, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS slot FROM runs),
co AS (SELECT metric, r, concat('0x', substr(h, 1, 8))::BIGINT % 2147483647 AS c0, concat('0x', substr(h, 9, 8))::BIGINT % 2147483647 AS c1, concat('0x', substr(h, 17, 8))::BIGINT % 2147483647 AS c2, concat('0x', substr(h, 25, 8))::BIGINT % 2147483647 AS c3 FROM (SELECT metric, r, md5(concat('0:', metric, ':', r)) AS h FROM n, (SELECT unnest(range(1000)) AS r))),
dr AS (SELECT metric, r, (((c0 * i + c1) % 2147483647 * i + c2) % 2147483647 * i + c3) % 2147483647 % n AS slot FROM (SELECT metric, n, unnest(range(n)) AS i FROM n) JOIN co USING (metric)),
ms AS (SELECT metric, r, avg(diff) AS mean FROM dr JOIN sl USING (metric, slot) GROUP BY 1, 2),
pl AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean) AS nth FROM ms),
bd AS (SELECT metric, max(CASE WHEN nth = round_even(0.025 * 999, 0) + 1 THEN mean END) AS lo, max(CASE WHEN nth = round_even(0.975 * 999, 0) + 1 THEN mean END) AS hi, count(CASE WHEN mean <= 0 THEN 1 END) / 1000 AS below, count(CASE WHEN mean >= 0 THEN 1 END) / 1000 AS above FROM pl GROUP BY 1),
bt AS (SELECT metric, n, bm, cm, od, lo, hi, least(1, greatest(2 * least(below, above), 1 / 1000)) AS p FROM n JOIN bd USING (metric)),
hm AS (SELECT *, bool_and(w) OVER (ORDER BY p, metric ROWS UNBOUNDED PRECEDING) AS significant FROM (SELECT *, row_number() OVER (ORDER BY p, metric) AS rank, p <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1) AS w FROM bt)),
wd AS (SELECT *, CASE WHEN significant THEN lo ELSE least(lo, 0) END AS wl, CASE WHEN significant THEN hi ELSE greatest(hi, 0) END AS wh FROM hm)"""


def _boot(s, d):
    return gate.paired_bootstrap(X.runs(s, d))


@query("paired_bootstrap", with_views("runs", more=_BOOT) + "SELECT metric, n, round(bm, 6) AS baseline_mean, round(cm, 6) AS candidate_mean, round(od, 6) AS observed_diff, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p_value FROM bt")
def paired_bootstrap(s, d):
    return rounded(_boot(s, d), "baseline_mean", "candidate_mean", "observed_diff", "ci_low", "ci_high", "p_value")


@query("paired_bootstrap_exact")
def paired_bootstrap_exact(s, d):
    return gate.paired_bootstrap_exact(X.runs(s, d))


@query("holm", with_views("runs", more=_BOOT) + "SELECT metric, round(p, 6) AS p_value, rank, significant FROM hm")
def holm(s, d):
    return rounded(gate.holm(_boot(s, d)).select("metric", "p_value", "rank", "significant"), "p_value")


@query("gate_decision", with_views("runs", more=_BOOT) + "SELECT count(*) > 0 AND count(CASE WHEN (wl > 0 OR wh < 0) AND od < 0 THEN 1 END) = 0 AND count(CASE WHEN wl > 0 AND wl >= 0.04 THEN 1 END) > 0 AS promote, CASE WHEN count(CASE WHEN (wl > 0 OR wh < 0) AND od < 0 THEN 1 END) > 0 THEN concat('significant regression in ', string_agg(CASE WHEN (wl > 0 OR wh < 0) AND od < 0 THEN metric END, ', ' ORDER BY metric)) WHEN count(CASE WHEN wl > 0 AND wl >= 0.04 THEN 1 END) > 0 THEN concat('significant improvement in ', string_agg(CASE WHEN wl > 0 AND wl >= 0.04 THEN metric END, ', ' ORDER BY metric)) ELSE concat('no metric improved enough; best: ', arg_max(metric, od)) END AS reason FROM wd")
def gate_decision(s, d):
    return gate.decide(gate.widened(gate.holm(_boot(s, d))))


_Z = Z_95 + Z_POWER_80


@query("sensitivity", with_views("runs", more="x AS (SELECT metric, count(*) AS n, stddev_samp(diff) AS sd FROM runs GROUP BY 1)") + f"SELECT metric, n, round(sd, 6) AS sd, round({_Z!r}::DOUBLE * sd / sqrt(n), 6) AS detectable, greatest(2, ceil(({_Z!r}::DOUBLE * {_Z!r}::DOUBLE) * sd * sd / (0.04::DOUBLE * 0.04::DOUBLE)))::BIGINT AS needed, sd = 0 AS identical FROM x")
def sensitivity(s, d):
    return rounded(gate.sensitivity(X.runs(s, d)), "sd", "detectable")


_CHECKS = """v AS (SELECT metric, avg(candidate) AS value, avg(baseline) AS champion FROM runs GROUP BY 1),
t AS (SELECT * FROM (VALUES ('view', 10.0::DOUBLE, 0.5::DOUBLE), ('click', 60.0, 0.02), ('signup', 20.0, NULL), ('unknown', 1.0, 0.1)) AS t(metric, floor, tolerance)),
c AS (SELECT t.metric, v.value, floor, tolerance, champion, greatest(0, floor - value) AS shortfall, value - champion AS delta, CASE WHEN tolerance IS NOT NULL THEN greatest(0, -(value - champion) - tolerance) END AS excess FROM t LEFT JOIN v USING (metric)),
k AS (SELECT metric, value, CASE WHEN value IS NULL THEN NULL ELSE shortfall END AS shortfall, delta, CASE WHEN delta IS NULL THEN NULL ELSE excess END AS excess FROM c)"""


@query("threshold_compare", with_views("runs", more=_CHECKS) + "SELECT metric, round(value, 6) AS value, round(delta, 6) AS delta, concat_ws(', ', CASE WHEN value IS NULL THEN 'missing' END, CASE WHEN shortfall > 0 THEN 'below floor' END, CASE WHEN excess > 0 THEN 'regressed' END) AS reasons, coalesce(value IS NOT NULL AND NOT coalesce(shortfall > 0, false) AND NOT coalesce(excess > 0, false), false) AS passed FROM k")
def threshold_compare(s, d):
    runs = X.runs(s, d)
    floors = s.createDataFrame([("view", 10.0, 0.5), ("click", 60.0, 0.02), ("signup", 20.0, None), ("unknown", 1.0, 0.1)], "metric string, floor double, tolerance double")
    value = lambda c: runs.groupBy("metric").agg(F.avg(c).alias("value"))
    checks = gate.threshold_compare(value("candidate"), floors, value("baseline"))
    return rounded(checks.select("metric", "value", "delta", F.array_join("reasons", ", ").alias("reasons"), "passed"), "value", "delta")


@query("shared_metrics", with_views("runs") + "SELECT DISTINCT metric FROM runs WHERE metric <> 'view'")
def shared_metrics(s, d):
    runs = X.runs(s, d)
    return gate.shared_metrics(runs, runs.where("metric <> 'view'"))


# --- policy ---------------------------------------------------------------------------

_STATE = f"""st AS (SELECT doc_id, doc_id % 14 AS steps_used, doc_id % 5 AS rewrites_used, doc_id % 4 AS re_retrievals_used, 0 AS discoveries_used, (doc_id % 60)::DOUBLE AS cost_spent,
  CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [{_KIND_LIST}[(doc_id % 7 + 1)::INT]] END AS kinds, doc_id % 3 = 0 AND doc_id % 2 = 0 AS passed, (doc_id % 10) / 10.0::DOUBLE AS fc, (doc_id % 9) / 10.0::DOUBLE AS ac,
  CASE WHEN doc_id % 11 > 0 THEN doc_id % 4 END AS relevance, doc_id % 6 > 0 AS evidence_sufficient FROM documents),
fl AS (SELECT *, list_has_any(kinds, ['unsupported_claim', 'inferential_leap', 'contradicts_source']) AS deep, list_contains(kinds, 'other') AS unknown FROM st)"""


@query("route_policy", f"WITH {_STATE}, r AS (SELECT doc_id, CASE WHEN steps_used >= 12 THEN 'escalate step_budget_exhausted' WHEN cost_spent + greatest(0, 3 - rewrites_used) * 1 + greatest(0, 2 - re_retrievals_used) * 4 > 50 THEN 'escalate cost_ceiling' WHEN unknown THEN 'escalate unclassified_violation' WHEN fc < 0.1 THEN 'escalate low_faithfulness_confidence' WHEN relevance IS NOT NULL AND ac < 0.1 THEN 'escalate low_answer_confidence' WHEN relevance IS NOT NULL AND NOT evidence_sufficient THEN 'abstain evidence_insufficient' WHEN NOT passed THEN CASE WHEN len(kinds) = 0 THEN 'escalate unexplained_failure' WHEN deep THEN CASE WHEN re_retrievals_used < 2 THEN 're_retrieve deep_violation' ELSE 'escalate re_retrieval_budget_exhausted' END WHEN rewrites_used < 3 THEN 'rewrite shallow_violation' ELSE 'escalate rewrite_budget_exhausted' END WHEN relevance < 2 THEN CASE WHEN re_retrievals_used < 2 THEN 're_retrieve answer_incomplete' ELSE 'escalate re_retrieval_budget_exhausted' END ELSE 'accept passed' END AS x FROM fl) SELECT doc_id, string_split(x, ' ')[1] AS route, string_split(x, ' ')[2] AS trigger, CASE string_split(x, ' ')[1] WHEN 'accept' THEN 'done' WHEN 'rewrite' THEN 'writer' WHEN 're_retrieve' THEN 'researcher' ELSE 'flag_for_human' END AS node FROM r")
def route_policy(s, d):
    kinds = ", ".join(f"'{k}'" for k in _KINDS)
    rows = X.table(s, d, "documents").selectExpr(
        "doc_id", "doc_id % 14 as steps_used", "doc_id % 5 as rewrites_used", "doc_id % 4 as re_retrievals_used", "0 as discoveries_used", "cast(doc_id % 60 as double) as cost_spent",
        f"case when doc_id % 3 = 0 then cast(array() as array<string>) else array(element_at(array({kinds}), cast(doc_id % 7 + 1 as int))) end as kinds",
        "doc_id % 3 = 0 and doc_id % 2 = 0 as passed", "(doc_id % 10) / 10D as faithfulness_confidence", "(doc_id % 9) / 10D as answer_confidence",
        "case when doc_id % 11 > 0 then doc_id % 4 end as relevance", "doc_id % 6 > 0 as evidence_sufficient",
    )
    routed = rows.select("doc_id", policy.decide_route(0.1, 0.1, cost_aware=True).alias("r")).select("doc_id", "r.route", "r.trigger")
    return routed.withColumn("node", policy.node(F.col("route")))


@query("evidence_policy", "WITH e AS (SELECT doc_id, ['sufficient', 'partial', 'conflicting', 'insufficient'][(doc_id % 4 + 1)::INT] AS label, (doc_id % 10) / 10.0::DOUBLE AS c, doc_id % 13 AS st, doc_id % 3 AS rr, doc_id % 2 AS di FROM documents), r AS (SELECT doc_id, CASE WHEN st >= 12 THEN 'escalate step_budget_exhausted' WHEN c < 0.2 THEN 'write evidence_ok' WHEN label = 'conflicting' THEN 'write evidence_conflicting' WHEN label = 'insufficient' THEN CASE WHEN rr < 2 THEN 're_retrieve evidence_unusable' WHEN di < 1 THEN 'discover live_discovery_attempt' ELSE 'abstain evidence_insufficient' END ELSE 'write evidence_ok' END AS x FROM e) SELECT doc_id, string_split(x, ' ')[1] AS route, string_split(x, ' ')[2] AS trigger FROM r")
def evidence_policy(s, d):
    rows = X.table(s, d, "documents").selectExpr(
        "doc_id", "element_at(array('sufficient', 'partial', 'conflicting', 'insufficient'), cast(doc_id % 4 + 1 as int)) as label", "(doc_id % 10) / 10D as confidence",
        "doc_id % 13 as steps_used", "doc_id % 3 as re_retrievals_used", "doc_id % 2 as discoveries_used",
    )
    return rows.select("doc_id", policy.decide_evidence(0.2, max_discoveries=1).alias("r")).select("doc_id", "r.route", "r.trigger")


@query("budget_running", with_views("steps") + "SELECT run_id, seq, route, row_number() OVER w - 1 AS step, sum(CASE WHEN route = 'rewrite' THEN 1 ELSE 0 END) OVER w::BIGINT AS rewrites_used, sum(CASE WHEN route = 're_retrieve' THEN 1 ELSE 0 END) OVER w::BIGINT AS re_retrievals_used, sum(CASE route WHEN 'rewrite' THEN 1.0::DOUBLE WHEN 're_retrieve' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w AS cost_spent FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def budget_running(s, d):
    return policy.running_budget(X.steps(s, d)).drop("trigger")


@query("handover", with_views("steps") + "SELECT run_id, route, arg_max(trigger, seq) AS trigger, steps, cost, outcome FROM (SELECT run_id, arg_max(route, seq) AS route, count(*) AS steps, sum(CASE route WHEN 'rewrite' THEN 1.0::DOUBLE WHEN 're_retrieve' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS cost, CASE arg_max(route, seq) WHEN 'accept' THEN 'accepted' WHEN 'abstain' THEN 'abstained' WHEN 'escalate' THEN 'escalated' END AS outcome FROM steps GROUP BY 1) JOIN (SELECT run_id, seq, trigger FROM steps) USING (run_id) GROUP BY ALL")
def handover(s, d):
    return policy.handover(X.steps(s, d).withColumnRenamed("seq", "step"))


# --- tools ----------------------------------------------------------------------------


@query("citation_render", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] WHEN doc_id % 2 = 0 THEN ['Ada Lo', 'Bo Ek'] ELSE ['Cy Dee'] END AS a, CASE WHEN doc_id % 13 = 0 THEN 'n.d.' ELSE (2016 + doc_id % 11)::VARCHAR END AS y, source AS venue, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 END AS page, lang AS title FROM documents),
x AS (SELECT *, CASE WHEN len(a) = 0 THEN 'Anon.' ELSE string_split(a[1], ' ')[-1] END AS f, CASE WHEN len(a) = 0 THEN 'Anon.' ELSE array_to_string(a, ', ') END AS all_a, CASE WHEN len(a) = 0 THEN 'Anon.' ELSE array_to_string(a, ' and ') END AS and_a FROM c)
SELECT doc_id, concat('(', f, CASE WHEN len(a) > 1 THEN ' et al.' ELSE '' END, ', ', y, ')') AS inline, concat(all_a, ' (', y, '). ', title, '. ', venue, '.', CASE WHEN page IS NULL THEN '' ELSE concat(' p. ', page, '.') END) AS apa, concat('@article{', lower(f), y, ',', chr(10), '  title  = {', title, '},', chr(10), '  author = {', and_a, '},', chr(10), '  year   = {', y, '},', chr(10), '  note   = {', venue, '}', chr(10), '}') AS bibtex FROM x""")
def citation_render(s, d):
    rows = X.table(s, d, "documents").selectExpr(
        "doc_id", "case when doc_id % 5 = 0 then cast(array() as array<string>) when doc_id % 2 = 0 then array('Ada Lo', 'Bo Ek') else array('Cy Dee') end as authors",
        "case when doc_id % 13 = 0 then null else cast(2016 + doc_id % 11 as int) end as year", "source as venue", "cast(doc_id % 3 as int) as page", "lang as title", "cast(null as string) as source_uri", "cast(doc_id as string) as paper_id",
    )
    return rows.select("doc_id", *[tools.citation(c).alias(c) for c in ("inline", "apa", "bibtex")])


@query("citation_resolve", """WITH d AS (SELECT doc_id AS draft_id, concat('See [', doc_id % 50, '] and [x', doc_id % 3, '], then [', doc_id % 7, '] and [', doc_id % 50, '].') AS t FROM documents), c AS (SELECT draft_id, unnest(range(len(m))) AS pos, unnest(m) AS chunk_id FROM (SELECT draft_id, regexp_extract_all(t, '\\[([A-Za-z0-9_-]+)\\]', 1) AS m FROM d)), o AS (SELECT draft_id, chunk_id, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT draft_id, chunk_id, k.doc_id IS NOT NULL AS found, md5(substr(trim(k.text), 1, 300)) AS quote, row_number() OVER (PARTITION BY draft_id ORDER BY pos) AS nth FROM o LEFT JOIN documents k ON k.doc_id::VARCHAR = o.chunk_id""")
def citation_resolve(s, d):
    docs = X.table(s, d, "documents")
    drafts = docs.selectExpr("doc_id as draft_id", "concat('See [', doc_id % 50, '] and [x', doc_id % 3, '], then [', doc_id % 7, '] and [', doc_id % 50, '].') as text")
    known = docs.selectExpr("cast(doc_id as string) as chunk_id", "doc_id as paper_id", "cast(null as int) as year", "text")
    return tools.resolve_citations(drafts, known).select("draft_id", "chunk_id", "found", F.md5("quote").alias("quote"), "nth")


@query("chunk_lookup", "WITH r AS (SELECT item_id AS request_id, [item_id, item_id + 100000000, item_id * 3] AS ids FROM benchmark), x AS (SELECT request_id, list_filter(ids, lambda i: list_contains(k, i)) AS f, list_filter(ids, lambda i: NOT list_contains(k, i)) AS m FROM r, (SELECT list(doc_id) AS k FROM documents)) SELECT request_id, array_to_string(f, ', ') AS found, array_to_string(m, ', ') AS missing, len(f) > 0 AND len(m) > 0 AS partial FROM x")
def chunk_lookup(s, d):
    asked = X.table(s, d, "benchmark").selectExpr("item_id as request_id", "transform(array(item_id, item_id + 100000000, item_id * 3), x -> cast(x as string)) as chunk_ids")
    found = tools.lookup_chunks(asked, X.table(s, d, "documents").selectExpr("cast(doc_id as string) as chunk_id"))
    return found.select("request_id", F.array_join("found", ", ").alias("found"), F.regexp_replace("error.message", "^unknown chunks: ", "").alias("missing"), "error.partial")


@query("readiness", "SELECT 'documents' AS part, (SELECT count(*) FROM documents) AS rows, 'ok' AS status UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings), 'ok' UNION ALL SELECT 'empty', 0, 'degraded'")
def readiness(s, d):
    docs = X.table(s, d, "documents")
    return tools.readiness({"documents": docs, "embeddings": X.table(s, d, "embeddings"), "empty": docs.where("false")})


@query("prefer_catalogue", "SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN md5(text) ELSE md5(source) END AS digest FROM documents WHERE lang = 'en' OR n_chars > 1000")
def prefer_catalogue(s, d):
    docs = X.table(s, d, "documents")
    sparse = docs.where("lang = 'en'").selectExpr("doc_id as chunk_id", "text")
    store = docs.where("n_chars > 1000").selectExpr("doc_id as chunk_id", "source as text")
    return tools.prefer_catalogue(docs.selectExpr("doc_id as chunk_id"), sparse, store).select("chunk_id", F.md5("text").alias("digest"))


@query("repair_brief", with_views("drafts", "claims") + "SELECT c.draft_id, c.nth, CASE WHEN EXISTS (SELECT 1 FROM claims b WHERE b.draft_id = c.draft_id AND b.claim = c.claim AND NOT b.cited) THEN 'fix' ELSE 'keep' END AS action FROM claims c")
def repair_brief(s, d):
    rows = X.claims(s, d)
    bad = rows.where("not cited").selectExpr("draft_id", "claim", "'missing_citation' as kind")
    return tools.repair_brief(rows.selectExpr("draft_id", "cast(nth as long) as nth", "claim as text"), bad).select("draft_id", "nth", "action")


# --- drafting aids --------------------------------------------------------------------

_SUBJECT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-]+'), lambda w: len(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in drafts.DRAFT_STOP) + ")))"


def _specs(s, d):
    n = X.table(s, d, "documents").selectExpr("count(*) as n")
    return X.table(s, d, "benchmark").crossJoin(F.broadcast(n)).selectExpr("item_id as query_id", "text as query", "array(item_id % n, (item_id * 7 + 3) % n, (item_id * 13 + 5) % n) as targets")


@query("focus_view", f"WITH s AS (SELECT item_id AS query_id, text AS query, unnest([item_id % n, (item_id * 7 + 3) % n, (item_id * 13 + 5) % n]) AS paper_id FROM benchmark, (SELECT count(*) AS n FROM documents)), o AS (SELECT query_id, paper_id, len(list_intersect({_SUBJECT.format('query')}, {_SUBJECT.format('text')})) AS overlap FROM s JOIN documents ON doc_id = paper_id) SELECT DISTINCT query_id, paper_id, paper_id AS chunk_id, overlap::INT AS overlap FROM o")
def focus_view(s, d):
    chunks = X.table(s, d, "documents").selectExpr("doc_id as paper_id", "doc_id as chunk_id", "text")
    return drafts.focus_view(_specs(s, d), chunks).select("query_id", "paper_id", "chunk_id", "overlap").distinct()


@query("focus_sentences", f"""WITH s AS (SELECT item_id AS query_id, text AS query, unnest([item_id % n, (item_id * 7 + 3) % n, (item_id * 13 + 5) % n]) AS paper_id FROM benchmark, (SELECT count(*) AS n FROM documents)),
o AS (SELECT query_id, paper_id, {_SUBJECT.format('query')} AS q, text, row_number() OVER (PARTITION BY query_id, paper_id) AS nth FROM s JOIN documents ON doc_id = paper_id),
e AS (SELECT query_id, paper_id, nth, q, unnest(range(len(ss))) AS i, unnest(ss) AS t FROM (SELECT *, {sql_sentences("regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")} AS ss FROM o)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id, nth ORDER BY len(list_intersect(q, {_SUBJECT.format('t')})) DESC, i) AS place FROM e),
v AS (SELECT query_id, paper_id, nth, string_agg(substr(t, 1, {drafts.QUOTE}), ' ... ' ORDER BY place) AS view FROM r WHERE place <= 2 GROUP BY 1, 2, 3)
SELECT o.query_id, o.paper_id, o.paper_id AS chunk_id, len(list_intersect(q, {_SUBJECT.format('text')}))::INT AS overlap, o.nth, coalesce(view, '') AS view FROM o LEFT JOIN v ON v.query_id = o.query_id AND v.paper_id = o.paper_id AND v.nth = o.nth WHERE o.nth <= 2""")
def focus_sentences(s, d):
    chunks = X.table(s, d, "documents").selectExpr("doc_id as paper_id", "doc_id as chunk_id", "text")
    return drafts.focus_view(_specs(s, d), chunks)


@query("context_window", with_views("results", more="e AS (SELECT query_id, chunk_id, rank, lang AS title, CASE WHEN doc_id % 3 > 0 THEN source END AS section, text, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS nth FROM results JOIN documents ON doc_id = chunk_id)") + "SELECT query_id, md5(string_agg(concat('[', chunk_id, '] (', title, ', ', coalesce(section, 'n/a'), ')', chr(10), text), chr(10) || chr(10) ORDER BY nth)) AS digest FROM e WHERE nth <= 5 GROUP BY 1")
def context_window(s, d):
    texts = X.table(s, d, "documents").selectExpr("doc_id as chunk_id", "lang as title", "case when doc_id % 3 > 0 then source end as section", "text")
    return drafts.context_window(X.results(s, d).join(texts, "chunk_id")).select("query_id", F.md5("context").alias("digest"))


@query("pattern_predicates", "SELECT doc_id, regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)ing\\b') AS all_match, regexp_matches(text, '(?i)queau') OR regexp_matches(text, '(?i)[0-9]{3}') AS any_match, contains(lower(concat_ws(' ', lang, source)), 'src1') AS on_topic FROM documents")
def pattern_predicates(s, d):
    t = F.col("text")
    return X.table(s, d, "documents").select("doc_id", drafts.matches_all(["the", r"ing\b"], t).alias("all_match"), drafts.matches_any(["queau", "[0-9]{3}"], t).alias("any_match"), drafts.on_topic("SRC1", "lang", "source").alias("on_topic"))


@query("answer_predicates", "SELECT doc_id, doc_id % 4 >= 2 AS answers, doc_id % 3 = 0 AS abstain, doc_id % 4 <> 3 AS can_write FROM documents")
def answer_predicates(s, d):
    label = F.element_at(F.array(*[F.lit(x) for x in judge.LABELS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return X.table(s, d, "documents").select("doc_id", drafts.answers_question(F.col("doc_id") % 4).alias("answers"), drafts.should_abstain(F.col("doc_id") % 3 > 0).alias("abstain"), drafts.can_write(label).alias("can_write"))


@query("conflict_lines", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('superseded: ', lang, ' Lead with ', CASE WHEN doc_id % 2 = 0 THEN source ELSE 'the later one' END, ' and say that the earlier result was superseded.') WHEN 1 THEN concat('disagreement: ', lang, ' Give both positions with their citations.') ELSE concat('scope: ', lang, ' Say what each one measured.') END AS line FROM documents")
def conflict_lines(s, d):
    rows = X.table(s, d, "documents").selectExpr("doc_id", "array(named_struct('kind', element_at(array('freshness', 'disagreement', 'scope'), cast(doc_id % 3 + 1 as int)), 'summary', lang, 'newer', case when doc_id % 2 = 0 then source end)) as c")
    return rows.select("doc_id", drafts.conflict_lines(F.col("c")).alias("line"))


@query("query_shuffle", with_views("results") + "SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat(substr(sha256(query_id::VARCHAR), 1, 8), ':', chunk_id)), chunk_id) AS turn FROM (SELECT query_id, chunk_id, min(rank) AS rank FROM results GROUP BY 1, 2)")
def query_shuffle(s, d):
    once = X.results(s, d).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))  # a chunk may be listed twice
    return drafts.shuffled(once, F.col("query_id").cast("string")).withColumn("turn", F.col("turn").cast("long"))


@query("training_rows", with_views("verdicts", more=_PAIRS) + f"SELECT nq AS prompt, md5(a.text) AS chosen, md5(b.text) AS rejected FROM {_sql_pairs(1)} JOIN documents a ON a.doc_id = chosen JOIN documents b ON b.doc_id = rejected")
def training_rows(s, d):
    texts = X.table(s, d, "documents").selectExpr("doc_id as chunk_id", "text")
    rows = drafts.training_rows(pairs.preference_pairs(X.verdicts(s, d), texts).withColumnRenamed("nq", "query"))
    return rows.select("prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


_NEGATIVES = """v AS (SELECT regexp_replace(lower(trim(query)), '\\s+', ' ', 'g') AS nq, chunk_id, grade FROM verdicts),
b AS (SELECT nq, chunk_id, max(grade) AS grade FROM v GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY nq ORDER BY grade DESC, chunk_id) AS pos FROM b),
n AS (SELECT chunk_id, min(grade) AS grade FROM v GROUP BY 1),
m AS (SELECT a.nq, a.chunk_id AS chosen, n.chunk_id AS rejected, row_number() OVER (PARTITION BY a.nq ORDER BY a.pos, n.grade, n.chunk_id) AS nth FROM a JOIN n ON a.pos <= 5 AND a.grade - n.grade >= 1 AND a.chunk_id <> n.chunk_id)"""


@query("random_negatives", with_views("verdicts", more=_NEGATIVES) + "SELECT nq, chosen, rejected, nth FROM m WHERE nth <= 4")
def random_negatives(s, d):
    return drafts.any_rejected(X.verdicts(s, d), X.verdicts(s, d))


@query("resolved_labels", with_views("qrels") + "SELECT count(CASE WHEN b.item_id IS NULL THEN 1 END) AS no_query, count(CASE WHEN b.item_id IS NOT NULL AND c.doc_id IS NULL THEN 1 END) AS no_chunk FROM qrels LEFT JOIN (SELECT * FROM benchmark WHERE length(text) % 2 = 0) b ON b.item_id = query_id LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') c ON c.doc_id = chunk_id")
def resolved_labels(s, d):
    q = X.table(s, d, "benchmark").where("length(text) % 2 = 0").selectExpr("item_id as query_id", "text as query")
    c = X.table(s, d, "documents").where("lang <> 'de'").selectExpr("doc_id as chunk_id", "text")
    return drafts.resolved_labels(X.qrels(s, d), q, c)[1]


@query("category_report", "SELECT source AS category, count(*) AS n, min(2016 + doc_id % 11) AS first_year, max(2016 + doc_id % 11) AS last_year FROM documents GROUP BY 1")
def category_report(s, d):
    return drafts.category_report(X.table(s, d, "documents").selectExpr("source as category", "2016 + doc_id % 11 as year"))


def _sql_slots(table: str, key: str, kind: str) -> str:
    return f"SELECT {key} AS doc_id, '{kind}' AS kind, concat('0x', substr(md5(unnest({X.TOKENS.format(f"concat('{drafts.PREFIXES[kind]}', text)")})), 1, 8))::BIGINT % 64 AS slot FROM {table}"


@query("stub_embeddings", f"WITH w AS ({_sql_slots('documents', 'doc_id', 'passage')} UNION ALL {_sql_slots('benchmark', 'item_id', 'query')}), c AS (SELECT doc_id, kind, slot, count(*) AS n FROM w GROUP BY 1, 2, 3) SELECT doc_id, kind, round(max(n) / sqrt(sum(n * n)), 6) AS largest, round(sum(slot * n) / sqrt(sum(n * n)), 6) AS weighed FROM c GROUP BY 1, 2")
def stub_embeddings(s, d):
    """Passages and queries with the prefixes of their kinds."""
    own = drafts.stub_embeddings(X.table(s, d, "documents"), "doc_id").withColumn("kind", F.lit("passage"))
    asked = drafts.stub_embeddings(X.table(s, d, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id", "query").withColumn("kind", F.lit("query"))
    places = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    found = own.unionByName(asked).select("doc_id", "kind", F.array_max("embedding").alias("largest"), retrieve.dot(F.col("embedding"), places).alias("weighed"))
    return rounded(found, "largest", "weighed")


# --- operators over the results of others ----------------------------------------------

_FOUND = _RRF + f""", kept AS (SELECT x.* FROM rrf x JOIN chunks c USING (chunk_id) JOIN requests r USING (query_id) WHERE {_FILTER}),
results AS (SELECT query_id, chunk_id, rank FROM (SELECT *, {_RANK} AS rank FROM kept) WHERE rank <= 5),"""


@query("search_metrics", with_views("requests", "chunks", "vectors", "qrels", more=_FOUND + _JUDGED) + "SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in metrics.metric_names().values()) + " FROM per")
def search_metrics(s, d):
    """The engine's own search under evaluation."""

    def search(queries):
        return retrieve.hybrid_search(X.requests(s, d), X.chunks(s, d), retrieve.sparse_index(X.chunks(s, d), persist=True), X.vectors(s, d))

    asked = X.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return rounded(metrics.evaluate_search(search, asked, X.qrels(s, d)), *metrics.metric_names().values())


@query("stub_filtered_topk", with_views("chunks", more=f"asked AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN 2018 END AS year_min, CASE WHEN query_id % 4 = 0 THEN 2024 END AS year_max FROM ({_ASKED})), " + _STUB) + _STUB_TOP)
def stub_filtered_topk(s, d):
    asked = _asked(s, d).selectExpr("*", "case when query_id % 3 = 0 then 2018 end as year_min", "case when query_id % 4 = 0 then 2024 end as year_max")
    return rounded(retrieve.stub_search(asked, X.chunks(s, d)), "score")


@query("highest_labels", with_views("qrels") + "SELECT query_id, chunk_id, max(grade) AS grade FROM (SELECT * FROM qrels UNION ALL SELECT query_id, chunk_id, (grade + 1) % 4 FROM qrels) GROUP BY 1, 2")
def highest_labels(s, d):
    q = X.qrels(s, d)
    return labels.highest_grades(q.unionByName(q.withColumn("grade", ((F.col("grade") + 1) % 4).cast("int"))))


@query("judge_pairs", with_views("qrels") + "SELECT a.query_id::VARCHAR AS nq, a.chunk_id AS chosen, b.chunk_id AS rejected, a.grade - b.grade AS margin FROM qrels a JOIN qrels b ON a.query_id = b.query_id AND a.grade > b.grade")
def judge_pairs(s, d):
    """Every ordered pair of a query's judged chunks, without the cap."""
    rows = X.qrels(s, d).withColumn("query", F.col("query_id").cast("string"))
    return pairs.candidate_pairs(rows).select("nq", "chosen", "rejected", "margin")


def _two_runs(s, d):
    runs = X.runs(s, d)
    return (runs.select("query_id", "metric", F.col(c).alias("value")) for c in ("baseline", "candidate"))


@query("aligned_runs", with_views("runs") + "SELECT query_id, metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(diff, 6) AS diff FROM runs")
def aligned_runs(s, d):
    return rounded(gate.aligned(*_two_runs(s, d)), "baseline", "candidate", "diff")


@query("gate_compare", _SQL["gate_decision"])
def gate_compare(s, d):
    return gate.compare(*_two_runs(s, d), min_queries=1)


@query("draft_grades", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 WHEN doc_id % 5 = 0 OR (doc_id % 2 = 0 AND lang = 'en') THEN 1 ELSE 0 END AS grade FROM documents")
def draft_grades(s, d):
    grade = judge.draft_grade(F.expr("case when doc_id % 3 = 0 then doc_id % 4 end"), F.expr("doc_id % 5 = 0"), F.expr("doc_id % 2 = 0"), F.expr("lang = 'en'"))
    return X.table(s, d, "documents").select("doc_id", grade.cast("long").alias("grade"))


@query("over_fetch", "SELECT item_id, least(200, greatest(20, 4 * (item_id % 70))) AS candidates FROM benchmark")
def over_fetch(s, d):
    return X.table(s, d, "benchmark").select("item_id", retrieve.over_fetch(F.col("item_id") % 70).cast("long").alias("candidates"))


_BOUNDS = _SQL["fixed_window_chunks"].replace("SELECT paper_id, win AS", ", f AS (SELECT paper_id, win AS", 1) + ")"


@query("chunk_report", _BOUNDS + " SELECT paper_id, count(*) AS chunks, count(CASE WHEN n < 80 THEN 1 END) AS under, count(CASE WHEN n > 360 THEN 1 END) AS over FROM f GROUP BY 1")
def chunk_report(s, d):
    return ingest.chunk_bounds(fixed_window_chunks(s, d).withColumnRenamed("n", "n_tokens"), 80, 360)


@query("counted_report", with_views("blocks", more=_RECORDS) + "SELECT paper_id, count(*) AS records, count(CASE WHEN NOT dropped AND NOT thin THEN 1 END) AS kept, coalesce(any_value(c.n), 0) AS chunks FROM records LEFT JOIN (SELECT doc_id AS p, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE lang <> 'en') GROUP BY 1) c ON c.p = paper_id GROUP BY 1")
def counted_report(s, d):
    """The parse report with chunk counts; papers without chunks have 0."""
    lines = X.table(s, d, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("paper_id"), F.explode(F.split("text", "\n")).alias("line"))
    return ingest.chunk_counts(ingest.parse_report(ingest.page_records(X.blocks(s, d))), lines).select("paper_id", "records", "kept", "chunks")


@query("manifest_records", f"WITH t AS ({_TITLES}), n AS (SELECT paper_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS nt FROM t), c AS (SELECT paper_id, CASE WHEN nt <> '' THEN min(paper_id) OVER (PARTITION BY nt) ELSE paper_id END AS canonical_id FROM n) SELECT doc_id AS paper_id, md5(coalesce(title, '')) AS title, coalesce(c.canonical_id, doc_id) AS canonical_id FROM documents LEFT JOIN t ON t.paper_id = doc_id LEFT JOIN c ON c.paper_id = doc_id")
def manifest_records(s, d):
    titles = _titles(s, d)
    manifest = titles.selectExpr("paper_id", "title", "cast(null as int) as year", "cast(null as string) as venue")
    rows = ingest.with_manifest(X.table(s, d, "documents").selectExpr("doc_id as paper_id"), manifest, ingest.canonical_exact(titles))
    return rows.select("paper_id", F.md5("title").alias("title"), "canonical_id")


@query("question_labels", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, unnest(range(len(ls))) AS o, trim(unnest(ls), ' ') AS t FROM l),
e AS (SELECT doc_id, trim(unnest([ls[1], ls[3]]), ' ') AS ev, substr(ls[1], 1, 12) AS hl FROM l WHERE doc_id % 5 > 0)
SELECT concat('q', e.doc_id) AS query_id, concat(c.doc_id, '-0-', c.o) AS chunk_id, max(CASE WHEN contains(ev, hl) THEN 3 ELSE 2 END) AS grade FROM e JOIN c ON c.doc_id = e.doc_id AND c.t = e.ev GROUP BY 1, 2""")
def question_labels(s, d):
    from tessera.sources.documents import question_set

    papers = X.table(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.col("lang").alias("title"),
        F.array(F.struct(F.lit("all").alias("name"), F.split("text", "\n").alias("paragraphs"))).alias("sections"),
        F.expr("array(named_struct('query_id', concat('q', doc_id), 'query', lang, 'evidence', filter(array(get(split(text, '\\n'), 0), get(split(text, '\\n'), 2)), x -> x is not null), "
               "'highlighted', array(substr(get(split(text, '\\n'), 0), 1, 12)), 'unanswerable', doc_id % 5 = 0))").alias("qas"),
    )
    return question_set(papers)["qrels"]


_REPLY = "concat(CASE conv_id % 5 WHEN 0 THEN 'Sure: ```json\n' WHEN 1 THEN 'My verdict is ' WHEN 2 THEN '' WHEN 3 THEN 'none ' ELSE '' END, CASE conv_id % 5 WHEN 3 THEN role WHEN 4 THEN '{\"grade\": ' ELSE concat('{\"grade\": ', turn % 4, ', \"why\": \"', role, '\"', CASE WHEN turn % 3 = 0 THEN '' ELSE ', \"sure\": 0.5' END, '}') END, CASE conv_id % 5 WHEN 0 THEN '\n```' WHEN 1 THEN ' as asked.' WHEN 4 THEN 'x}' ELSE '' END)"


@query("reply_parsing", "WITH r AS (SELECT conv_id, turn, " + _REPLY.replace("\\n", "\n").replace('\\"', '"').replace("\n", "' || chr(10) || '").replace('\"', '"') + """ AS t FROM conversations),
o AS (SELECT conv_id, turn, CASE WHEN instr(t, '{') > 0 AND instr(t, '}') > 0 THEN regexp_extract(t, '(?s)\\{.*\\}') END AS j FROM r),
v AS (SELECT *, CASE WHEN j IS NULL THEN 'no object' WHEN NOT json_valid(j) THEN 'not JSON' WHEN json_extract(j, '$.sure') IS NULL THEN 'missing: sure' END AS error FROM o)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN json_extract(j, '$.grade')::INT END AS grade, CASE WHEN error IS NULL THEN json_extract_string(j, '$.why') END AS why FROM v""")
def reply_parsing(s, d):
    text = F.expr(_REPLY)
    parsed = tools.parsed_reply(text, "grade int, why string, sure double", ("grade", "sure"))
    return X.table(s, d, "conversations").select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.error", "p.reply.grade", "p.reply.why")


_WRITES = "SELECT event_id, CASE event_type WHEN 'view' THEN 'writer' WHEN 'click' THEN 'researcher' WHEN 'error' THEN 'flag_for_human' ELSE 'editor' END AS node, CASE event_id % 5 WHEN 0 THEN 'evidence' WHEN 1 THEN 'draft' WHEN 2 THEN 'budget' WHEN 3 THEN 'outcome' ELSE 'run_id' END AS field FROM events"


@query("state_ownership", f"WITH w AS ({_WRITES}), o AS (SELECT * FROM (VALUES ('evidence', ['researcher']), ('draft', ['writer']), ('budget', ['editor']), ('outcome', ['editor', 'flag_for_human'])) AS t(field, nodes)) SELECT event_id, node, w.field, CASE WHEN nodes IS NULL THEN 'not writable' ELSE concat('owned by ', array_to_string(nodes, ', ')) END AS violation FROM w LEFT JOIN o ON o.field = w.field WHERE nodes IS NULL OR NOT list_contains(nodes, node)")
def state_ownership(s, d):
    writes = X.table(s, d, "events").selectExpr(*[x.strip() for x in _WRITES.removeprefix("SELECT ").removesuffix(" FROM events").replace("END AS node,", "END AS node;").replace("event_id,", "event_id;", 1).split(";")])
    return policy.unowned_writes(writes)


@query("ask_report", "WITH a AS (SELECT doc_id, ['accepted', 'abstained', 'escalated'][(doc_id % 3 + 1)::INT] AS outcome, CASE WHEN doc_id % 4 > 0 THEN source END AS draft, CASE WHEN doc_id % 2 = 0 THEN lang END AS reason FROM documents) SELECT doc_id, md5(concat('Q: ', doc_id, '?', chr(10), chr(10), CASE WHEN outcome = 'accepted' THEN concat('A', doc_id, chr(10), chr(10), 'References:', chr(10), '  [', doc_id, '] T (n.d.), p. 3', chr(10), '  [x] NOT FOUND IN INDEX') ELSE concat(CASE outcome WHEN 'abstained' THEN 'ABSTAINED' ELSE 'ESCALATED TO A PERSON' END, chr(10), '  why:  ', coalesce(reason, 'n/a'), chr(10), '  next: n/a', CASE WHEN draft IS NULL THEN '' ELSE concat(chr(10), chr(10), 'Unverified draft (do not rely on it):', chr(10), draft) END) END, chr(10), chr(10), '[', outcome, '] ', doc_id % 9, ' routing steps, ', doc_id % 6, ' passages')) AS digest FROM a")
def ask_report(s, d):
    rows = X.table(s, d, "documents").selectExpr(
        "doc_id", "concat(doc_id, '?') as question", "element_at(array('accepted', 'abstained', 'escalated'), cast(doc_id % 3 + 1 as int)) as outcome", "concat('A', doc_id) as answer",
        "array(named_struct('chunk_id', cast(doc_id as string), 'found', true, 'title', 'T', 'year', cast(null as int), 'page', 3), named_struct('chunk_id', 'x', 'found', false, 'title', '', 'year', 1, 'page', 1)) as references",
        "case when doc_id % 2 = 0 then lang end as reason", "cast(null as string) as next_step", "case when doc_id % 4 > 0 then source end as draft", "doc_id % 9 as steps", "doc_id % 6 as n_evidence",
    )
    return rows.select("doc_id", F.md5(tools.report_lines()).alias("digest"))
