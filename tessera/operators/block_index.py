"""Postings in blocks with their largest score part, and a top-k that skips blocks.

Chunks are dealt to segments of about ``SEGMENT`` chunks of one cluster (a column such as
the language, or none); the postings of a term in a segment are one block, a row with the
block's chunks, counts and lengths, and the largest score part that a chunk has in it. All
terms share the segments, so the sum of a query's largest parts bounds every score in a
segment, and it comes from the heads of blocks alone, by a grouping.

A query's most promising segments are scored first; the n-th best score found is a
threshold, and only segments whose bound reaches it are scored after that. What is skipped
cannot be among the best n, so the result is the full ranking's. Blocks are stored in
folders by a hash of the term and sorted by term, so a query reads its terms' folders, and
of those the row groups that can have its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import retrieve
from tessera.operators.retrieve import B, HELD, IDF_FLOOR, K1, SparseIndex, query_terms
from tessera.session import materialize

SEGMENT = 16  # chunks of a segment, about
SLOTS = 64  # folders of terms
LEAD = 32  # segments of a query that are scored before any is skipped
DEALT = 4  # parts of a folder
PUSHED = 1000  # terms that are pushed into the scan; more are joined
FORMAT = 3


class FormatError(ValueError):
    """A stored index of another format."""


@dataclass(frozen=True)
class BlockIndex:
    """blocks (slot, term, segment, n, most, chunk_ids, tfs, dls), term_stats (term, idf, df)
    and corpus (n, avg_dl, k1, b), one row."""

    blocks: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


def _slot(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def block_index(index: SparseIndex, clusters: DataFrame | None = None, segment: int = SEGMENT, k1: float = K1, b: float = B) -> BlockIndex:
    """Blocks of an index's postings. ``clusters`` (chunk_id, cluster): chunks that share
    words, such as those of a language; segments do not mix them."""
    postings = index.postings.select("term", "chunk_id", "tf", "dl")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / segment)).cast("long")
    place = F.xxhash64("cluster", F.pmod(F.xxhash64("chunk_id"), parts))
    if clusters is None:
        sizes = index.corpus.select(F.lit("").alias("cluster"), F.col("n").alias("size"))
        placed = postings.crossJoin(F.broadcast(sizes)).withColumn("segment", place)  # one row
    else:
        named = clusters.select("chunk_id", F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("cluster"))
        sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
        placed = postings.join(named.join(sizes, "cluster").select("chunk_id", place.alias("segment")), "chunk_id")
    # postings go to the folder of their block and are made blocks there
    placed = placed.withColumns({"slot": _slot("term"), "part": F.pmod(F.col("segment"), F.lit(DEALT)).cast("int")}).select("slot", "part", "term", "segment", "chunk_id", "tf", "dl").repartition("slot", "part")
    scored = placed.crossJoin(F.broadcast(index.corpus.select("avg_dl"))).withColumn("most", retrieve._tf_part(k1, b))  # one row
    members = F.array_sort(F.collect_list(F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))))  # a segment's at most
    blocks = scored.groupBy("slot", "part", "term", "segment").agg(F.count("*").cast("int").alias("n"), F.max("most").alias("most"), members.alias("m"))
    blocks = blocks.select("slot", "term", "segment", "n", "most", F.col("m.chunk_id").alias("chunk_ids"), F.col("m.tf").alias("tfs"), F.col("m.dl").alias("dls"))
    raw = index.term_stats.crossJoin(F.broadcast(index.corpus)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((IDF_FLOOR * F.avg("raw")).alias("floor"))
    stats = raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return BlockIndex(blocks, stats, index.corpus.withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b))}))


def save_blocks(index: BlockIndex, path: str) -> None:
    """A folder a slot, rows sorted by term; a frequent term's blocks are dealt to several
    files. Blocks of :func:`block_index` are where they are written."""
    dealt = index.blocks.sortWithinPartitions("slot", "term", "segment")
    dealt.write.mode("overwrite").partitionBy("slot").option("parquet.block.size", 4 << 20).parquet(f"{path}/blocks")
    index.term_stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus.withColumn("format", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/corpus")


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    corpus = spark.read.parquet(f"{path}/corpus")
    found = corpus.select("format").first().format if "format" in corpus.columns else None
    if found != FORMAT:
        raise FormatError(f"index of format {found}, expected {FORMAT}")
    return BlockIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/term_stats"), corpus.drop("format"))


def _of_terms(index: BlockIndex, wanted: DataFrame, pushed: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, term_stats) of the wanted terms: few are constants of the scan."""
    some = [r.term for r in wanted.select("term").distinct().limit(pushed + 1).collect()]
    if len(some) > pushed:
        terms = wanted.select("term").distinct()
        return index.blocks.join(terms.select("term", _slot("term").alias("slot")), ["slot", "term"], "left_semi"), index.term_stats.join(terms, "term", "left_semi")
    one = index.blocks.sparkSession.createDataFrame([(t,) for t in some], "term string").select(_slot("term").alias("slot"))
    slots = sorted({r.slot for r in one.collect()})
    return index.blocks.where(F.col("slot").isin(slots) & F.col("term").isin(some)), index.term_stats.where(F.col("term").isin(some))


@dataclass(frozen=True)
class Search:
    """A ranking and what it took: bounds (query_id, segment, bound, blocks) of all segments
    that a query could meet, scored (query_id, segment) of those whose blocks were read."""

    ranking: DataFrame
    bounds: DataFrame
    scored: DataFrame


def search_blocks(requests: DataFrame, index: BlockIndex, n: int, lead: int = LEAD, pushed: int = PUSHED) -> Search:
    """The best n chunks of each request of (query_id, query): those of :func:`retrieve.bm25`."""
    wanted = materialize(query_terms(requests), "block-wanted")
    blocks, stats = _of_terms(index, wanted, pushed)
    weights = materialize(wanted.join(stats, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight")), "block-weights")
    weights = F.broadcast(weights) if weights.count() <= HELD else weights
    # a part is at least 0, so a term of negative weight adds at most 0
    heads = blocks.select("term", "segment", "n", "most").repartition("segment").join(weights, "term")
    bounds = heads.groupBy("query_id", "segment").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most")).alias("bound"), F.count("*").alias("blocks"))
    bounds = materialize(bounds, "block-bounds")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))
    first = materialize(bounds.withColumn("nth", nth).where(F.col("nth") <= lead).select("query_id", "segment"), "block-first")

    def scores(segments: DataFrame) -> DataFrame:
        """Blocks meet the queries that their segment is open to, and are scored where the segment is."""
        open_to = segments.groupBy("segment").agg(F.collect_set("query_id").alias("open"))  # requests of the batch, at most
        met = blocks.select("term", "segment", "chunk_ids", "tfs", "dls").repartition("segment").join(open_to, "segment").join(weights, "term").where(F.array_contains("open", F.col("query_id")))
        rows = met.select("query_id", "segment", "weight", F.explode(F.arrays_zip("chunk_ids", "tfs", "dls")).alias("p")).selectExpr("query_id", "segment", "weight", "p.chunk_ids as chunk_id", "p.tfs as tf", "p.dls as dl")
        corpus = index.corpus.select("avg_dl", "k1", "b")
        part = F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("dl") / F.col("avg_dl")))
        summed = rows.crossJoin(F.broadcast(corpus)).groupBy("query_id", "segment", "chunk_id").agg(F.sum(F.col("weight") * part).alias("score"))  # one row
        return summed.where("score > 0").select("query_id", "chunk_id", "score")

    known = materialize(retrieve.top(scores(first), n), "block-lead")
    threshold = known.where(F.col("rank") == n).select("query_id", F.col("score").alias("threshold"))
    open_ = bounds.join(threshold, "query_id", "left").where(F.col("bound") >= F.coalesce("threshold", F.lit(0.0)) - 1e-9).select("query_id", "segment")
    rest = materialize(open_.join(first, ["query_id", "segment"], "left_anti"), "block-rest")
    ranking = retrieve.top(known.drop("rank").unionByName(scores(rest)), n)
    return Search(ranking, bounds, first.unionByName(rest))


def top_blocks(requests: DataFrame, index: BlockIndex, n: int, lead: int = LEAD, pushed: int = PUSHED) -> DataFrame:
    return search_blocks(requests, index, n, lead, pushed).ranking
