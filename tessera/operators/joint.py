"""Batched joint scoring of (query, chunk) pairs.

A pair's cost is its number of tokens. Pairs are dealt to length buckets and sorted by
length, so a batch holds pairs of like length and little of it is padding; a batch closes
before its padded size passes ``batch_tokens``. Every worker makes one scorer and gives it
whole batches. A model's cross-encoder is such a scorer; the one here is deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.retrieve import ranked
from tessera.session import ship

BATCH_TOKENS = 1 << 14
WORD = re.compile("[a-z0-9]+")
Scorer = Callable[[list[tuple[str, str]]], list[float]]


def interaction_scorer() -> Scorer:
    """The share of a query's distinct words that the chunk has, each worth less the later
    the chunk first says it: 1 / (1 + place / 100)."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, chunk in pairs:
            first: dict[str, int] = {}
            for place, word in enumerate(WORD.findall(chunk.lower())):
                first.setdefault(word, place)
            asked = sorted(set(WORD.findall(query.lower())))
            out.append(sum(1 / (1 + first[w] / 100) for w in asked if w in first) / len(asked) if asked else 0.0)
        return out

    return score


def batches_of(lengths: list[int], batch_tokens: int) -> list[tuple[int, int]]:
    """Ranges of pairs in ascending length whose number times their longest is within the
    bound; a longer pair is alone."""
    out, at = [], 0
    for k, n in enumerate(lengths):
        if k > at and (k - at + 1) * n > batch_tokens:
            out.append((at, k))
            at = k
    return out + [(at, len(lengths))] if len(lengths) > at else out


def joint_scores(pairs: DataFrame, make: Callable[[], Scorer] = interaction_scorer, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Adds rerank_score to rows of (query_id, chunk_id, query, chunk_text); null texts are empty."""
    ship(pairs.sparkSession)
    texts = pairs.select("query_id", "chunk_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))
    sized = texts.withColumn("tokens", (F.size(words("query")) + F.size(words("chunk_text")) + 1).cast("int"))
    # buckets of doubling length, each dealt out by pair
    dealt = sized.repartition(F.floor(F.log2("tokens")), F.xxhash64("query_id", "chunk_id")).sortWithinPartitions("tokens", "query_id", "chunk_id")
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in found:
            rows = list(zip(batch.column("query").to_pylist(), batch.column("chunk_text").to_pylist()))
            scores = [s for a, b in batches_of(batch.column("tokens").to_pylist(), batch_tokens) for s in scorer(rows[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "rerank_score"])

    return dealt.mapInArrow(run, ", ".join([*kinds, "rerank_score double"]))


def joint_rerank(results: DataFrame, requests: DataFrame, chunks: DataFrame, make: Callable[[], Scorer] = interaction_scorer, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Results of (query_id, chunk_id, ...) in the order of their joint scores."""
    texts = results.select("query_id", "chunk_id").join(requests.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    scored = results.drop("rank").join(joint_scores(texts, make, batch_tokens), ["query_id", "chunk_id"])
    return ranked(scored, "rerank_score")
