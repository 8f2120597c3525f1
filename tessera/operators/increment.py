"""Adding to an index without building it again, and attempts that never raise.

A delta is the index of new chunks alone. Counts of documents and terms are sums, so base
and delta together are the index of all chunks: postings and statistics are merged by
grouping, and no text of the base is read. A delta may also stay apart and be searched
beside the base (:func:`retrieve.union_backends`).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieve import SparseIndex, sparse_index
from tessera.session import materialize

log = logging.getLogger(__name__)


def unknown(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose id is not known yet, each id once (of several texts the least)."""
    one = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id")
    return one.agg(F.min(F.struct(*[F.col(c) for c in ("text", *(x for x in chunks.columns if x not in ("chunk_id", "text")))])).alias("row")).select("chunk_id", "row.*")


def merged(base: SparseIndex, delta: SparseIndex) -> SparseIndex:
    """The index of the chunks of both, which share no chunk."""
    stats = base.term_stats.unionByName(delta.term_stats).groupBy("term").agg(F.sum("df").alias("df"))
    rows = base.corpus.unionByName(delta.corpus).where("n > 0")
    corpus = rows.agg(F.sum("n").alias("n"), (F.sum(F.col("avg_dl") * F.col("n")) / F.sum("n")).alias("avg_dl"))
    packed = base.packed.unionByName(delta.packed) if base.packed is not None and delta.packed is not None else None
    return SparseIndex(base.postings.unionByName(delta.postings), stats, corpus, packed)


def extend(base: SparseIndex, chunks: DataFrame, known: DataFrame) -> SparseIndex:
    """``base``, whose chunks are ``known``, with the chunks that it lacks."""
    return merged(base, sparse_index(materialize(unknown(chunks, known), "delta-chunks"), persist=True))


@dataclass(frozen=True)
class Outcome:
    """What an attempt brought: new chunks with their index, or why there are none."""

    chunks: DataFrame | None
    index: SparseIndex | None
    error: str | None = None

    @property
    def found_anything(self) -> bool:
        return self.index is not None


def discover(fetch: Callable[[], DataFrame], known: DataFrame, most: int | None = None) -> Outcome:
    """Fetch chunks, leave out what is known, index the rest. A failure of any kind is told
    in the outcome: the caller's own way of going on without new evidence always holds."""
    try:
        new = unknown(fetch(), known)
        new = materialize(new.orderBy("chunk_id").limit(most) if most is not None else new, "discovered")
        if new.isEmpty():
            return Outcome(None, None, "no new candidates found")
        return Outcome(new, sparse_index(new, persist=True))
    except Exception as failure:
        log.warning("discovery failed: %s", failure)
        return Outcome(None, None, str(failure) or type(failure).__name__)
