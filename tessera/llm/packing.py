"""Best-fit packing of token pieces into fixed-length sequences.

A document's ids plus one end id are cut into pieces of at most ``capacity`` ids. Each
task packs its pieces by bounded-space online best fit: at most ``open_bins`` sequences
are open; a bitset has one bit for each amount of free space that some open sequence
has, so the tightest sequence that still takes a piece is the lowest set bit at or above
its length. When a new sequence would exceed the bound, the fullest open one closes.

Only (key, length) rows are shuffled, never ids. Pieces come in a pseudorandom order that
depends on their content alone, so a task that is run again gives the same sequences.

Defined cases: a null or empty text is one piece with only the end id; repeated rows are
packed once each; a null doc_id is kept; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import word_codes
from tessera.session import ship

CAPACITY = 2048
OPEN_BINS = 2048
END_ID = 0
SLICE = 1000  # documents that are encoded at once

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class BestFitPacker:
    """Bounded-space online best fit over one stream of lengths."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: dict[int, list[int]] = defaultdict(list)  # free space -> open sequences
        self.bits = 0
        self.open = self.made = 0

    def _push(self, free: int, sequence: int) -> None:
        self.by_free[free].append(sequence)
        self.bits |= 1 << free

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        sequence = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit into {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            sequence = self._pop(free)
        else:
            free, sequence = self.capacity, self.made
            self.made += 1
            self.open += 1
        if free == length:  # full: closes by itself
            self.open -= 1
        else:
            self._push(free - length, sequence)
            if self.open > self.open_bins:  # the fullest closes first
                self._pop((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
        return sequence, self.capacity - free


def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32,
    and the ids themselves if ``with_ids``."""
    ship(docs.sparkSession)
    path = path or word_codes.tokenizer_path()
    schema = T.StructType(PIECES.fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_codes.encoder(path)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, offsets = enc.encode(batch.column("text"))
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            doc_ids = batch.column("doc_id").to_pylist()
            end = np.array([end_id], np.uint32)
            for d, doc_id in enumerate(doc_ids):
                own = np.concatenate([ids[offsets[d] : offsets[d + 1]], end]).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        out["ids"].append(part.astype(np.int64))
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length (other columns stay).

    Sequence numbers are unique in the result and otherwise arbitrary.
    """
    ship(pieces.sparkSession)
    schema = T.StructType(
        pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    # the hash spreads a document's pieces and mixes lengths; all columns break ties
    order = [F.xxhash64("doc_id", "piece", "length"), *(F.col(c) for c in ("doc_id", "piece", "length", "ids_crc32") if c in pieces.columns)]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = BestFitPacker(capacity, open_bins)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            extra = [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "length")).sortWithinPartitions(*order)
    return dealt.mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each one has."""
    return pack(token_pieces(docs, path, capacity), capacity, open_bins)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (gapless), doc_ids in order."""
    packed = pack(token_pieces(docs, path, capacity, with_ids=True), capacity, open_bins)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most capacity ids in all
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
