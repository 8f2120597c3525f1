"""Token ids in a compressed binary format with access to single documents.

A store is a table of blocks in ascending doc_id order. Each block's ``data`` is a
self-contained byte string (also exportable as a file):

    magic ``TSB1`` | u32 n_docs | 16 bytes dictionary hash |
    n_docs x i64 doc_id | n_docs x u8 is_null | n_docs x u64 n_ids | (n_docs+1) x u64 frame offset |
    zstandard frames

Each document is one frame of little-endian u32 ids, compressed with a dictionary shared
by the whole store, so one short document is read by decompressing its frame alone. The
dictionary is trained on the serialized ids of at most ``sample_docs`` whole documents of
at most ``SAMPLE_CHARS`` characters (smallest hash of the id); it changes the size of the
files, never what they hold.

Defined cases: a null or empty text holds only the end id; a text of any length is one frame
of one block; null doc_ids come first;
repeated rows, and texts of one doc_id, are kept one after the other (the shorter first);
an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import word_codes
from tessera.llm.sampling import hash_sample
from tessera.session import new_table_path, ship

END_ID = 2
BLOCK_IDS = 1 << 20  # a block closes at so many ids
SAMPLE_DOCS = 200
SAMPLE_CHARS = 1 << 16
SAMPLE_BYTES = 4 << 20  # bytes that the dictionary is trained on, at most
DICT_BYTES = 64 << 10
LEVEL = 3
MAGIC = b"TSB1"
HEAD = struct.Struct("<4sI16s")


def dict_hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest()


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Bytes of the shared dictionary; empty where the sample is too small to train on."""
    import zstandard

    short = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    rows = hash_sample(short, sample_docs, ties=(F.length("text"),)).collect()
    ids, offsets = word_codes.encoder(path).encode(pa.array([r.text for r in rows], pa.string()))
    samples, size = [], 0
    for a, b in zip(offsets[:-1], offsets[1:]):
        samples.append(np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def encode_block(doc_ids: list, ids: list[np.ndarray], dictionary: bytes, compressor=None) -> bytes:
    compressor = compressor or _codec(dictionary)[0]
    frames = [compressor.compress(x.astype("<u4").tobytes()) for x in ids]
    return b"".join(
        [
            HEAD.pack(MAGIC, len(frames), dict_hash(dictionary)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(),
            *frames,
        ]
    )


class Block:
    """Reads one block; ``ids(k)`` decompresses only the k-th document."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, n, named = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if named != dict_hash(dictionary):
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        self.data, self.n = data, n
        ids = np.frombuffer(data, "<i8", n, at)
        nulls = np.frombuffer(data, "u1", n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.sizes = np.frombuffer(data, "<u8", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 17 * n)
        self.frames = at + 17 * n + 8 * (n + 1)
        self.decompressor = _codec(dictionary)[1]

    def ids(self, k: int) -> np.ndarray:
        a, b = self.frames + int(self.offsets[k]), self.frames + int(self.offsets[k + 1])
        return np.frombuffer(self.decompressor.decompress(self.data[a:b], max_output_size=4 * int(self.sizes[k])), "<u4")


def write_store(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write ``target/blocks`` (part, block, first_start, n_ids, first_doc, last_doc, data) and
    ``target/dictionary``. Blocks of null ids have no first_doc."""
    spark = docs.sparkSession
    ship(spark)
    path = path or word_codes.tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(docs, path, end_id)
    spark.createDataFrame([(bytearray(dict_hash(dictionary)), bytearray(dictionary))], "hash binary, data binary").coalesce(1).write.parquet(f"{target}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, compressor = word_codes.encoder(path), _codec(dictionary)[0]
        part, state = TaskContext.get().partitionId(), {"block": 0, "start": 0}
        held_ids: list = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            n = sum(map(len, held))
            known = [d for d in held_ids if d is not None]
            row = [part, state["block"], state["start"], n, min(known, default=None), max(known, default=None), encode_block(held_ids, held, dictionary, compressor)]
            state["block"] += 1
            state["start"] += n
            held_ids.clear(), held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "block", "first_start", "n_ids", "first_doc", "last_doc", "data"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, offsets = enc.encode(some.column("text"))
                for d, doc_id in enumerate(some.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[d] : offsets[d + 1]], np.uint32(end_id))
                    held_ids.append(doc_id), held.append(own)
                    size += len(own)
                    if size >= BLOCK_IDS:
                        yield close()
                        size = 0
        if held:
            yield close()

    # rows of one doc_id, or of none, are dealt out by their texts
    order = [F.col("doc_id"), F.length("text"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, "part int, block int, first_start long, n_ids long, first_doc long, last_doc long, data binary").write.option("compression", "uncompressed").parquet(f"{target}/blocks")


def _dictionary(spark: SparkSession, target: str) -> bytes:
    return bytes(spark.read.parquet(f"{target}/dictionary").first().data)  # at most DICT_BYTES


def read_store(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    ship(spark)
    dictionary = _dictionary(spark, target)
    table = spark.read.parquet(f"{target}/blocks")
    # one row for each file part: as many as there were writing tasks
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, run = {}, 0
    for r in totals:
        bases[r.part] = run
        run += r.n
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["data"], dictionary)
                at = bases[row["part"]] + row["first_start"]
                starts = at + np.concatenate([[0], np.cumsum(block.sizes)[:-1]]).astype(np.int64)
                ids = [block.ids(k) for k in range(block.n)]
                cols = [
                    pa.array(block.doc_ids, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ] + [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return table.select("part", "first_start", "data").mapInArrow(docs, schema)


def holding(blocks: DataFrame, doc_id: int) -> DataFrame:
    """Blocks that may have the document."""
    return blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))


def read_document(spark: SparkSession, target: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this id: the blocks whose range of doc_ids holds it are read
    (blocks are in order of doc_id, so these are few), and of those its own frames."""
    dictionary, out = _dictionary(spark, target), []
    ship(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                block = Block(data, dictionary)
                hits = [block.ids(k).astype(np.int64) for k, d in enumerate(block.doc_ids) if d == doc_id]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int64()))], names=["ids"])

    for row in holding(spark.read.parquet(f"{target}/blocks"), doc_id).select("data").mapInArrow(find, "ids array<long>").collect():
        out.append(np.array(row.ids, np.uint32))
    return out


def op9_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_table_path(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)
    return read_store(spark, target)
