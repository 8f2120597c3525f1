"""Mixing sources to target weights.

The words of a source, in a fixed order of its documents, are packed into blocks of
``block_words`` words (the last may be shorter). Output shards draw how many blocks they
take of each source from a multinomial over what each source still owes, so the draws of
all shards add up to the targets. The n-th slot of a source is mapped to a block by a
pseudorandom permutation of that source's blocks (one per round through the source), and
blocks are joined to slots by index.

The order of the words uses prefix sums in two levels, so that a source with most of all
rows is spread over many tasks. What reaches the driver is one row a source; the plan of
the draws has a number for each shard (at most ``MAX_SHARDS``) and source.

Defined cases: a null text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows are documents of their own (``resample`` gives rows
that are equal in doc_id, source and text as many copies each, rounded from their sum, but
one at least if the mix takes any); an empty table gives
an empty result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_BLOCKS, MIN_SHARDS, MAX_SHARDS = 1 << 16, 64, 4096  # blocks of an output shard; shards
BUCKET_ROWS, MIN_BUCKETS = 100_000, 256  # first level of the prefix sums, by hash of doc_id and text
SEED = 20240229


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above ``max_repeats`` times its size, the
    excess reshared by weight among those still below."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= max_repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def shard_counts(slots: list[int], shards: int = MIN_SHARDS, seed: int = SEED) -> np.ndarray:
    """counts[shard, source]: multinomial draws over what each source still owes."""
    rng = np.random.default_rng(seed)
    owed = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        n = int(owed.sum()) // (shards - k)
        if k == shards - 1 or not n:
            out[k] = owed if k == shards - 1 else 0
        else:
            drawn = np.minimum(rng.multinomial(n, owed / owed.sum()), owed)
            out[k] = drawn
        owed = owed - out[k]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size), chosen by key: a four-round Feistel
    network on the next even number of bits, walked until the value is in range."""
    x, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2))).astype(np.uint64)
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < size, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.ones(len(x), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (_mix64(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r + 1)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


class Mixture:
    """The plan of one mix. ``documents``: every row with its source's figures and place;
    ``slots``: shard, slot, source number and block index of each output block."""

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[float, ...] = WEIGHTS,
        max_repeats: int = MAX_REPEATS,
        block_words: int = BLOCK_WORDS,
        shards: int | None = None,
        seed: int = SEED,
    ):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.block_words, self.seed = block_words, seed
        buckets = max(MIN_BUCKETS, docs.count() // BUCKET_ROWS)
        sized = materialize(
            docs.select(
                F.col("doc_id").cast("long"),
                F.col("source").cast("string"),
                F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                F.xxhash64("text").alias("tie"),
                F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"),
            ),
            "mix-sizes",
        )
        rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        self.sources = [r.source for r in rows]
        self.sizes = [int(r["size"]) for r in rows]
        self.weights = [weights[i % len(weights)] for i in range(len(rows))]
        self.targets = targets(self.sizes, self.weights, max_repeats)
        self.blocks = [-(-s // block_words) for s in self.sizes]
        self.n_slots = [min(max_repeats * b, round(t / s * b)) if s else 0 for t, s, b in zip(self.targets, self.sizes, self.blocks)]
        shards = shards or min(MAX_SHARDS, max(MIN_SHARDS, sum(self.n_slots) // SHARD_BLOCKS))
        self.counts = shard_counts(self.n_slots, shards, seed)
        table = self.spark.createDataFrame(
            [(i, *x) for i, x in enumerate(zip(self.sources, self.sizes, self.targets))],
            "source_no int, named string, source_size long, target double",
        )
        # whether a row for each source is broadcast, Spark decides by its size
        placed = sized.join(table, F.col("source").eqNullSafe(F.col("named"))).drop("named")
        sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
        # one row a bucket and source
        sums = sums.selectExpr("source_no", "bucket", "sum(n) over (partition by source_no order by bucket) - n as base")
        self.documents = placed.join(sums, ["source_no", "bucket"]).selectExpr(
            "doc_id", "source", "source_no", "size", "source_size", "target", "tie",
            "base + sum(size) over (partition by source_no, bucket order by doc_id, size, tie rows unbounded preceding) - size as start",
        )

    def slots(self) -> DataFrame:
        """shard, slot, source_no, block: the blocks of every output shard, in order."""
        counts, blocks, seed = self.counts, np.array(self.blocks, np.int64), self.seed
        n_sources = counts.shape[1]
        ends = np.cumsum(counts.reshape(-1))  # shard after shard, source after source
        before = np.vstack([np.zeros((1, n_sources), np.int64), np.cumsum(counts, 0)[:-1]]).reshape(-1)  # slots of the source in earlier shards
        total = int(ends[-1]) if len(ends) else 0

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column(0).to_numpy()
                cell = np.searchsorted(ends, slot, side="right")
                source = cell % n_sources
                nth = before[cell] + slot - (ends - counts.reshape(-1))[cell]
                size = blocks[source]
                turn = nth // size
                key = _mix64((np.uint64(seed) + source.astype(np.uint64) * np.uint64(1_000_003) + turn.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
                block = permute(nth % size, size, key)
                cols = [pa.array(cell // n_sources, pa.int32()), batch.column(0), pa.array(source, pa.int32()), pa.array(block, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "slot", "source_no", "block"])

        return self.spark.range(total).mapInArrow(draw, "shard int, slot long, source_no int, block long")

    def spans(self) -> DataFrame:
        """source_no, block, start (of the document), skip, n: which words of which
        document a block has."""
        b = self.block_words
        return (
            self.documents.where("size > 0")
            .withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
            .selectExpr(
                "source_no", "block", "start", f"greatest(0, block * {b} - start) as skip",
                f"least(start + size, (block + 1) * {b}) - greatest(start, block * {b}) as n",
            )
        )

    def taken(self) -> DataFrame:
        """The documents with ``taken``: the words that the mix takes of each."""
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        taken = self.spans().join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.expr("n * times")).alias("taken"))
        # documents without words share their place with the next one: they take nothing
        joined = self.documents.join(taken, ["source_no", "start"], "left")
        return joined.withColumn("taken", F.expr("case when size > 0 then coalesce(taken, 0) else 0 end"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mixed blocks themselves: shard, slot, source, text."""
        keyed = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.xxhash64("text").alias("tie"))
        whole = (
            self.documents.alias("d")
            .join(
                keyed.dropDuplicates(["doc_id", "source", "tie"]).alias("t"),
                F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source and d.tie = t.tie"),
            )
            .select("d.source_no", "d.start", F.regexp_extract_all("t.text", F.lit(WORD), F.lit(0)).alias("words"))
        )
        parts = self.spans().join(whole, ["source_no", "start"]).selectExpr("source_no", "block", "start", "slice(words, cast(skip + 1 as int), cast(n as int)) as words")
        blocks = parts.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("p"))  # block_words words
        blocks = blocks.selectExpr("source_no", "block", "array_join(flatten(transform(p, x -> x.words)), ' ') as text")
        names = self.spark.createDataFrame(list(enumerate(self.sources)), "source_no int, source string")
        return self.slots().join(blocks, ["source_no", "block"]).join(names, "source_no").select("shard", "slot", "source", "text")


def resample(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it: the whole times that
    its taken words are its size, and once more with the probability of the rest (by hash)."""
    plan = Mixture(docs, **options)
    copies = plan.taken().where("taken > 0").selectExpr(
        "doc_id as __mix_id", "source as __mix_source", "tie as __mix_tie",
        "cast(floor(taken / size + pmod(xxhash64(doc_id, tie, 'copies'), 1000003) / 1000003D) as int) as __mix_copies",
    )
    # rows that are equal in all of these are interchangeable; their copies add up
    copies = copies.groupBy("__mix_id", "__mix_source", "__mix_tie").agg(F.sum("__mix_copies").alias("__mix_copies"), F.count("*").alias("__mix_rows"))
    hit = F.expr("cast(doc_id as long) <=> __mix_id and cast(source as string) <=> __mix_source and xxhash64(text) = __mix_tie")
    joined = docs.join(copies.where("__mix_copies > 0"), hit)
    share = F.expr("cast(greatest(1, round(__mix_copies / __mix_rows)) as int)")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return joined.withColumn("__mix_nth", F.explode(F.sequence(F.lit(1), share))).select(*columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Mixture(docs).taken().select("doc_id", "size", "source_size", "target", "taken", "source")
