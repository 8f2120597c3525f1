"""Near-duplicate documents by circulant MinHash.

A document's set has its distinct five-word shingles (ASCII-lower-cased words). One
permutation places every shingle on a circle of 2**32 positions, a second one gives each
position a rank, and coordinate k of the signature is the least rank after shifting the
second permutation by k: all coordinates come from two permutations. Bands of four
coordinates make candidate links, and each link is confirmed by the Jaccard similarity of
the full sets.

All pairs of a band are never written out. In each band's bucket the member that has most
bucket partners, as a rule the text that the others were made from, is the hub. A member
whose one-bit signature does not rule out a similarity of 0.75 to the hub (chance of a loss
below 1e-5) is a candidate link of it; only what is left over is compared with all members
of the bucket, signatures alone, in steps of bounded size. Candidate links connect
candidate groups. In a group every member is first compared with the group's hub by the
full sets. What is not linked to it is then compared with all members, in sub-blocks: a
task computes all intersections of two sub-blocks by products of their incidence matrices
and returns the links that connect what it found. Components are therefore those of all
links within the groups. A pair at exactly 0.75 shares a bucket with probability 1 - 5e-6.

Documents of equal text (by 128 bits of hashes) form one class and are processed once.
Defined cases: a null text, or one without words, has an empty set and links with nothing;
with fewer than five words the whole sequence is the one shingle; repeated rows are
documents of their own; a group without any doc_id has a null component_id; an empty table
gives an empty result. Very long texts are signed in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.grouping import cross_links, settle, sorted_groups
from tessera.llm.words import mix64, word_hashes
from tessera.session import materialize, ship

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SEED = 0x9E3779B9
MAX_DIFFERENT_BITS = 34  # of 128; 16 are expected at a similarity of 0.75
BUCKET_BLOCK = 512  # signatures of one side of a step
CHUNK_BYTES = 1 << 20  # of texts that are hashed at once, about
HUB_ROWS = 500  # links of one hub that one step verifies
REST_BLOCK, ALL_BLOCK = 128, 512
COLUMNS = 4096  # shingles whose incidence is multiplied at once
WORD = r"[^\x20\x09-\x0D]"


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers (xor-shifts and odd factors), in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: Iterable[str | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > CHUNK_BYTES:
            yield from _shingle_sets(held, width)
            held, size = [], 0
    if held:
        yield from _shingle_sets(held, width)


def _shingle_sets(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    starts, _, (hashes,) = word_hashes(b" ".join(raw))
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))]).tolist()
    odd = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * odd + hashes[k : k + len(rolled)]
    rolled = mix64(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            h = b - a
            for x in hashes[a:b].tolist():
                h = (h * int(odd) + x) % (1 << 64)
            yield mix64(np.array([h], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Least rank of all shingles for each of k shifts of the second permutation."""
    at = _permuted((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(SEED))  # places on the circle
    shifts = np.arange(k, dtype=np.uint32)
    low = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 512):
        low = np.minimum(low, _permuted(at[i : i + 512, None] + shifts).min(0))
    return low


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for c in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, c] + np.uint64(1))
    return key.view(np.int64)


def same_enough(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            sets = list(shingle_sets(some.column("text").to_pylist()))
            keys, bits = [], np.zeros((len(sets), 16), np.uint8)
            for i, s in enumerate(sets):
                if len(s):
                    sig = signature(s)
                    keys.append(band_keys(sig))
                    bits[i] = np.packbits((sig & 1).astype(np.uint8))
                else:
                    keys.append(None)
            b = bits.view(np.int64)
            cols = [*(some.column(c) for c in ("doc_id", "h0", "h1")), pa.array(list(map(len, sets)), pa.int64())]
            cols += [pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h0", "h1", "n_shingles", "bits0", "bits1", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(some.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column("class_id"), pa.array(sets, pa.binary())], names=["class_id", "shingles"])


def _read_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _with_hub(percent: int):
    """Rows sorted by (a, salt, b) with the hub's own set first (b null): the links that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles"))):
                if b is None:
                    hub, hub_set = a, _read_set(data)
                elif a == hub and same_enough(hub_set, _read_set(data), percent):
                    found.append((a, b))
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    flat, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = np.bincount(place, minlength=len(flat)) > 1  # what one set has alone counts nothing
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, at = owner[keep], column[place[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(shared.sum())
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        has = np.zeros((len(left) + len(right), min(COLUMNS, width - lo)), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _with_rest(percent: int):
    """Within each (component, i, j): links that connect the rest's rows with all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in sorted_groups(batches, ["component", "i", "j"]):
            ids, every = (table.column(c).to_numpy() for c in ("class_id", "every"))
            data = table.column("shingles").combine_chunks()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rest, full = a + np.flatnonzero(every[a:b] == 0), a + np.flatnonzero(every[a:b] == 1)
                left, right = ([_read_set(data[int(r)].as_py()) for r in rows] for rows in (rest, full))
                if not left or not right:
                    continue
                both = intersections(left, right)
                union = np.array(list(map(len, left)))[:, None] + np.array(list(map(len, right)))[None, :] - both
                p, q = np.nonzero((100 * both >= percent * union) & (ids[rest][:, None] != ids[full][None, :]))
                own = np.concatenate([ids[rest], ids[full]])
                label = settle(len(own), p, q + len(left))
                moved = np.flatnonzero(label != np.arange(len(own)))
                out.append((own[moved], own[label[moved]]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's two 64-bit hashes: what is equal in both is one class."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h0"), F.xxhash64(F.lit("second"), "text").alias("h1")
    )


def _same_row(left: str, right: str) -> Column:
    """Equal hashes and doc_ids, null ids being equal; all parts are join keys."""
    return F.expr(f"{left}.h0 = {right}.h0 and {left}.h1 = {right}.h1 and {left}.doc_id <=> {right}.doc_id")


def _bucket_links(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) between classes whose signatures meet, weight of each class that meets
    any: how many bucket partners it has)."""
    buckets = classes.select("class_id", "bits0", "bits1", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = materialize(buckets.join(shared, "key"), "minhash-buckets")
    weights = materialize(met.groupBy("class_id").agg(F.sum("m").alias("weight")), "minhash-weights")
    # the hub of each bucket: one row a key, made with partial aggregates
    heavy = met.join(weights, "class_id")
    hubs = heavy.groupBy("key").agg(F.max_by(F.struct("class_id", "bits0", "bits1"), F.struct("weight", "class_id")).alias("hub"))
    apart = F.expr("bit_count(bits0 ^ hub.bits0) + bit_count(bits1 ^ hub.bits1)")
    faced = met.join(materialize(hubs, "minhash-hubs"), "key").where("class_id <> hub.class_id")
    faced = materialize(faced.select("key", "class_id", "bits0", "bits1", "m", F.col("hub.class_id").alias("hub"), (apart <= MAX_DIFFERENT_BITS).alias("near")), "minhash-faced")
    star = faced.where("near").selectExpr("class_id as u", "hub as v").distinct()

    # what is far from the hub meets all other members, signatures alone
    left_over = faced.where("not near and m > 2")
    steps = left_over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BUCKET_BLOCK)).cast("int").alias("lefts"), F.max(F.ceil(F.col("m") / F.lit(BUCKET_BLOCK))).cast("int").alias("rights"))
    key = ["key", "i", "j"]
    blocks = _sub_blocks(left_over, faced, steps, "key", ["bits0", "bits1"]).repartition(*key).sortWithinPartitions(*key, "every", "class_id")
    rest = blocks.mapInArrow(cross_links(key, "class_id", "every", ("bits0", "bits1"), MAX_DIFFERENT_BITS), "u long, v long")
    return star.union(rest), weights


def _sub_blocks(some: DataFrame, every: DataFrame, steps: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows of ``some`` (every = 0) and of ``every`` (1) of each group of ``steps``, dealt to
    sub-blocks so that each of the first meets each of the second in one (group, i, j)."""
    block = lambda n: F.pmod(F.xxhash64("class_id", F.lit(7)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = some.join(steps, group).select(group, block("lefts").alias("i"), each("rights").alias("j"), "class_id", *columns, F.lit(0).alias("every"))
    right = every.join(steps, group).select(group, each("lefts").alias("i"), block("rights").alias("j"), "class_id", *columns, F.lit(1).alias("every"))
    return left.union(right)


def _links(groups: DataFrame, weights: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All links that connect the members (node) of candidate groups (component)."""
    members = groups.join(weights, F.col("node") == F.col("class_id")).select("component", "class_id", "weight")
    # one row of each class brings its text; whether its side is broadcast, Spark decides by size
    wanted = classes.join(groups, F.col("class_id") == F.col("node"), "left_semi").select("class_id", "h0", "h1", "doc_id")
    found = texts.alias("t").join(wanted.alias("w"), _same_row("t", "w")).select("class_id", "text").dropDuplicates(["class_id"])
    sets = materialize(found.mapInArrow(_sets, "class_id long, shingles binary"), "minhash-sets")
    hubs = members.groupBy("component").agg(F.max_by("class_id", F.struct("weight", "class_id")).alias("a"), F.count("*").alias("m"))

    # a hub with very many members is dealt to several steps, each with a copy of its set
    hubs = materialize(hubs.withColumn("salts", F.ceil(F.col("m") / F.lit(HUB_ROWS)).cast("int")), "minhash-group-hubs")
    pairs = materialize(members.join(hubs, "component").where("class_id <> a"), "minhash-pairs")
    faced = pairs.withColumn("salt", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int")).join(sets, "class_id")
    own = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(sets, F.col("a") == F.col("class_id"))
    rows = faced.select("a", "salt", F.col("class_id").alias("b"), "shingles").union(own.select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    star = materialize(dealt.mapInArrow(_with_hub(percent), "u long, v long"), "minhash-star")

    rest = materialize(pairs.where("m > 2").join(star.select(F.col("v").alias("class_id")), "class_id", "left_anti"), "minhash-rest")
    steps = rest.groupBy("component").agg(F.ceil(F.count("*") / F.lit(REST_BLOCK)).cast("int").alias("lefts"), F.max(F.ceil(F.col("m") / F.lit(ALL_BLOCK))).cast("int").alias("rights"))
    key = ["component", "i", "j"]
    blocks = _sub_blocks(rest, pairs, steps, "component", []).join(sets, "class_id").repartition(*key).sortWithinPartitions(*key, "every", "class_id")
    return star.union(materialize(blocks.mapInArrow(_with_rest(percent), "u long, v long"), "minhash-links"))


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h0, h1, n_shingles of every row; for each class h0, h1, and of its component
    the least doc_id with the hashes of the class that has it)."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    signed = materialize(
        texts.mapInArrow(_sign, "doc_id long, h0 long, h1 long, n_shingles long, bits0 long, bits1 long, keys array<long>"), "minhash"
    )
    with_words = signed.where("n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("bits0", "bits1", "keys")]  # equal in all rows of a class
    classes = with_words.groupBy("h0", "h1").agg(F.min("doc_id").alias("doc_id"), *first)
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "minhash-classes")
    links, weights = _bucket_links(classes)
    groups = materialize(connected_components(links, "minhash-groups"), "minhash-groups")
    merged = connected_components(_links(groups, weights, classes, texts, percent), "minhash-components")

    named = classes.select("h0", "h1", "doc_id", "class_id").join(merged, F.col("class_id") == F.col("node"), "left")
    named = materialize(named.select("h0", "h1", "doc_id", F.coalesce("component", "class_id").alias("component")), "minhash-named")
    # a class without an id comes last
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h0", "h1")).alias("least"))
    placed = materialize(named.select("h0", "h1", "component").join(materialize(least, "minhash-least"), "component").select("h0", "h1", "least"), "minhash-placed")
    return signed.select("doc_id", "h0", "h1", "n_shingles"), placed


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    signed, placed = _grouped(docs, percent)
    # rows without words do not meet in the join, whose other side is one row a class
    some = F.col("n_shingles") > 0
    keyed = signed.select("doc_id", "n_shingles", F.when(some, F.col("h0")).alias("h0"), F.when(some, F.col("h1")).alias("h1"))
    named = keyed.join(placed, ["h0", "h1"], "left")
    return named.selectExpr(
        "doc_id", "n_shingles", "coalesce(least.doc_id, doc_id) as component_id", "coalesce(least.doc_id, doc_id) <=> doc_id as kept"
    )


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one row of each group: of those with the smallest doc_id
    the one whose text comes first by hash. Rows that are equal in doc_id and text count
    once. A row goes by its own text, whatever other rows have its id. Rows without a doc_id
    come last in their group; rows without words stay."""
    _, placed = _grouped(docs, percent)
    winners = placed.where("h0 = least.h0 and h1 = least.h1").select("h0", "h1", "least.doc_id")
    names = {c: _free(docs, f"__{c}") for c in ("h0", "h1", "doc_id")}
    own = {names["h0"]: F.xxhash64("text"), names["h1"]: F.xxhash64(F.lit("second"), "text"), names["doc_id"]: F.col("doc_id").cast("long")}
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.where(worded).withColumns(own)
    hit = (F.col(names["h0"]) == F.col("w.h0")) & (F.col(names["h1"]) == F.col("w.h1")) & F.col(names["doc_id"]).eqNullSafe(F.col("w.doc_id"))
    kept = keyed.join(winners.alias("w"), hit, "left_semi").dropDuplicates(list(names.values())).select(*columns)
    return kept.union(docs.where(~worded).select(*columns))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
