"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a structured random product code: after a fixed random rotation a
vector is cut into ``PARTS`` blocks, each block has its own small random code, and a filter
is one codeword of each block. List decoding yields every filter whose inner product with
the vector exceeds a threshold without looking at all of them. Vectors of one label are
joined on common filters. A joined pair stays a candidate if the signs of 128 random
projections, kept beside each filter, do not rule out the cosine (chance of a loss below
1e-8); candidates form candidate components, and in each of these the pairs are verified by
their cosine in double precision.

No pairs are written out. A filter or component with many vectors is cut into sub-blocks,
two of which are compared by one matrix product in a task of bounded size; what a task
returns is, for each vector, how many it links to and one link towards its local component.

Threshold and code size follow from the dimension and the largest label, so that a vector
passes about ``FILTERS`` filters (``LONG_FILTERS`` of a code of three blocks) and unlike vectors do not share more of them in a larger
table: the code gets longer, in the end by a third block, and the threshold rises with it. Of random
pairs at exactly 0.98 fewer than one in a thousand shares no filter, and nearer pairs are
missed far more rarely.

Equal vectors of a label (by 128 bits of hashes) form one class with a count. Defined cases: a null vector, a zero
vector, or one with null or non-finite components links with nothing, nor does any vector
with a null label; repeated rows count as vectors of their own; vectors of different
length never link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components, with_least
from tessera.llm.grouping import SUB_BLOCK, in_sub_blocks, settle, sketch_links, sorted_groups
from tessera.session import materialize, ship

COSINE = 0.98
PARTS = 2  # blocks of the code, one more where the table is large
ALPHA = 0.5  # least inner product with a filter, in up to 64 dimensions
MOST_ALPHA = 0.7  # a narrower cap would part near pairs; in few dimensions it bounds the code
FILTERS = 200  # filters that a vector passes, about
LONG_FILTERS = 1600  # the same for a code of three blocks: of 600 random pairs at 0.98, 200 miss 37, 1200 miss 1
MAX_WORDS = 4096
MAX_DIFFERENT_SIGNS = 28  # of 128; 8 are expected at a cosine of 0.98
SEED = 7


def _threshold(dim: int, largest: int = 0) -> tuple[float, int, int]:
    """(alpha, blocks, codewords of a block) for a dimension and the number of classes of
    the largest label. A small table has the filters that ``ALPHA`` asks for; a larger one
    has ``FILTERS`` of them for each class of its largest label."""
    theta = np.linspace(0, np.pi, 20001)
    share = np.cumsum(np.sin(theta) ** max(0, dim - 2))
    share /= share[-1]  # of directions within an angle
    alpha = min(ALPHA, 8 * ALPHA / np.sqrt(dim))
    cap, least = (share[int(np.searchsorted(theta, np.arccos(x), side="right")) - 1] for x in (alpha, max(alpha, MOST_ALPHA)))
    wanted = min(FILTERS * largest, FILTERS / least)
    parts = min(PARTS, dim)
    if wanted <= FILTERS / cap:
        return alpha, parts, int(np.clip(np.ceil((FILTERS / cap) ** (1 / parts)), 2, MAX_WORDS))
    each = FILTERS
    if wanted > MAX_WORDS**PARTS and dim > PARTS:  # numbers of filters vary more with a third block
        parts, each = PARTS + 1, LONG_FILTERS
        wanted = min(each * largest, each / least)
    words = int(np.clip(np.ceil(float(wanted) ** (1 / parts)), 2, MAX_WORDS))
    angle = theta[int(np.searchsorted(share, each / float(words) ** parts))]
    return float(np.clip(np.cos(angle), alpha, max(alpha, MOST_ALPHA))), parts, words


@lru_cache(maxsize=4)
def code(dim: int, largest: int = 0, seed: int = SEED):
    """(alpha, rotation, codewords of each block, columns of each block, sign directions)."""
    rng = np.random.default_rng([seed, dim])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    alpha, parts, words = _threshold(dim, largest)
    edges = np.linspace(0, dim, parts + 1).astype(int)
    words_of, cols = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        c = rng.normal(size=(words, b - a))
        words_of.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(parts))
        cols.append(slice(a, b))
    return alpha, rotation, words_of, cols, rng.normal(size=(dim, 128))


def list_decode(unit: np.ndarray, largest: int = 0) -> list[np.ndarray]:
    """For each unit vector the numbers of all filters whose product exceeds the threshold.
    Beginnings of filters are extended block by block as long as the best rest can still
    reach it; the words of a block are sorted, so the extensions are the first so many."""
    alpha, rotation, words, cols, _ = code(unit.shape[1], largest)
    turned = unit @ rotation
    scores = [turned[:, c] @ w.T for w, c in zip(words, cols)]
    best_rest = np.cumsum([np.zeros(len(unit)), *(s.max(1) for s in scores[:0:-1])], axis=0)[::-1]  # of the blocks after each
    found = []
    for v in range(len(unit)):
        sums, numbers = np.zeros(1), np.zeros(1, np.int64)
        for k, block in enumerate(scores):
            order = np.argsort(-block[v])
            falling = -block[v][order]  # ascending
            n = np.searchsorted(falling, sums + best_rest[k, v] - alpha, side="right")
            rows, at = np.repeat(np.arange(len(sums)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sums, numbers = sums[rows] - falling[at], numbers[rows] * block.shape[1] + order[at]
        found.append(numbers)
    return found


def signs(unit: np.ndarray) -> np.ndarray:
    """Two words of 64 signs for each vector."""
    return np.packbits(unit @ code(unit.shape[1])[4] > 0, axis=1).view(np.int64)


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    # by the largest component first, so that no square is too large or too small
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                data = some.column("vector").to_pylist()
                lists: list = [None] * len(data)
                bits = np.zeros((len(data), 2), np.int64)
                for dim in {len(v) for v in data}:
                    rows = [i for i, v in enumerate(data) if len(v) == dim]
                    unit = _unit([data[i] for i in rows])
                    bits[rows] = signs(unit)
                    for i, f in zip(rows, list_decode(unit, largest)):
                        # vectors of different length never meet in one filter
                        lists[i] = f + (dim << 40)
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("class_id", "label", "n", "vector")] + [pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(lists, pa.list_(pa.int64()))],
                    names=["class_id", "label", "n", "vector", "signs0", "signs1", "filters"],
                )

    return run


def _verify(cosine: float):
    """Within each (component, i, j): what each vector links to, and a link to a local root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in sorted_groups(batches, ["component", "i", "j"]):
            ids, sub, i, j, counts = (table.column(c).to_numpy() for c in ("class_id", "sub", "i", "j", "n"))
            vectors = table.column("vector").combine_chunks()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = vectors.slice(a, b - a).to_pylist()
                dims = np.array(list(map(len, rows)))
                for dim in set(dims.tolist()):
                    own = np.flatnonzero(dims == dim)
                    unit = _unit([rows[r] for r in own])
                    linked = unit @ unit.T >= cosine
                    at = a + own
                    if i[a] == j[a]:
                        np.fill_diagonal(linked, False)
                    else:
                        linked &= sub[at][:, None] != sub[at][None, :]
                    add = linked @ counts[at]
                    p, q = np.nonzero(np.triu(linked))
                    label = settle(len(own), p, q)
                    hit = np.flatnonzero(add)
                    out.append((ids[at][hit], add[hit], ids[at][label[hit]]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["class_id", "add", "root"])

    return run


def link(vectors: DataFrame, cosine: float = COSINE, sub_block: int = SUB_BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("long"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    ok = F.coalesce(usable, F.lit(False))
    rows = rows.withColumns({"h0": F.when(ok, F.xxhash64("label", "vector")), "h1": F.when(ok, F.xxhash64("vector", F.lit(3), "label"))})
    classes = (
        rows.where("h0 is not null")
        .groupBy("h0", "h1")
        .agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector"))
    )
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "cap-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    coded = materialize(
        classes.mapInArrow(_filters(largest), "class_id long, label long, n long, vector array<double>, signs0 long, signs1 long, filters array<long>"),
        "cap-filters",
    )
    hits = coded.select("label", "class_id", "signs0", "signs1", F.explode("filters").alias("filter"))
    key = ["label", "filter", "i", "j"]
    met = in_sub_blocks(hits, ["label", "filter"], "class_id", sub_block).repartition(*key).sortWithinPartitions(*key, "class_id")
    screen = sketch_links(key, "class_id", ("signs0", "signs1"), MAX_DIFFERENT_SIGNS)
    groups = connected_components(met.mapInArrow(screen, "u long, v long"), "cap-candidates")

    held = groups.join(coded.select("class_id", "n", "vector"), F.col("node") == F.col("class_id")).drop("node")
    key = ["component", "i", "j"]
    faced = in_sub_blocks(held, ["component"], "class_id", sub_block).repartition(*key).sortWithinPartitions(*key, "class_id")
    links = materialize(faced.mapInArrow(_verify(cosine), "class_id long, add long, root long"), "cap-links")

    added = links.groupBy("class_id").agg(F.sum("add").alias("add"))
    comps = connected_components(links.select(F.col("class_id").alias("u"), F.col("root").alias("v")), "cap-components")
    counted = coded.select("class_id", "n").join(added, "class_id", "left").selectExpr("class_id as of", "n - 1 + coalesce(add, 0) as n_links")
    named = with_least(classes.select("class_id", "vec_id"), comps, "class_id", "vec_id", "cap")
    sized = named.join(counted, F.col("class_id") == F.col("of")).select("of", "n_links", "least")
    sized = materialize(sized.join(classes.select(F.col("class_id").alias("of"), "h0", "h1"), "of").drop("of"), "cap-sized")
    placed = rows.select("vec_id", "h0", "h1").join(sized, ["h0", "h1"], "left")
    return placed.selectExpr("vec_id", "coalesce(n_links, 0) as n_links", "coalesce(least, vec_id) as component_id", "coalesce(least, vec_id) <=> vec_id as kept")


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
