"""Embedding whitening by a tiled covariance.

Entries become integers, x = floor(64 c) + 1000000, and stay exact until they are centred.
Dimensions are cut into column blocks of ``TILE``; a pair (i, j) of column blocks is a tile
key. Every task cuts its vectors into row blocks and sends out one row for each column
block of a row block: the entries less a whole number near the mean, in as few bytes as
hold them. These rows are shuffled by row block; a task centres the column blocks of a row
block, multiplies the tile pairs and adds up what it has for each tile. The sums of all
tasks are added for each place of a tile, one task assembles the tiles of a fit and
decomposes them, and a last pass projects the vectors.

The fit (sums, components, eigenvalues) is the only thing that passes through the driver:
its size depends on the dimension alone. Vectors of another length are a fit of their own;
fits of more than ``FIT_BYTES`` in all are used in several passes.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped,
and so are vectors without entries (they have no components); repeated rows count each; a
null vec_id stays; an x beyond a long is the nearest long; a deviation that a long cannot
hold is null; a component without variance (its eigenvalue is at most dimension x 2.2e-16
of the largest) has whitened null and takes no part in identity_error; with fewer than 32
dimensions there are as many components as dimensions; an empty table gives no rows; other
columns are ignored. An eigenvector's largest entry is positive (the first of equals).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
TILE = 32  # dimensions of a column block
TILE_BYTES = 64 << 20  # a task passes its tiles on when they take so much
FIT_BYTES = 64 << 20  # components that one pass carries to its tasks
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as longs; what a long cannot hold becomes the nearest one."""
    scaled = np.floor(SCALE * entries.astype(np.float64))
    near = np.abs(scaled) < 2.0**62
    out = np.where(near, scaled, 0.0).astype(np.int64) + SHIFT
    if not near.all():
        out[~near] = [min(max(int(v) + SHIFT, LEAST), MOST) if abs(v) < float("inf") else (MOST if v > 0 else LEAST) for v in scaled[~near]]
    return out


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, x matrix) of the usable vectors of each length."""
    column = batch.column("vector")
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())  # leaves out null vectors
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        rows = values[starts[at][:, None] + np.arange(dim)]
        usable = np.isfinite(rows).all(1)
        if usable.any():
            yield int(dim), at[usable], integers(rows[usable])


def _wide(x: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(abs(int(x.min())), abs(int(x.max())))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of what a task has, one row for each length and dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in matrices(batch):
            own = held.setdefault(dim, [0, np.zeros(dim, object)])
            own[0] += len(x)
            small = _wide(x) * len(x) < MOST
            own[1] = own[1] + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
    for dim, (n, sums) in held.items():
        cols = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], names=["dim", "place", "n", "total"])


class Centre:
    """n, S and the mean S/n as a whole number and a rest, for each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.over = [s - n * int(q) for s, q in zip(sums, self.whole)]  # 0 <= over < n
        self.rest = np.array([r / n for r in self.over])
        self._limit = _wide(self.whole) if len(sums) else 0

    def less_whole(self, x: np.ndarray) -> np.ndarray:
        """x less the whole part of the mean."""
        return x - self.whole if _wide(x) + self._limit < MOST else x.astype(object) - self.whole.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.less_whole(x).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the exact sum of (n x - S)^2; None where a long cannot hold it."""
        less = self.less_whole(x)
        most = self.n * (_wide(less) + 1)
        if len(self.sums) * most * most <= MOST:
            return ((self.n * less - np.array(self.over, np.int64)) ** 2).sum(1).tolist()
        over = np.array(self.over, object)
        exact = ((self.n * less.astype(object) - over) ** 2).sum(1)
        return [int(v) if v <= MOST else None for v in exact]


def _column_blocks(centres: dict[int, Centre], tile: int):
    """Row blocks of a task, a row for each of their column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, _, x in matrices(batch):
                less = centres[dim].less_whole(x)
                if less.dtype == object:
                    less = less.astype(np.float64)
                kind = "<f8" if less.dtype == np.float64 else next(k for k in ("<i1", "<i2", "<i4", "<i8") if _wide(less) < 1 << (8 * int(k[2]) - 1))
                cols = range(0, dim, tile)
                data = [np.ascontiguousarray(less[:, c : c + tile].astype(kind)).tobytes() for c in cols]
                k = len(data)
                arrays = [pa.array([dim] * k, pa.int32()), pa.array([block] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([len(x)] * k, pa.int32()), pa.array([kind] * k), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["dim", "row_block", "column_block", "height", "kind", "data"])
                block += 1

    return run


def _tile_products(centres: dict[int, Centre], tile: int):
    """For rows sorted by (dim, row_block, column_block): what the task has of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        now: tuple[int, int] | None = None

        def multiply() -> None:
            for i, left in enumerate(held):
                for j in range(i, len(held)):
                    product, key = left.T @ held[j], (now[0], i, j)
                    tiles[key] = tiles[key] + product if key in tiles else product
            held.clear()

        def passed() -> pa.RecordBatch:
            keys = list(tiles)
            cols = [pa.array([k[p] for k in keys], pa.int32()) for p in range(3)]
            cols.append(pa.array([tiles[k].ravel() for k in keys], pa.list_(pa.float64())))
            tiles.clear()
            return pa.RecordBatch.from_arrays(cols, names=["dim", "i", "j", "tile"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["row_block"]) != now:
                    if held:
                        multiply()
                    if sum(t.nbytes for t in tiles.values()) > TILE_BYTES:
                        yield passed()
                    now = (row["dim"], row["row_block"])
                at = row["column_block"] * tile
                block = np.frombuffer(row["data"], row["kind"]).reshape(row["height"], -1)
                held.append(block.astype(np.float64) - centres[row["dim"]].rest[at : at + tile])
        if held:
            multiply()
        if tiles:
            yield passed()

    return run


def covariance_tiles(rows: DataFrame, centres: dict[int, Centre], tile: int = TILE) -> DataFrame:
    """(dim, i, j, place, total): each place of each tile of the sum of products."""
    blocks = rows.mapInArrow(_column_blocks(centres, tile), "dim int, row_block long, column_block int, height int, kind string, data binary")
    key = ["dim", "row_block"]
    dealt = blocks.repartition(*key).sortWithinPartitions(*key, "column_block")
    parts = dealt.mapInArrow(_tile_products(centres, tile), "dim int, i int, j int, tile array<double>")
    places = parts.select("dim", "i", "j", F.posexplode("tile").alias("place", "part"))
    return places.groupBy("dim", "i", "j", "place").agg(F.sum("part").alias("total"))


def assemble(dim: int, places: tuple, tile: int) -> np.ndarray:
    """The symmetric matrix of all tiles; places: arrays i, j, place, total."""
    i, j, place, total = places
    width = np.minimum(tile, dim - j * tile)
    r, c = i * tile + place // width, j * tile + place % width
    out = np.empty((dim, dim))
    out[r, c] = out[c, r] = total
    return out


def _decompose(sizes: dict[int, int], components: int, tile: int):
    def run(key, table):
        dim = key[0].as_py()
        v = assemble(dim, tuple(table.column(c).to_numpy() for c in ("i", "j", "place", "total")), tile) / sizes[dim]
        values, vectors = np.linalg.eigh(v)
        k = min(components, dim)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
        cols = [pa.array([dim], pa.int32()), pa.array([float(np.trace(v))]), pa.array([values]), pa.array([vectors.ravel()])]
        return pa.Table.from_arrays(cols, names=["dim", "trace", "eigenvalues", "components"])

    return run


class Fit:
    """What is learned from the vectors of one length."""

    def __init__(self, centre: Centre, trace: float, values: list[float], components: list[float]):
        self.centre, k = centre, len(values)
        self.values = np.array(values)
        self.components = np.array(components).reshape(-1, k)
        least = len(centre.sums) * np.finfo(float).eps * max(self.values[0], 0.0)
        self.live = self.values > least
        self.explained = np.maximum(self.values, 0.0) / trace if trace > 0 else np.full(k, np.nan)
        self.identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; nan where a component has none."""
        scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return (self.centre.centred(x) @ self.components) * scale


def _whitened_products(fits: dict[int, Fit]):
    """Sums and products of whitened rows; they are centred by construction, and what is
    left of their mean is taken off at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                if dim in fits:
                    w = fits[dim].whiten(x)[:, fits[dim].live]
                    w = np.hstack([w, np.ones((len(w), 1))])
                    held[dim] = held.get(dim, 0) + w.T @ w
        for dim, product in held.items():
            flat = product.ravel()
            cols = [pa.array([dim] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["dim", "place", "part"])

    return run


def _rows(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            for dim, at, x in matrices(batch):
                if dim not in fits:
                    continue
                fit = fits[dim]
                k, n = len(fit.values), len(x)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                white, share = fit.whiten(x).ravel(), np.tile(fit.explained, n)
                cols = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array([fit.centre.n] * (n * k), pa.int64()),
                    pa.array(fit.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(share, mask=np.isnan(share)),
                    pa.array([fit.identity_error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Iterator[dict[int, Fit]]:
    """Fits of (vector) rows by length, at most about ``FIT_BYTES`` of them at a time."""
    sums = rows.mapInArrow(_sums, "dim int, place int, n long, total decimal(38,0)")
    sums = materialize(sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "whitening-sums")
    lengths = sorted(r.dim for r in sums.select("dim").distinct().collect())  # lengths, not rows
    while lengths:
        some, size = [], 0
        while lengths and (not some or size + 8 * lengths[0] * components <= FIT_BYTES):
            some.append(lengths.pop(0))
            size += 8 * some[-1] * components
        by_dim: dict[int, list] = {}
        for r in sums.where(F.col("dim").isin(some)).orderBy("dim", "place").collect():  # one row a dimension
            by_dim.setdefault(r.dim, [r.n, []])[1].append(int(r.total))
        centres = {dim: Centre(n, s) for dim, (n, s) in by_dim.items()}
        own = rows.where(F.size("vector").isin(some))
        tiles = covariance_tiles(own, centres, tile)
        found = tiles.groupBy("dim").applyInArrow(_decompose({d: c.n for d, c in centres.items()}, components, tile), "dim int, trace double, eigenvalues array<double>, components array<double>")
        fits = {r.dim: Fit(centres[r.dim], r.trace, r.eigenvalues, r.components) for r in found.collect()}
        products = own.mapInArrow(_whitened_products(fits), "dim int, place int, part double")
        products = products.groupBy("dim", "place").agg(F.sum("part").alias("total")).orderBy("dim", "place").collect()  # components squared
        for dim, f in fits.items():
            k = int(f.live.sum())
            if k:
                m = np.array([r.total for r in products if r.dim == dim]).reshape(k + 1, k + 1) / f.centre.n
                f.identity_error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())
        yield fits


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """One row for each vector and component of (vec_id, embedding): vec_id, component, n,
    deviation, whitened, explained, identity_error."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for fits in fit(rows.select("vector"), components, tile):
        part = rows.where(F.size("vector").isin(list(fits))).mapInArrow(_rows(fits), schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
