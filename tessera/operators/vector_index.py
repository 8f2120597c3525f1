"""Approximate and exact nearest neighbours by an inverted file of centroids.

Unit vectors are assigned to the nearest of some centroids, which k-means finds on a bounded sample
(every vector is indexed). A list is a folder. Each vector has a code of one byte a
dimension and the distance between it and what the code says, so a code's score is within
that distance of the true cosine. A search reads the codes of the lists nearest to a request,
and only the candidates that the codes leave meet the request as vectors.

- ``approximate``: the nearest ``probes`` lists; the best few codes are verified. How many
  probes reach the wanted recall is measured when the index is built, on stored vectors
  against their true neighbours.
- ``exact``: the verified n-th best score is a threshold; lists that may hold better vectors,
  by their centroid and radius, are read too, and every code that may reach the
  threshold is verified. Nothing that belongs to the best n is lost, however the lists lie.

Vectors of another length than the indexed one, and requests of such a length, are scanned.
A vector with a null in it is left out, as in :func:`retrieve.cosine_top`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieve
from tessera.operators.retrieve import MATRIX_REQUESTS, request_batches, unit_rows, usable
from tessera.session import materialize, read_text, ship, write_text

FORMAT = 1
SAMPLE = 1 << 16  # vectors that centroids are fitted on, at most
MOST_LISTS = 1024
MEASURED = 64  # stored vectors that the recall is measured with
NEIGHBOURS = 30
RECALL = 0.97
WIDE = 4  # codes that are verified, in results asked for


class FormatError(ValueError):
    """A stored index of another format."""


@dataclass(frozen=True)
class VectorIndex:
    """codes (list, chunk_id, code, error), vectors (list, chunk_id, v) and what is small:
    centroids, radius of each list (as an angle), probes."""

    codes: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    probes: int
    recall: float


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of one byte a dimension, distance of each row from its code)."""
    top = np.abs(unit).max(1, keepdims=True)
    step = np.where(top > 0, top, 1.0) / 127
    codes = np.rint(unit / step).astype(np.int8)
    packed = np.hstack([codes.view(np.uint8), step.astype("<f8").view(np.uint8).reshape(len(unit), 8)])
    return packed, np.linalg.norm(codes * step - unit, axis=1)


def decode(packed: np.ndarray) -> np.ndarray:
    step = np.ascontiguousarray(packed[:, -8:]).view("<f8")
    return packed[:, :-8].view(np.int8) * step


def _assign(centroids: np.ndarray):
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for own in (sizes == dim, sizes != dim):
                batch = whole.take(pa.array(np.flatnonzero(own)))
                n = batch.num_rows
                if not n:
                    continue
                if own is not None and sizes[own][0] == dim:
                    unit = unit_rows(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
                    scores = unit @ centroids.T
                    lists = scores.argmax(1)
                    angle = np.arccos(np.clip(scores[np.arange(n), lists], -1, 1))
                    packed, error = encode(unit)
                    codes = pa.array([row.tobytes() for row in packed], pa.binary())
                else:
                    lists, angle, error, codes = np.full(n, -1), np.zeros(n), np.zeros(n), pa.nulls(n, pa.binary())
                cols = [batch.column("chunk_id"), batch.column("v"), pa.array(lists.astype(np.int32)), codes, pa.array(error), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk_id", "v", "list", "code", "error", "angle"])

    return run


def _centroids(store: DataFrame, dim: int, lists: int, sample: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = store.count()
    some = store.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 1.2 * sample / max(n, 1)))).limit(sample)
    norm = F.sqrt(retrieve.dot(F.col("v"), F.col("v")))
    unit = some.select("v", norm.alias("norm")).where("norm > 0").select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features"))
    unit = materialize(unit, "vector-sample")
    if unit.isEmpty():
        return np.zeros((1, dim))
    return unit_rows(np.array(KMeans(k=max(lists, 2), seed=seed, maxIter=10).fit(unit).clusterCenters()))


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 5) -> VectorIndex:
    """Write the index of (chunk_id, embedding) under ``path`` and return it. Without
    ``lists`` there are as many as the root of the number of vectors, 1024 at most."""
    spark = vectors.sparkSession
    ship(spark)
    store = materialize(vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v")), "vector-store")
    sizes = store.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes.dim, sizes.n) if sizes else (1, 0)
    lists = lists or min(MOST_LISTS, max(2, round(math.sqrt(n))))
    own = store.where(F.size("v") == dim)
    centroids = _centroids(own, dim, lists, sample, seed)
    kind = store.schema["chunk_id"].dataType.simpleString()
    placed = materialize(store.mapInArrow(_assign(centroids), f"chunk_id {kind}, v array<double>, list int, code binary, error double, angle double"), "vector-lists")
    counts = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
    # a list that holds a large share of the rows is dealt to several files
    parts = counts.select("list", F.greatest(F.lit(1), F.ceil(F.col("n") * 8 / max(n, 1))).cast("long").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))  # at most 1025 rows
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "chunk_id")
    dealt.select("list", "chunk_id", "code", "error").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    dealt.select("list", "chunk_id", "v").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    radius = np.zeros(len(centroids))
    for r in counts.where("list >= 0").collect():  # one row a list
        radius[r.list] = r.angle
    said = {"format": FORMAT, "chunk_id": kind, "centroids": centroids.tolist(), "radius": radius.tolist(), "probes": len(centroids), "recall": 1.0}
    index = _opened(spark, path, said)
    said["probes"], said["recall"] = _measured(index, own, recall, seed)
    write_text(spark, f"{path}/index.json", json.dumps(said))
    return _opened(spark, path, said)


def _opened(spark: SparkSession, path: str, said: dict) -> VectorIndex:
    read = lambda name, columns: spark.read.schema(f"chunk_id {said['chunk_id']}, {columns}, list int").parquet(f"{path}/{name}")
    return VectorIndex(read("codes", "code binary, error double"), read("vectors", "v array<double>"), np.array(said["centroids"]), np.array(said["radius"]), said["probes"], said["recall"])


def load(spark: SparkSession, path: str) -> VectorIndex:
    said = json.loads(read_text(spark, f"{path}/index.json") or "{}")
    if said.get("format") != FORMAT:
        raise FormatError(f"index of format {said.get('format')}, expected {FORMAT}")
    return _opened(spark, path, said)


def _measured(index: VectorIndex, store: DataFrame, wanted: float, seed: int) -> tuple[int, float]:
    """The fewest probes with which ``MEASURED`` stored vectors find the wanted share of their
    true neighbours, and that share."""
    asked = store.orderBy(F.xxhash64("chunk_id", F.lit(seed + 1)), "chunk_id").limit(MEASURED).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("embedding"))
    asked = materialize(asked, "vector-measured")
    truth = retrieve.cosine_top(asked, store.withColumnRenamed("v", "embedding"), NEIGHBOURS)
    found = truth.join(index.codes.select("chunk_id", "list"), "chunk_id").select("query_id", "list").collect()  # at most MEASURED x NEIGHBOURS
    rows = {r.query_id: r.embedding for r in asked.collect()}
    if not found:
        return len(index.centroids), 1.0
    order = {q: np.argsort(np.argsort(-(unit_rows(np.array([v])) @ index.centroids.T)[0], kind="stable")) for q, v in rows.items()}
    places = np.sort([order[r.query_id][r.list] for r in found])
    probes = int(places[min(len(places) - 1, math.ceil(wanted * len(places)) - 1)]) + 1
    return probes, float((places < probes).mean())


def _scan(asked: list, unit: np.ndarray, reads: np.ndarray, least: np.ndarray | None, keep: int, query_kind):
    """Codes (list, chunk_id, code, error) that may count: with ``least``, all that may
    reach a request's least score, else the batch's best ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            for one in np.unique(lists):
                who = np.flatnonzero(reads[:, one])
                if not len(who):
                    continue
                rows = np.flatnonzero(lists == one)
                own = batch.take(pa.array(rows))
                packed = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                scores = unit[who] @ decode(packed).T
                if least is None:
                    k = min(keep, len(rows))
                    took = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    q, at = np.repeat(np.arange(len(who)), k), took.ravel()
                else:
                    q, at = np.nonzero(scores + own.column("error").to_numpy() >= least[who][:, None] - 1e-9)
                if len(q):
                    cols = [pa.array([asked[w]["query_id"] for w in who[q].tolist()], query_kind), pa.array(np.full(len(q), one, np.int32)), own.column("chunk_id").take(pa.array(at)), pa.array(scores[q, at])]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "list", "chunk_id", "near"])

    return run


def _verified(candidates: DataFrame, asked: DataFrame, index: VectorIndex) -> DataFrame:
    """Candidates with their cosine; a request's vector comes to its few candidates."""
    met = candidates.join(index.vectors, ["list", "chunk_id"]).join(asked.select("query_id", F.col("v").alias("qv")), "query_id")
    return met.select("query_id", "chunk_id", retrieve.cosine(F.col("qv"), F.col("v")).alias("score"))


def search(requests: DataFrame, index: VectorIndex, n: int, exact: bool = False, probes: int | None = None, wide: int = WIDE, most: int = MATRIX_REQUESTS) -> DataFrame:
    """The best n chunks of each request of (query_id, embedding) with rank and score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = requests.sparkSession
    ship(spark)
    asked = materialize(requests.select("query_id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v")), "vector-requests")
    kinds = requests.schema["query_id"].dataType, index.codes.schema["chunk_id"].dataType
    dim = index.centroids.shape[1]
    rest = index.vectors.where("list = -1").select("chunk_id", F.col("v").alias("embedding"))
    other = asked.where(F.size("v") != dim).select("query_id", F.col("v").alias("embedding"))
    out = retrieve.cosine_top(other, rest, n, most).drop("rank")
    if n <= 0:
        return retrieve.top(out, n)
    schema = f"query_id {kinds[0].simpleString()}, list int, chunk_id {kinds[1].simpleString()}, near double"
    for held in request_batches(asked.where(F.size("v") == dim), most):
        rows, unit = held.by_size[dim] if dim in held.by_size else ([], None)
        if not rows:
            continue
        to_lists = unit @ index.centroids.T
        nearest = np.argsort(-to_lists, axis=1, kind="stable")
        reads = np.zeros(to_lists.shape, bool)
        np.put_along_axis(reads, nearest[:, : probes or index.probes], True, axis=1)

        def scanned(reads, least, keep, rows=rows, unit=unit):
            wanted = np.flatnonzero(reads.any(0)).tolist()
            return index.codes.where(F.col("list").isin(wanted)).mapInArrow(_scan(rows, unit, reads, least, keep, to_arrow_type(kinds[0])), schema)

        own = asked.where(F.col("query_id").isin([r["query_id"] for r in rows])) if len(rows) <= 1000 else asked
        best = retrieve.top(scanned(reads, None, wide * n), wide * n, score="near", rank="nth").select("query_id", "list", "chunk_id")
        found = retrieve.top(_verified(best, own, index), n)
        if exact:
            found = materialize(found, "vector-found")
            nth = {r.query_id: r.score for r in found.where(F.col("rank") == n).select("query_id", "score").collect()}  # one row a request of the batch
            least = np.array([nth.get(r["query_id"], -np.inf) for r in rows])
            gap = np.maximum(0.0, np.arccos(np.clip(to_lists, -1, 1)) - index.radius - 1e-9)
            may = np.cos(gap) >= least[:, None] - 1e-9
            zero = ~unit.any(1)  # no direction: every cosine is 0
            may[zero] = True
            found = retrieve.top(_verified(scanned(may, least, 0).select("query_id", "list", "chunk_id"), own, index), n)
        out = out.unionByName(found.select("query_id", "chunk_id", "score"))
    return retrieve.top(out, n)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall: the share of the true chunks that were found."""
    met = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return met.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
