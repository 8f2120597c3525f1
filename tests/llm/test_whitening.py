import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import whitening


def plain(rows, components=32):
    """What the contract says, on the driver: by length, with Python numbers for what is exact."""
    out = {}
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(v) for _, v in usable} - {0}:
        own = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in usable if len(v) == dim]
        n = len(own)
        sums = [sum(x[d] for _, x in own) for d in range(dim)]
        less = np.array([[n * x[d] - sums[d] for d in range(dim)] for _, x in own], object)
        centred = (less / n).astype(float)
        v = centred.T @ centred / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1][:components], q[:, ::-1][:, :components]
        for (i, _), row, c in zip(own, less, centred):
            exact = int((row**2).sum())
            out.setdefault(i, []).append((n, exact if exact < 2**63 else None, [(float(c @ q[:, k]) / math.sqrt(e[k]) if e[k] > dim * 2.3e-16 * e[0] else None, e[k] / np.trace(v) if np.trace(v) else None) for k in range(len(e))]))
    return out


def hold(rows, got, components=32):
    want = plain(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert by_id.keys() == want.keys()
    turn = {}  # each component's sign is free but the same for all rows of a length
    for i, cases in want.items():
        assert len(by_id[i]) == sum(len(white) for _, _, white in cases)
        if len(cases) > 1:
            continue
        n, deviation, white = cases[0]
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, len(white) + 1))
        for r, (w, share) in zip(mine, white):
            assert (r.n, r.deviation) == (n, deviation)
            assert (r.explained is None) == (share is None) and (share is None or abs(r.explained - share) <= 1e-9)
            assert (r.whitened is None) == (w is None)
            if w is not None and abs(w) > 1e-6:
                sign = turn.setdefault((len(white), n, r.component), math.copysign(1, w * r.whitened))
                assert abs(sign * r.whitened - w) <= 1e-6 * max(1, abs(w))
                assert r.identity_error <= 1e-4


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, sf).collect()
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    hold([(r.vec_id, r.embedding) for r in table.collect()], got)
    # the whitened values have the identity as covariance, from the result alone
    w = np.zeros((len(got) // 32, 32))
    place = {v: k for k, v in enumerate(sorted({r.vec_id for r in got}))}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    error = np.abs(np.cov(w.T, bias=True) - np.eye(32)).max()
    assert error <= 1e-6 and abs(error - got[0].identity_error) <= 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0]), (42, [1.0, float("nan"), 0.0, 0.0, 0.0]), (43, [float("inf")] * 5), (44, [])]
    rows += [(45, [0.5] * 5), (45, [0.5] * 5), (46, [-0.0] * 5), (None, [0.25] * 5)]
    rows += [(50, [1.0, 2.0]), (51, [1.0, 3.0]), (52, [2.0, 5.0])]  # another length: a fit of its own
    rows += [(60, [7.0])]  # one vector, no variance
    rows += [(61, [1.0, 1.0, 2.0]), (62, [1.0, 1.0, 4.0])]  # constant dimensions
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "'x' as dim", "1 as n", "'y' as vector", "2 as component", "null as whitened").repartition(3)
    for tile in (2, 32):
        hold(rows, whitening.whiten(df, tile=tile).collect())
    hold(rows, whitening.whiten(df, components=2).collect(), components=2)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id in (40, 43, 44)")).collect() == []


def test_large_entries(spark):
    """Exact beyond a long in between, null where the result is."""
    rows = [(i, [1e9 * (i % 7), 3e12 * (i % 3), 0.125 * i]) for i in range(30)]
    rows += [(100 + i, [1e15 * (i % 2), 2e3 * i, 1.0, float(i % 5)]) for i in range(11)]
    hold(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert whitening.integers(np.array([1e300, -1e300, 0.0, 2.0**55])).tolist() == [2**63 - 1, -(2**63), 1_000_000, 2**61 + 1_000_000]
    top = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(top) == 6 and all(r.deviation is None for r in top)


def test_tiles_are_the_covariance(spark):
    """Any tile width and any dealing of rows gives the same matrix."""
    rng = np.random.default_rng(4)
    x = np.floor(64 * rng.normal(size=(3000, 37)) @ rng.normal(size=(37, 37))).astype(int)
    df = spark.createDataFrame([(i, (row / 64).tolist()) for i, row in enumerate(x)], "vec_id long, vector array<double>").repartition(7)
    centre = whitening.Centre(3000, [int(v) + 3000 * whitening.SHIFT for v in x.sum(0)])
    want = np.cov(x.T, bias=True) * 3000
    for tile in (1, 8, 37, 64):
        places = whitening.covariance_tiles(df.select("vector"), {37: centre}, tile).toPandas()
        got = whitening.assemble(37, tuple(places[c].to_numpy() for c in ("i", "j", "place", "total")), tile)
        assert np.abs(got - want).max() <= 1e-9 * np.abs(want).max()


def test_several_passes(spark, monkeypatch):
    """Fits beyond the bound are used in passes of their own."""
    rows = [(10 * d + i, [float((i * (p + 3)) % 11) for p in range(d)]) for d in (2, 3, 4) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "FIT_BYTES", 1)
    assert len(list(whitening.fit(df.select(F.col("embedding").alias("vector"))))) == 3
    hold(rows, whitening.whiten(df).collect())
