"""Every registered query against its oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.operators import gate
from tessera.plans import catalogue, fixtures

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert rows
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_seeded_bootstrap_takes_all_resamples(spark, sf):
    order = lambda df: sorted(map(tuple, df.collect()))
    got = order(QUERIES["paired_bootstrap_exact"](spark, sf))
    assert got == order(gate.paired_bootstrap_exact(fixtures.runs(spark, sf), resamples=1000))
