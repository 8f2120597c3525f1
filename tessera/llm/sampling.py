"""Bounded samples of whole rows, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 4  # so many times the wanted rows pass the hash filter, about
_UNIT = 1_000_003


def place(key: str):
    """A place in [0, 1) that depends on the key alone (a null key has one too)."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(_UNIT)) / F.lit(float(_UNIT))


def hash_sample(df: DataFrame, n: int, key: str = "doc_id", ties: tuple = ()) -> DataFrame:
    """At most ``n`` rows: those whose keys come first in a hash order.

    Rows are filtered by their hash before they are ordered, so what tasks send to the
    ordering stays near ``MARGIN * n`` rows at any size of the table.
    """
    share = min(1.0, MARGIN * n / max(1, df.count()))
    some = df if share == 1.0 else df.where(place(key) < share)
    return some.orderBy(place(key), F.xxhash64(key), key, *ties).limit(n)
