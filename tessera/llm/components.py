"""Connected components by alternating large-star and small-star rounds.

Every step is a pre-aggregated minimum and a join, so a node with very many links never
has its links collected. The minima are written before they are joined: both sides of the
join are then plain shuffles, whose large partitions Spark can split, and a small table of
minima is broadcast by Spark's own size check. Each round is written to the shared folder,
which cuts the lineage. Components are named by their smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star round over edges (u, v) with u > v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the links (u, v), both long.

    Self links and repeated links are ignored; an empty table gives an empty result.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        after = materialize(_star(materialize(_star(now, True, name), name), False, name), name)
        after_mark = _mark(after)
        now, same = after, after_mark == mark
        mark = after_mark
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def with_least(rows: DataFrame, components: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, least): for each key of ``rows`` (null keys aside) the least ``value`` among the
    rows of all keys of its component. ``components`` has (node, component) for some keys.

    Rows are reduced to one for each key first; what is joined on a key that may be hot is
    a written table.
    """
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("own"))
    one = one.join(components, F.col(key) == F.col("node"), "left").select(key, "own", F.coalesce("component", key).alias("component"))
    one = materialize(one, f"{name}-keys")
    least = materialize(one.groupBy("component").agg(F.min("own").alias("least")), f"{name}-least")
    return materialize(one.join(least, "component").select(key, "least"), f"{name}-named")
