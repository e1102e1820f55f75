"""Connected components of a link table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that a link touches; component: the smallest id reachable.

    Alternates the two star steps: large-star hangs each larger neighbour on the smallest neighbour, small-star
    each smaller one. Both keep connectivity and shrink to stars in about log(n) rounds. Minima are taken
    by partial aggregation and written before the join, so that a hub's links stay splittable.
    Links with a null end and links to oneself are ignored; repeated links count once; no links give no rows.
    """
    now = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("p"), F.col(b).alias("q"))
        .where("p is not null and q is not null and p <> q").select("u", "v").distinct()
    )
    before = _state(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(least, now)
        # small-star: u > v in every row of large; u itself goes to its least neighbour too
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        now = cut(
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        release(least, large)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
