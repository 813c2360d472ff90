"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hang(edges: DataFrame, keep: str) -> DataFrame:
    """Join each edge with the least neighbour of u. The sums are partial before the shuffle and the join's hot side can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u").where(keep)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")), least


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of any orderable ids -> (node, root): root is the least node that can be reached.

    Nodes without links are not returned. Each round is written to the shared folder, so that lineage stays short;
    the number of rounds grows with the logarithm of the longest chain. Nothing but a checksum comes to the driver.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _hang(both, "v > u")
        large = written(large.where("u != v").distinct(), "links")
        small, least = _hang(large, "v != m")
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
