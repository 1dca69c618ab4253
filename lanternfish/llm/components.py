"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def with_least(rows: DataFrame, at: str, value: str) -> DataFrame:
    """The rows, with the least ``value`` of their ``at`` as ``least``.

    The join has one more key than the aggregation, so that both sides are
    exchanged for it and the rows of a hub can be split between tasks.
    """
    least = rows.groupBy(at).agg(F.min(value).alias("least")).withColumn("k", F.xxhash64(at))
    return rows.withColumn("k", F.xxhash64(at)).join(least, ["k", at]).drop("k")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component for every node of an edge list of integers; component is the least node that is reachable.

    Edges may repeat and point either way; loops and edges with a null count
    for nothing. Each round joins every node with its least neighbour (large
    star) and its lesser neighbours with their least (small star), which keeps
    the components and ends with stars. No edges give no rows.
    """
    whole = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    pairs = whole.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    now = cut(pairs.filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = with_least(both, "x", "y").filter("y > x").select(F.col("y").alias("u"), F.least("x", "least").alias("v")).distinct()
        small = with_least(large, "u", "v")
        stars = F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))
        now = cut(small.select(F.explode(stars).alias("e")).select("e.*").filter("u <> v").distinct())
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.groupBy("v").agg(F.min("v").alias("component")).select(F.col("v").alias("node"), "component"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]
