"""The nearest few candidates of each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(candidates: DataFrame, k: int) -> DataFrame:
    """id, neighbor_id, sq_dist, rank of the ``k`` nearest distinct candidates of each id; ties by neighbor_id.

    Spark keeps k rows of an id in each task before it shuffles (window group limit).
    """
    w = Window.partitionBy("id").orderBy("sq_dist", "neighbor_id")
    distinct = candidates.groupBy("id", "neighbor_id").agg(F.min("sq_dist").alias("sq_dist"))
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def to_wide(graph: DataFrame) -> DataFrame:
    """id, neighbors: an array of (neighbor_id, sq_dist), the nearest first."""
    entry = F.struct("rank", "neighbor_id", "sq_dist")
    plain = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["neighbor_id"].alias("neighbor_id"), e["sq_dist"].alias("sq_dist")))
    return graph.groupBy("id").agg(plain.alias("neighbors"))


def to_matrix(graph: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """id, indices, sq_dists with ``k`` entries for every point; what is missing is -1 and infinity."""
    rows = points.select("id").join(to_wide(graph), "id", "left")
    found = F.coalesce("neighbors", F.array().cast("array<struct<neighbor_id:bigint,sq_dist:double>>"))
    pad = F.lit(k) - F.size(found)
    indices = F.concat(F.transform(found, lambda e: e["neighbor_id"]), F.array_repeat(F.lit(-1).cast("long"), pad))
    dists = F.concat(F.transform(found, lambda e: e["sq_dist"]), F.array_repeat(F.lit(float("inf")), pad))
    return rows.select("id", indices.alias("indices"), dists.alias("sq_dists"))
