"""Stored exact neighbours, against which approximate graphs are measured."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.operators.exact import exact_graph


def ground_truth(points: DataFrame, path: str, k: int, max_k: int = 128, include_self: bool = False) -> DataFrame:
    """id, neighbor_id, sq_dist, rank: the exact ``k`` nearest of each point, out of the ``max_k`` that ``path`` holds.

    Where ``path`` holds no whole table yet, the graph is found and written
    there. Whoever names a path answers for its being of the same points. A
    stored table of fewer than ``k`` neighbours by its ``max_k`` raises.
    """
    if not 0 < k <= max_k:
        raise ValueError("0 < k <= max_k is needed")
    spark = points.sparkSession
    found = _stored(spark, path)
    if found is None:
        graph = exact_graph(points, max_k, include_self).withColumn("max_k", F.lit(max_k)).withColumn("include_self", F.lit(include_self))
        graph.write.mode("overwrite").parquet(path)
        found = _stored(spark, path)
    made = found.select("max_k", "include_self").first()
    if made and (made["max_k"] < k or made["include_self"] != include_self):
        raise ValueError(f"{path} holds {made['max_k']} neighbours, include_self {made['include_self']}")
    return found.filter(F.col("rank") <= k).select("id", "neighbor_id", "sq_dist", "rank")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none or only what a failed write left."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def ground_truths(sets: dict[str, DataFrame], folder: str, k: int, max_k: int = 128, include_self: bool = False) -> dict[str, DataFrame]:
    """:func:`ground_truth` of each named data set, below ``folder``."""
    return {name: ground_truth(points, f"{folder.rstrip('/')}/{name}", k, max_k, include_self) for name, points in sets.items()}
