"""Inverted-list search: base points in the list of their nearest centre, queries in the lists of a few."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.vectors import sample_key
from lanternfish.operators.exact import exact_search
from lanternfish.operators.groups import nearest_in_groups
from lanternfish.operators.topk import nearest
from lanternfish.plans.lineage import cut


def hashed_centres(points: DataFrame, n_lists: int, seed: int = 0) -> DataFrame:
    """id, vector of the first ``n_lists`` points in the order of a hash."""
    return points.orderBy(sample_key(seed, F.col("id")), "id").limit(n_lists).select("id", "vector")


def trained_centres(points: DataFrame, n_lists: int, seed: int = 0, rounds: int = 10) -> DataFrame:
    """id, vector of k-means centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=rounds).fit(rows)
    return points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "id long, vector array<double>")


def lists_of(n_points: int) -> int:
    """The usual number of lists: the square root of the number of points."""
    return max(1, math.isqrt(n_points))


def ivf_search(base: DataFrame, queries: DataFrame, k: int, centres: DataFrame, n_probe: int) -> DataFrame:
    """id, neighbor_id, sq_dist, rank: the ``k`` nearest base points in the ``n_probe`` lists nearest to each query."""
    listed = exact_search(centres, base, 1).select("id", F.col("neighbor_id").alias("group")).join(base.select("id", "vector"), "id")
    probed = exact_search(centres, queries, n_probe).select("id", F.col("neighbor_id").alias("group")).join(queries.select("id", "vector"), "id")
    return nearest(nearest_in_groups(cut(probed), cut(listed), k), k)
