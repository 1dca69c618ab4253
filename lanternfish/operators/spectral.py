"""Clusters of points from their neighbour graph or from the leaves of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.forest import grow
from lanternfish.operators.graph import knn_graph, symmetric
from lanternfish.plans.config import ForestConfig
from lanternfish.plans.lineage import cut


def _power_iteration(edges: DataFrame, n_clusters: int, rounds: int) -> DataFrame:
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=n_clusters, maxIter=rounds, initMode="degree", weightCol="weight")
    return pic.assignClusters(edges)


def spectral_clusters(points: DataFrame, n_clusters: int, n_neighbors: int = 32, config: ForestConfig | None = None, rounds: int = 30) -> DataFrame:
    """id, cluster by power iteration over the symmetric neighbour graph, in which near neighbours weigh more. Points without an edge get cluster -1."""
    config = config or ForestConfig(explore=1, include_self=False)
    graph = cut(knn_graph(points, n_neighbors, config))
    edges = symmetric(graph).filter("src < dst")
    near = graph.select(F.least("id", "neighbor_id").alias("src"), F.greatest("id", "neighbor_id").alias("dst"), "sq_dist").groupBy("src", "dst").agg(F.min("sq_dist").alias("sq_dist"))
    width = graph.agg((F.avg("sq_dist") + 1e-12).alias("width"))
    weighed = edges.drop("weight").join(near, ["src", "dst"]).join(F.broadcast(width)).select("src", "dst", F.exp(-F.col("sq_dist") / F.col("width")).alias("weight"))
    found = _power_iteration(cut(weighed), n_clusters, rounds)
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def ensemble_clusters(points: DataFrame, n_clusters: int, config: ForestConfig | None = None, rounds: int = 30) -> DataFrame:
    """id, cluster from the bipartite graph of points and leaves of a forest. Leaves get numbers below zero while points keep theirs, and take part in the clustering only."""
    config = (config or ForestConfig(n_trees=10, min_leaf=32, max_leaf=128)).resolved(1)
    leaves = grow(points, config).assignment
    number = leaves.select("tree", "path").distinct().select("tree", "path", (-1 - F.abs(F.xxhash64("tree", "path") % (1 << 40))).alias("dst"))
    edges = leaves.join(number, ["tree", "path"]).select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    found = _power_iteration(cut(edges), n_clusters, rounds)
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
