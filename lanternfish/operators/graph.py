"""Nearest-neighbour graphs and searches over forests, and graph forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternfish.operators.forest import Forest, grow, leaf_ids, routed
from lanternfish.operators.groups import nearest_in_groups
from lanternfish.operators.numbering import sums_before
from lanternfish.operators.prep import random_motion
from lanternfish.operators.topk import nearest
from lanternfish.plans.config import ForestConfig
from lanternfish.plans.lineage import cut

def leaf_candidates(points: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """id, neighbor_id, sq_dist: of each tree's leaf the ``k`` nearest others of each of its points."""
    members = _leaves(points, assignment)
    return nearest_in_groups(members, members.toDF(*members.columns), k, include_self=False, same=True)


def _leaves(points: DataFrame, assignment: DataFrame) -> DataFrame:
    """group, id, vector of the leaves' members."""
    return assignment.select(_leaf().alias("group"), "id").join(points.select("id", "vector"), "id")


def _leaf():
    return F.concat_ws(":", "tree", "path")


def itself(points: DataFrame) -> DataFrame:
    return points.select("id", F.col("id").alias("neighbor_id"), F.lit(0.0).alias("sq_dist"))


def explore(points: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """One round of neighbours of neighbours: those no farther than a point's ``k``-th are measured, and the ``k`` nearest stay. A point never becomes its own neighbour here.

    Each edge carries one vector to the point between; there the points that name
    it meet those that it names, so pairs are measured where both vectors lie and only what may come in moves on.
    """
    edges = graph.select("id", "neighbor_id", "sq_dist")
    others = graph.filter("id <> neighbor_id")
    last = Window.partitionBy("id")
    bound = F.coalesce(F.max(F.when(F.col("rank") == k, F.col("sq_dist"))).over(last), F.lit(float("inf")))
    asking = graph.withColumn("bound", bound).filter("id <> neighbor_id").join(points.select("id", "vector"), "id")
    asking = asking.select(F.col("neighbor_id").alias("group"), "id", "vector", "bound")
    named = points.select(F.col("id").alias("neighbor_id"), "vector")
    members = others.join(named, "neighbor_id").select(F.col("id").alias("group"), F.col("neighbor_id").alias("id"), "vector")
    return nearest(edges.unionByName(nearest_in_groups(asking, members, k, include_self=False, same=True)), k)


def graph_of(points: DataFrame, forest: Forest, k: int, rounds: int = 0, include_self: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """id, neighbor_id, sq_dist, rank over a grown forest; ``seeds`` are candidates that are known already.

    Neighbours that the forest found while it grew are taken from it.
    """
    if forest.near is not None and forest.k >= k:
        found = forest.near.select("id", F.explode(F.slice("near", 1, k)).alias("e")).select("id", "e.*")
    else:
        found = leaf_candidates(points, forest.assignment, k)
    if include_self:
        found = found.unionByName(itself(points))
    if seeds is not None:
        found = found.unionByName(seeds.select("id", "neighbor_id", "sq_dist"))
    graph = nearest(found, k)
    for _ in range(rounds):
        graph = explore(points, cut(graph), k)
    return graph


def knn_graph(points: DataFrame, k: int, config: ForestConfig | None = None) -> DataFrame:
    """The approximate nearest-neighbour graph of the points (id, vector): id, neighbor_id, sq_dist, rank.

    With ``include_self`` a point is its own first neighbour and takes one of
    the ``k`` places. Where leaves may hold too few points, ``ensure_valid`` adds
    a tree whose leaves hold enough and explores again.
    """
    config, points = _ready(points, k, config or ForestConfig())
    graph = graph_of(points, grow(points, config, k), k, config.explore, config.include_self)
    if config.ensure_valid and config.min_leaf < k + 1:
        extra = _extra(config, k)
        graph = graph_of(points, grow(points, extra, k), k, config.explore, config.include_self, cut(graph))
    return graph


def _extra(config: ForestConfig, k: int) -> ForestConfig:
    from dataclasses import replace

    return replace(config, n_trees=1, min_leaf=k + 1, max_leaf=3 * (k + 1))


def _ready(points: DataFrame, k: int, config: ForestConfig) -> tuple[ForestConfig, DataFrame]:
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    config = config.resolved(k, size["n"], size["d"] or 0)
    return config, cut(random_motion(points, config.motion_force, config.seed)) if config.random_motion else points


def search_forest(base: DataFrame, queries: DataFrame, forest: Forest, k: int) -> DataFrame:
    """The ``k`` nearest base points of each query among the leaves that it comes to."""
    asking = routed(queries, forest).select(_leaf().alias("group"), "id", "vector")
    return nearest(nearest_in_groups(cut(asking), _leaves(base, forest.assignment), k), k)


def knn_search(base: DataFrame, queries: DataFrame, k: int, config: ForestConfig | None = None) -> DataFrame:
    """Approximate search: a forest over ``base`` (id, vector), queries (id, vector) routed to its leaves. Exploring isn't part of a search."""
    config, base = _ready(base, k, config or ForestConfig())
    graph = search_forest(base, queries, grow(base, config), k)
    if config.ensure_valid and config.min_leaf < k + 1:
        more = search_forest(base, queries, grow(base, _extra(config, k)), k)
        graph = nearest(graph.drop("rank").unionByName(more.drop("rank")), k)
    return graph


def partition(points: DataFrame, config: ForestConfig | None = None) -> DataFrame:
    """tree, path, id, leaf_id, n_points of one tree over the points; leaves of 32 to 128 points by default."""
    from dataclasses import replace

    config = config or ForestConfig(min_leaf=32, max_leaf=128)
    config = replace(config, n_trees=1).resolved(1)
    points = cut(random_motion(points, config.motion_force, config.seed)) if config.random_motion else points
    forest = grow(points, config)
    return forest.assignment.join(leaf_ids(forest.assignment).drop("depth"), ["tree", "path"]).select("tree", "path", "id", "leaf_id", "n_points")


def symmetric(graph: DataFrame) -> DataFrame:
    """src, dst, weight 1: each edge in both directions, once; loops are left out."""
    forth = graph.select(F.col("id").alias("src"), F.col("neighbor_id").alias("dst"))
    back = graph.select(F.col("neighbor_id").alias("src"), F.col("id").alias("dst"))
    return forth.union(back).filter("src <> dst").distinct().withColumn("weight", F.lit(1.0))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def csr_offsets(edges: DataFrame, points: DataFrame, parts: int | None = None) -> DataFrame:
    """id, degree, indptr: how many edges the points with lesser ids have."""
    degree = points.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return sums_before(degree, "id", "degree", "indptr", parts)


def bipartite(assignment: DataFrame) -> DataFrame:
    """src, dst, weight 1: edges between points and the leaves that hold them, both ways. Points are ``p<id>``, leaves ``t<tree>:<path>``."""
    point, leaf = F.concat(F.lit("p"), F.col("id").cast("string")), F.concat(F.lit("t"), F.col("tree").cast("string"), F.lit(":"), F.col("path"))
    forth = assignment.select(point.alias("src"), leaf.alias("dst"))
    return forth.union(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
