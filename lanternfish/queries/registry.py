"""Queries over the table ``embeddings`` (and a few others), one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.vectors import sample_key
from lanternfish.operators import exact, forest, graph, ivf, metrics, prep, results, spectral, topk
from lanternfish.plans.config import ForestConfig, auto_trees
from lanternfish.plans.lineage import cut

K = 10
SHALLOW = ForestConfig(seed=0, n_trees=4, min_leaf=32, max_leaf=128, explore=0, include_self=False)
COLLAPSING = ForestConfig(seed=0, n_trees=3, min_leaf=20, max_leaf=60, explore=0, include_self=False)
#: Leaves that may hold fewer than K others.
SCANT = ForestConfig(seed=0, n_trees=1, min_leaf=5, max_leaf=20, explore=0, include_self=False)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.points_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))


def plain(found: DataFrame) -> DataFrame:
    return found.select("id", "neighbor_id", F.round("sq_dist", 6).alias("sq_dist"), F.col("rank").cast("int").alias("rank"))


def searched(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All points, and the stated queries: those whose id is divisible by 50."""
    return points, points.filter("id % 50 = 0")


def grown(points: DataFrame, config: ForestConfig = SHALLOW, k: int = 0) -> forest.Forest:
    return forest.grow(points, config, k)


def exact_knn_graph(spark, sf_dir):
    return plain(exact.exact_graph(embeddings(spark, sf_dir), K))


def exact_knn_graph_blocks(spark, sf_dir):
    return plain(exact.exact_graph(embeddings(spark, sf_dir), K, include_self=True, block=200, broadcast_bytes=0))


def exact_knn_search(spark, sf_dir):
    return plain(exact.exact_search(*searched(embeddings(spark, sf_dir)), K))


def pairwise_sq_l2(spark, sf_dir):
    found = exact.pairwise(*searched(embeddings(spark, sf_dir)))
    return found.select("left_id", "right_id", F.round("sq_dist", 6).alias("sq_dist"))


def knn_matrix(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    rows = topk.to_matrix(graph.graph_of(points, grown(points, SCANT, K), K, 0, False), points, K)
    return rows.select("id", F.explode(F.arrays_zip("indices", F.sequence(F.lit(1), F.lit(K)).alias("place"))).alias("x")).select("id", F.col("x.place").cast("int").alias("place"), F.col("x.indices").alias("neighbor_id"))


def _root(points: DataFrame) -> DataFrame:
    members = points.select(F.lit(0).alias("tree"), "id", F.lit("r").alias("path"), "vector")
    return members.join(F.broadcast(forest.planes(forest.anchors(members, 0))), ["tree", "path"])


def hyperplane_root(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    members = points.select(F.lit(0).alias("tree"), "id", F.lit("r").alias("path"), "vector")
    plane = forest.planes(forest.anchors(members, 0))
    return plane.select("tree", F.posexplode("normal").alias("pos", "value"), "offset").select("tree", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"), F.round("offset", 6).alias("offset"))


def root_side(spark, sf_dir):
    return _root(embeddings(spark, sf_dir)).select("id", forest.side(F.col("vector"), F.col("normal"), F.col("offset")).alias("side"))


def root_side_counts(spark, sf_dir):
    return root_side(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def tree_leaf_assignment(spark, sf_dir):
    return grown(embeddings(spark, sf_dir)).assignment.select("tree", "id", "path", F.col("depth").cast("int").alias("depth"))


def tree_leaf_assignment_collapsing(spark, sf_dir):
    return grown(embeddings(spark, sf_dir), COLLAPSING).assignment.select("tree", "id", "path", F.col("depth").cast("int").alias("depth"))


def tree_leaf_stats(spark, sf_dir):
    return forest.leaf_ids(grown(embeddings(spark, sf_dir), COLLAPSING).assignment).select("tree", "leaf_id", "path", "n_points")


def tree_nodes(spark, sf_dir):
    nodes = grown(embeddings(spark, sf_dir), COLLAPSING).nodes
    return nodes.select("tree", "path", F.col("depth").cast("int").alias("depth"), "n_left", "n_right", F.coalesce("merged", F.lit("-")).alias("merged"))


def leaf_size_histogram(spark, sf_dir):
    rows = forest.leaf_histogram(grown(embeddings(spark, sf_dir)).assignment)
    return rows.select(F.coalesce("tree", F.lit(-1)).alias("tree"), "leaf_size", "n_leaves")


def tree_bucket_slots(spark, sf_dir):
    return forest.bucket_slots(grown(embeddings(spark, sf_dir)).assignment)


def partition_padded(spark, sf_dir):
    rows = forest.padded_buckets(grown(embeddings(spark, sf_dir)).assignment)
    return rows.select("tree", "leaf_id", F.posexplode("members").alias("slot", "id")).select("tree", "leaf_id", F.col("slot").cast("int").alias("slot"), "id")


def partition_tree(spark, sf_dir):
    return graph.partition(embeddings(spark, sf_dir), ForestConfig(seed=0, min_leaf=32, max_leaf=128)).select("leaf_id", "id", "n_points")


def partition_unpadded(spark, sf_dir):
    return forest.unpadded(forest.padded_buckets(grown(embeddings(spark, sf_dir)).assignment))


def forest_log(spark, sf_dir):
    rows = forest.forest_log(grown(embeddings(spark, sf_dir)).assignment)
    return rows.select("tree", F.col("depth").cast("int").alias("depth"), "max_leaf", "min_leaf", "total_leaves")


def forest_log_statistics(spark, sf_dir):
    rows = forest.log_statistics(forest.forest_log(grown(embeddings(spark, sf_dir)).assignment))
    return rows.select("attribute", *[F.round(c, 6).alias(c) for c in ("sum", "mean", "std", "sem")])


def bucket_candidates(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    found = graph.leaf_candidates(points, grown(points).assignment, 128)
    return found.groupBy("id").agg(F.countDistinct("neighbor_id").alias("n_candidates"))


def _graph(spark, sf_dir, rounds: int, include_self: bool):
    points = embeddings(spark, sf_dir)
    return graph.graph_of(points, grown(points, k=K), K, rounds, include_self)


def knn_graph_no_explore(spark, sf_dir):
    return plain(_graph(spark, sf_dir, 0, True))


def knn_graph_no_self(spark, sf_dir):
    return plain(_graph(spark, sf_dir, 0, False))


def knn_graph_explore1(spark, sf_dir):
    return plain(_graph(spark, sf_dir, 1, True))


def knn_graph_explore2(spark, sf_dir):
    return plain(_graph(spark, sf_dir, 2, False))


def knn_graph_ensure_valid(spark, sf_dir):
    """Leaves of 5 to 20 points are too small for 10 neighbours; a tree with larger ones is added."""
    config = ForestConfig(seed=0, n_trees=2, min_leaf=5, max_leaf=20, explore=0, include_self=False)
    return plain(graph.knn_graph(embeddings(spark, sf_dir), K, config))


def query_routing(spark, sf_dir):
    base, queries = searched(embeddings(spark, sf_dir))
    return forest.route(queries, grown(base)).select("tree", "id", "path")


def knn_search_forest(spark, sf_dir):
    base, queries = searched(embeddings(spark, sf_dir))
    return plain(graph.search_forest(base, queries, grown(base), K))


def _truth_and_found(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return exact.exact_graph(points, K), graph.graph_of(points, grown(points, k=K), K, 0, False)


def nne_rate(spark, sf_dir):
    return metrics.nne_rate(*_truth_and_found(spark, sf_dir), K).select(F.round("recall", 6).alias("recall"))


def recall_eps(spark, sf_dir):
    return metrics.recall_eps(*_truth_and_found(spark, sf_dir), K, 0.05).select(F.round("recall", 6).alias("recall"))


def dist_mean(spark, sf_dir):
    return metrics.mean_distance(_truth_and_found(spark, sf_dir)[1]).select(F.round("mean_sq_dist", 6).alias("mean_sq_dist"))


def missing_neighbors(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return metrics.missing_neighbors(points, graph.graph_of(points, grown(points, SCANT, K), K, 0, False), K)


def label_agreement(spark, sf_dir):
    return metrics.label_agreement(exact.exact_graph(embeddings(spark, sf_dir), K), labelled(spark, sf_dir)).select(F.round("agreement", 6).alias("agreement"))


CURVES = [("forest", 0.2, 1.0, 1000), ("forest", 0.5, 2.0, 1000), ("forest", 0.9, 8.0, 1000), ("lists", 0.3, 2.0, 1000), ("lists", 0.6, 9.0, 1000), ("lists", 0.95, 20.0, 1000)]


def _curves(spark):
    return spark.createDataFrame(CURVES, "method string, quality double, seconds double, n_points long")


def throughput_projection(spark, sf_dir):
    at = spark.createDataFrame([(v / 10,) for v in range(2, 10)], "level double")
    found = metrics.project(metrics.throughput(_curves(spark)), at, ["method"], "quality", "points_per_second")
    return found.select("method", F.round("level", 6).alias("level"), F.round("projected", 6).alias("projected"))


def speed_up(spark, sf_dir):
    found = metrics.speed_up(_curves(spark), "lists", [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    return found.select("method", F.round("level", 6).alias("level"), F.round("speed_up", 6).alias("speed_up"))


def results_wide(spark, sf_dir):
    rows = results.no_results(spark)
    for method, quality, seconds, _ in CURVES[:4]:
        rows = results.add(rows, dataset="d", k=K, method=method, param_name="n", param_value=quality * 10, quality_name="recall", quality=quality, seconds=seconds)
    rows = results.wide(rows)
    return rows.select("k", F.round("param_value", 6).alias("param_value"), "forest_seconds", "forest_quality", "lists_seconds", "lists_quality")


def symmetric_graph(spark, sf_dir):
    return graph.symmetric(exact.exact_graph(embeddings(spark, sf_dir), K))


def graph_degree(spark, sf_dir):
    return graph.degrees(symmetric_graph(spark, sf_dir))


def csr_offsets(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return graph.csr_offsets(cut(graph.symmetric(exact.exact_graph(points, K))), points)


def hbgf_bipartite(spark, sf_dir):
    return graph.bipartite(grown(embeddings(spark, sf_dir)).assignment)


def jitter_ranges(spark, sf_dir):
    rows = prep.dimension_ranges(embeddings(spark, sf_dir))
    return rows.select(F.col("pos").cast("int").alias("pos"), *[F.round(c, 9).alias(c) for c in ("lo", "hi", "radius")])


def _components_of(points: DataFrame) -> DataFrame:
    return points.select("id", F.posexplode("vector").alias("pos", "value")).select("id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


def random_motion(spark, sf_dir):
    return _components_of(prep.random_motion(embeddings(spark, sf_dir), 1.0, 0))


def scale_pixels(spark, sf_dir):
    return _components_of(prep.scale_pixels(embeddings(spark, sf_dir)))


def scale_pixels_as_coded(spark, sf_dir):
    return _components_of(prep.scale_pixels(embeddings(spark, sf_dir), as_coded=True))


def _coarse(spark, sf_dir) -> DataFrame:
    """Points with many copies."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") % 7).cast("double"), (F.col("p_size") % 3).cast("double")).alias("vector"))


def dedup_vectors(spark, sf_dir):
    return prep.dedup_vectors(_coarse(spark, sf_dir)).select("id", "first_id", F.col("unique_no").cast("long").alias("unique_no"), "n_copies")


def minmax_label(spark, sf_dir):
    return prep.minmax(labelled(spark, sf_dir), "label", "scaled").select("id", F.round("scaled", 6).alias("scaled"))


def class_names(spark, sf_dir):
    names = spark.createDataFrame([(i, f"class {i}") for i in range(8)], "label int, class_name string")
    return prep.with_class_names(labelled(spark, sf_dir), names).select("id", F.coalesce("class_name", F.lit("-")).alias("class_name"))


def hash_split(spark, sf_dir):
    return prep.hash_split(embeddings(spark, sf_dir), "id", 0.5).select("id", "is_train")


def first_by_hash(spark, sf_dir):
    return prep.first_by_hash(embeddings(spark, sf_dir), "id", 50).select("id")


def uniform_generator(spark, sf_dir):
    return _components_of(prep.uniform_points(spark, 200, 4, 7))


def split_line_generator(spark, sf_dir):
    return _components_of(prep.split_line(spark, 200, 2, 0))


def auto_n_trees(spark, sf_dir):
    size = embeddings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    rows = [(scale, auto_trees(size["n"] * scale, size["d"], 11, 22)) for scale in (1, 1000, 100000)]
    return spark.createDataFrame(rows, "scale long, n_trees long")


def parameter_defaults(spark, sf_dir):
    rows = []
    for k in (1, 10, 32, 33, 64):
        c = ForestConfig().resolved(k, 1000, 64)
        rows.append((k, c.min_leaf, c.max_leaf, c.explore, c.n_trees))
    return spark.createDataFrame(rows, "k long, min_leaf long, max_leaf long, explore long, n_trees long")


def ivf_flat_search(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    centres = ivf.hashed_centres(points, ivf.lists_of(points.count()))
    return plain(ivf.ivf_search(points, points, K, centres, 3))


def ivf_trained_search(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return plain(ivf.ivf_search(points, points, K, ivf.trained_centres(points, ivf.lists_of(points.count())), 3))


def reduced_dimensions(spark, sf_dir):
    return _components_of(prep.reduce_dimensions(embeddings(spark, sf_dir), 8))


def spectral_clusters(spark, sf_dir):
    return spectral.spectral_clusters(embeddings(spark, sf_dir), 5, K, ForestConfig(seed=0, n_trees=4, min_leaf=32, max_leaf=128, explore=1, include_self=False))


def hbgf_clusters(spark, sf_dir):
    return spectral.ensemble_clusters(embeddings(spark, sf_dir), 5, ForestConfig(seed=0, n_trees=4, min_leaf=32, max_leaf=128))


def sample_order(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", sample_key(0, 0, "r", F.col("id")).alias("sample_key"))


_NAMES = """exact_knn_graph exact_knn_graph_blocks exact_knn_search pairwise_sq_l2 knn_matrix sample_order hyperplane_root root_side
root_side_counts tree_leaf_assignment tree_leaf_assignment_collapsing tree_leaf_stats tree_nodes leaf_size_histogram
tree_bucket_slots partition_padded partition_tree partition_unpadded forest_log forest_log_statistics bucket_candidates
knn_graph_no_explore knn_graph_no_self knn_graph_explore1 knn_graph_explore2 knn_graph_ensure_valid query_routing
knn_search_forest nne_rate recall_eps dist_mean missing_neighbors label_agreement throughput_projection speed_up results_wide
symmetric_graph graph_degree csr_offsets hbgf_bipartite jitter_ranges random_motion scale_pixels scale_pixels_as_coded
dedup_vectors minmax_label class_names hash_split first_by_hash uniform_generator split_line_generator
auto_n_trees parameter_defaults ivf_flat_search ivf_trained_search reduced_dimensions spectral_clusters hbgf_clusters"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()}
