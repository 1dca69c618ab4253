"""Invariants of forests, graphs and searches, on small points."""

import numpy as np
import pytest

from lanternfish.operators import exact, forest, graph, metrics, prep, topk
from lanternfish.plans.config import ForestConfig, auto_trees

CONFIG = ForestConfig(seed=3, n_trees=3, min_leaf=8, max_leaf=24, explore=0, include_self=False)


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(5).normal(size=(120, 6))


@pytest.fixture(scope="module")
def points(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").cache()


@pytest.fixture(scope="module")
def grown(points):
    return forest.grow(points, CONFIG)


def edges(df):
    return {(r.id, r.neighbor_id): r.sq_dist for r in df.collect()}


def brute(vectors, k, include_self=False, base=None):
    base = vectors if base is None else base
    d = ((vectors[:, None] - base[None]) ** 2).sum(2)
    if not include_self and base is vectors:
        np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:k]}


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block": 50}])
def test_exact_graph(points, vectors, how):
    assert set(edges(exact.exact_graph(points, 4, **how))) == brute(vectors, 4)
    own = edges(exact.exact_graph(points, 4, include_self=True, **how))
    assert set(own) == brute(vectors, 4, True) and all(own[i, i] == 0 for i in range(120))


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block": 500}])
@pytest.mark.parametrize("include_self", [False, True])
def test_ties_go_to_the_least_ids(spark, how, include_self):
    """300 copies of one vector, and a grid of whole numbers in which many points are equally near."""
    rng = np.random.default_rng(6)
    tied = np.concatenate([np.full((300, 4), 0.1), rng.integers(0, 3, (200, 4)), rng.normal(size=(100, 4))])[rng.permutation(600)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tied)], "id long, vector array<double>")
    assert set(edges(exact.exact_graph(rows, 4, include_self, **how))) == brute(tied, 4, include_self)


def test_exact_search_of_small_and_empty_tables(spark, points):
    assert exact.exact_graph(points.filter("id < 3"), 10).count() == 6
    assert exact.exact_search(points, points.filter("id < 0"), 5).count() == 0
    assert exact.exact_search(points.filter("id < 0"), points, 5).count() == 0


def test_each_tree_parts_all_points_within_bounds(grown):
    rows = grown.assignment.collect()
    assert len(rows) == len({(r.tree, r.id) for r in rows}) == 3 * 120
    sizes = {}
    for r in rows:
        sizes[r.tree, r.path] = sizes.get((r.tree, r.path), 0) + 1
    assert all(8 <= n <= 24 for n in sizes.values())


def test_same_seed_same_forest_however_dealt(points, grown):
    other = forest.grow(points.repartition(7), CONFIG)
    assert sorted(map(tuple, other.assignment.collect())) == sorted(map(tuple, grown.assignment.collect()))


def test_points_on_the_plane_go_left(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([2.0, 0.0],)], "vector array<double>")
    from pyspark.sql import functions as F

    normal, offset = F.array(F.lit(2.0), F.lit(0.0)), F.lit(2.0)  # between (2, 0) and (0, 0)
    assert [r.s for r in rows.select(forest.side(F.col("vector"), normal, offset).alias("s")).collect()] == ["L", "R", "L"]


def test_few_points_make_one_leaf(points):
    found = forest.grow(points.filter("id < 5"), ForestConfig(n_trees=1, min_leaf=4, max_leaf=8)).assignment
    assert len({r.path for r in found.collect()}) == 1
    assert forest.grow(points.filter("id < 1"), ForestConfig(n_trees=1, min_leaf=1, max_leaf=4)).assignment.count() == 1


def test_queries_from_the_base_come_to_their_own_leaf(points, grown):
    own = {(r.tree, r.id): r.path for r in grown.assignment.collect()}
    assert {(r.tree, r.id): r.path for r in forest.route(points, grown).collect()} == own


def test_graph_over_a_forest(points, vectors, grown):
    plain = edges(graph.graph_of(points, grown, 4, 0, False))
    more = edges(graph.graph_of(points, grown, 4, 1, False))
    for found in (plain, more):
        assert all(i != j and abs(d - ((vectors[i] - vectors[j]) ** 2).sum()) < 1e-9 for (i, j), d in found.items())
        assert all(sum(a == i for a, _ in found) == 4 for i in range(120))
    true = brute(vectors, 4)
    assert len(true & set(more)) >= len(true & set(plain)) >= 0.5 * len(true)


def test_one_leaf_for_all_is_exact(points, vectors):
    config = ForestConfig(n_trees=1, min_leaf=100, max_leaf=300, explore=0, include_self=True)
    assert set(edges(graph.knn_graph(points, 4, config))) == brute(vectors, 4, True)


def test_search_over_a_forest(points, vectors, grown):
    found = edges(graph.search_forest(points, points, grown, 3))
    assert all((i, i) in found for i in range(120))


def test_config():
    c = ForestConfig().resolved(32, 10_000, 100)
    assert (c.min_leaf, c.max_leaf, c.explore, c.n_trees) == (33, 66, 1, 50)
    assert ForestConfig().resolved(33, 10, 2).explore == 0
    assert auto_trees(10**7, 100, 33, 66) == 811
    for bad in (ForestConfig(min_leaf=0), ForestConfig(min_leaf=5, max_leaf=9)):
        with pytest.raises(ValueError):
            bad.resolved(4)
    with pytest.raises(ValueError):
        ForestConfig().resolved(0)


def test_metrics(points, spark):
    true = exact.exact_graph(points, 4)
    assert metrics.nne_rate(true, true, 4).first().recall == 1
    assert metrics.nne_rate(true, true.filter("rank <= 2"), 4).first().recall == 0.5
    assert metrics.recall_eps(true, true, 4, 0.0).first().recall == 1
    assert metrics.missing_neighbors(points, true, 4).count() == 0
    assert metrics.missing_neighbors(points, true.filter("rank <= 3"), 4).first().missing == 1


def test_matrix_is_filled_up(points):
    row = topk.to_matrix(exact.exact_graph(points.filter("id < 2"), 3), points, 3).filter("id = 0").first()
    assert row.indices == [1, -1, -1] and row.sq_dists[1:] == [float("inf")] * 2


def test_jitter_parts_copies_and_leaves_its_input(spark):
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)], "id long, vector array<double>")
    moved = prep.random_motion(same, 1.0).collect()
    assert len({tuple(r.vector) for r in moved}) == 20
    assert all(r.vector[0] == 1.0 and abs(r.vector[1] - r.id % 2) <= 0.05 for r in moved)


def test_csr(points):
    from lanternfish.operators.graph import csr_offsets, symmetric

    rows = csr_offsets(symmetric(exact.exact_graph(points, 3)), points, parts=7).orderBy("id").collect()
    assert [r.indptr for r in rows] == [sum(x.degree for x in rows[:i]) for i in range(len(rows))]


def test_blocks_move_the_base_once(spark):
    """However many blocks the base has; dealt out by pairs of blocks, vectors were exchanged once for each block."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    x = np.random.default_rng(9).normal(size=(2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").cache()
    rows.count()
    before = shuffled()
    found = exact.exact_graph(rows, 3, block=20, broadcast_bytes=0)
    assert set(edges(found)) == brute(x, 3, False)
    assert 0 < shuffled() - before < 4 * x.nbytes
