"""Forests whose nodes are parted above the cells, and groups cut into parts, give what one task gives."""

import numpy as np
import pytest

from lanternfish.operators import exact, forest, graph, ivf, numbering, prep
from lanternfish.operators.groups import nearest_in_groups
from lanternfish.plans.config import ForestConfig

CONFIG = ForestConfig(seed=4, n_trees=3, min_leaf=6, max_leaf=16, explore=0, include_self=False)
SMALL = 8 * 5 * 40  # a cell of 40 points


@pytest.fixture(scope="module")
def vectors():
    """300 points, and 100 copies of one, which no plane parts."""
    x = np.random.default_rng(8).normal(size=(400, 5))
    x[300:] = 0.25
    return x


@pytest.fixture(scope="module")
def points(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").cache()


def leaves(found):
    return {(r.tree, r.id): (r.path, r.depth) for r in found.assignment.collect()}


def test_levels_above_cells_give_the_same_trees(points):
    whole, levels = forest.grow(points, CONFIG), forest.grow(points, CONFIG, cell_bytes=SMALL)
    assert not whole.tops and all(levels.tops.values())
    assert leaves(whole) == leaves(levels) and len(leaves(whole)) == 3 * 400
    columns = ["tree", "path", "depth", "n_left", "n_right", "merged", "left_leaf", "right_leaf", "halved"]
    assert sorted(map(str, whole.nodes.select(*columns).collect())) == sorted(map(str, levels.nodes.select(*columns).collect()))


def test_copies_make_bounded_leaves(points):
    sizes = [r["count"] for r in forest.grow(points, CONFIG).assignment.groupBy("tree", "path").count().collect()]
    assert max(sizes) <= CONFIG.max_leaf


def test_projections_halve(points):
    config = ForestConfig(seed=1, n_trees=2, min_leaf=6, max_leaf=16, split="projection")
    for found in (forest.grow(points.filter("id < 300"), config), forest.grow(points.filter("id < 300"), config, cell_bytes=SMALL)):
        sizes = [r["count"] for r in found.assignment.groupBy("tree", "path").count().collect()]
        assert sum(sizes) == 600 and 6 <= min(sizes) and max(sizes) <= 16
        assert all(abs(r.n_left - r.n_right) <= 2 for r in found.nodes.collect())


@pytest.mark.parametrize("plane_bytes", [1 << 20, 0])
@pytest.mark.parametrize("cell_bytes", [forest.CELL_BYTES, SMALL])
def test_routing_with_planes_sent_or_met(points, cell_bytes, plane_bytes):
    found = forest.grow(points, CONFIG, cell_bytes=cell_bytes)
    own = {(r.tree, r.id): r.path for r in forest.route(points, found, plane_bytes).collect()}
    assert own == {at: path for at, (path, _) in leaves(found).items()}


def test_a_written_forest_is_read_again(spark, points, tmp_path):
    found = forest.grow(points, CONFIG, 3, cell_bytes=SMALL)
    found.save(str(tmp_path / "forest"))
    again = forest.load(spark, str(tmp_path / "forest"))
    assert again.config == CONFIG and again.k == 3 and leaves(again) == leaves(found)
    a, b = (sorted(map(tuple, graph.search_forest(points, points.filter("id < 9"), f, 3).collect())) for f in (found, again))
    assert a == b and len(a) == 27
    assert sorted(map(tuple, graph.graph_of(points, again, 3).collect())) == sorted(map(tuple, graph.graph_of(points, found, 3).collect()))


def test_neighbours_found_while_growing_are_those_of_the_leaves(points):
    bare, near = forest.grow(points, CONFIG), forest.grow(points, CONFIG, 4)
    a, b = ({(r.id, r.neighbor_id): r.rank for r in graph.graph_of(points, f, 4, 0, False).collect()} for f in (bare, near))
    assert a == b


def test_exploring_against_plain_code(points, vectors):
    first = graph.graph_of(points, forest.grow(points, CONFIG, 4), 4, 0, False)
    near = {}
    for r in first.collect():
        near.setdefault(r.id, set()).add(r.neighbor_id)
    d = ((vectors[:, None] - vectors[None]) ** 2).sum(2)
    want = {}
    for i, own in near.items():
        reach = (own | {c for j in own for c in near.get(j, ())}) - {i}
        want[i] = sorted(reach, key=lambda j: (d[i, j], j))[:4]
    got = {}
    for r in graph.explore(points, first, 4).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbor_id
    assert {i: [v[n] for n in sorted(v)] for i, v in got.items()} == want


@pytest.mark.parametrize("most,asking", [(8192, 8192), (30, 8192), (8192, 30), (30, 30)])
def test_parts_of_a_group_miss_nothing(points, vectors, most, asking):
    from pyspark.sql import functions as F

    rows = points.withColumn("group", F.when(F.col("id") < 390, 0).otherwise(F.col("id")))
    from lanternfish.operators.topk import nearest

    found = nearest(nearest_in_groups(rows, rows.toDF(*rows.columns), 3, False, True, most, asking), 3)
    d = ((vectors[:390, None] - vectors[None, :390]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(390) for j in np.lexsort((np.arange(390), d[i]))[:3]}
    assert {(r.id, r.neighbor_id) for r in found.collect()} == want


def test_empty_tables(points):
    none = points.filter("id < 0")
    found = forest.grow(none, CONFIG, 3)
    assert found.assignment.count() == found.nodes.count() == graph.graph_of(none, found, 3).count() == 0
    assert graph.search_forest(none, points, found, 3).count() == 0
    assert graph.search_forest(points, none, forest.grow(points, CONFIG), 3).count() == 0
    assert exact.pairwise(none, points).count() == prep.dedup_vectors(none).count() == 0


def test_all_lists_probed_is_exact(points):
    centres = ivf.hashed_centres(points, 8)
    found = ivf.ivf_search(points, points.filter("id < 20"), 3, centres, 8)
    want = exact.exact_search(points, points.filter("id < 20"), 3)
    assert {(r.id, r.rank): r.neighbor_id for r in found.collect()} == {(r.id, r.rank): r.neighbor_id for r in want.collect()}


def test_pairs_in_blocks(points, vectors):
    found = {(r.left_id, r.right_id): r.sq_dist for r in exact.pairwise(points.filter("id < 50"), points.filter("id >= 30 and id < 70"), 16).collect()}
    assert len(found) == 50 * 40 and all(abs(x - ((vectors[i] - vectors[j]) ** 2).sum()) < 1e-9 for (i, j), x in found.items())


def test_copies_are_numbered(points):
    rows = {r.id: (r.first_id, r.unique_no, r.n_copies) for r in prep.dedup_vectors(points).collect()}
    assert rows == {i: (min(i, 300), min(i, 300), 100 if i >= 300 else 1) for i in range(400)}
    salted, prep.SALTS = prep.SALTS, 7
    try:
        assert {r.id: (r.first_id, r.unique_no, r.n_copies) for r in prep.dedup_vectors(points).collect()} == rows
    finally:
        prep.SALTS = salted


def test_sums_over_ranges(spark):
    rows = spark.createDataFrame([(i * i, i) for i in range(100)], "id long, at long")
    assert {r.id: r.s for r in numbering.sums_before(rows, "id", "at", "s", 9).collect()} == {i * i: sum(range(i)) for i in range(100)}


@pytest.mark.parametrize("cell_bytes", [forest.CELL_BYTES, SMALL])
def test_no_more_copies_than_a_leaf_holds_get_new_anchors_until_parted(spark, cell_bytes):
    """Their node isn't halved by hash, however often its anchors are the same point: the SQL doesn't halve either."""
    x = np.repeat([[0.0] * 5, [1.0] * 5, [9.0] * 5, [10.0] * 5], [16, 6, 16, 6], axis=0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = forest.grow(points, ForestConfig(seed=1, n_trees=24, min_leaf=6, max_leaf=16, explore=0), cell_bytes=cell_bytes)
    assert not found.nodes.filter("halved").count()
    groups = {}
    for (tree, i), (path, _) in leaves(found).items():
        groups.setdefault((tree, path), set()).add(i)
    whole = [set(range(a, b)) for a, b in ((0, 16), (16, 22), (22, 38), (38, 44))]
    assert all(own >= w or not own & w for own in groups.values() for w in whole) and max(map(len, groups.values())) <= 16


def test_a_node_that_no_pair_of_points_parts_ends():
    from lanternfish.operators import trees

    x = np.repeat([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [16, 4, 4], axis=0)
    assert trees.unpartable(x, 5) and not trees.copied(x, 16) and not trees.unpartable(x, 4)
    nodes, found = trees.grown(0, 0, "r", 0, 0, np.arange(24), x, 5, 20, 5000, "points")
    assert len(nodes) < 2 * trees.TRIED and sorted(np.concatenate([at for *_, at in found]).tolist()) == list(range(24))
