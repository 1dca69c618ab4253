"""Forests of two-point hyperplane trees.

The two members of a node with the smallest md5 of (seed, tree, path, id) are
its anchors; the plane halfway between them parts the node; a side with fewer
than ``min_leaf`` points falls to its sibling; a side of at most ``max_leaf - 2``
points, or an undivided node of at most ``max_leaf``, is a leaf. With ``split``
``projection`` the plane lies across a random direction at the members' median
instead. Paths name nodes: ``r``, then ``L`` or ``R`` a level.

A node whose members fit a task is a cell: its members meet once, and the task
grows the whole subtree, and if asked finds the nearest neighbours within its
leaves. Nodes above are parted a level at a time for all trees together, by two
passes over the points in which only anchors and counts move; the planes there
are few and are held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternfish.functions.arrow import lists, matrix
from lanternfish.functions.vectors import dot, midpoint, sample_key, subtract
from lanternfish.operators import trees as T
from lanternfish.plans.config import ForestConfig
from lanternfish.plans.lineage import cut, few

#: Vectors of a cell take so many bytes at most.
CELL_BYTES = 64 << 20
#: Planes of a forest up to so many bytes are broadcast to route queries.
PLANE_BYTES = 32 << 20
#: Intervals in which the median of a node above the cells is found.
BINS = 4096

MEMBERS = "tree int, cell string, depth int, same int, leaf boolean, id long, vector array<double>"
NODE = "path string, depth int, normal array<double>, offset double, n_left long, n_right long, merged string, left_leaf boolean, right_leaf boolean, halved boolean, same int"
GROWN = f"tree int, cell string, id long, {NODE}, near array<struct<neighbor_id: bigint, sq_dist: double>>"

#: Top nodes by tree and path; cells and leaves among their children by tree and path, with depth, same and whether it is a leaf.
Tops = dict[int, dict[str, T.Node]]


@dataclass
class Forest:
    """assignment: tree, id, path, depth, cell. nodes: tree, path, depth, normal, offset, n_left, n_right, merged, left_leaf, right_leaf, halved, same, cell
    (the node under whose path a task grew it, null above). near: tree, id, near of the ``k`` nearest others within the leaf, where these were asked for."""

    config: ForestConfig
    assignment: DataFrame
    nodes: DataFrame
    tops: Tops = field(default_factory=dict)
    near: DataFrame | None = None
    k: int = 0

    def save(self, path: str) -> None:
        """Writes the forest as Parquet, for :func:`load`."""
        spark = self.assignment.sparkSession
        self.assignment.write.parquet(f"{path}/assignment")
        self.nodes.write.parquet(f"{path}/nodes")
        if self.near is not None:
            self.near.write.parquet(f"{path}/near")
        fields = self.config.__dataclass_fields__
        spark.createDataFrame([(f, repr(getattr(self.config, f))) for f in fields] + [("k", repr(self.k))], "name string, value string").coalesce(1).write.parquet(f"{path}/config")


def load(spark: SparkSession, path: str) -> Forest:
    """A forest that :meth:`Forest.save` wrote."""
    import ast

    values = {r["name"]: ast.literal_eval(r["value"]) for r in spark.read.parquet(f"{path}/config").collect()}
    k = values.pop("k")
    nodes = spark.read.parquet(f"{path}/nodes")
    return Forest(ForestConfig(**values), spark.read.parquet(f"{path}/assignment"), nodes, tops_of(nodes), spark.read.parquet(f"{path}/near") if k else None, k)


def anchors(members: DataFrame, seed: int) -> DataFrame:
    """tree, path, first, second: the vectors of the two anchors of each node of ``members`` (tree, id, path, vector).

    A task sends at most two rows of a node to the shuffle.
    """
    w = Window.partitionBy("tree", "path").orderBy("key", "id")
    keyed = members.withColumn("key", sample_key(seed, F.col("tree"), F.col("path"), F.col("id")))
    two = keyed.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    return two.groupBy("tree", "path").agg(*[F.max(F.when(F.col("n") == i, F.struct("id", "vector"))).alias(c) for i, c in ((1, "first"), (2, "second"))])


def planes(found: DataFrame) -> DataFrame:
    """tree, path, normal, offset of the planes halfway between anchors; null where a node has one member."""
    a, b = F.col("first.vector"), F.col("second.vector")
    normal = subtract(a, b)
    return found.select("tree", "path", normal.alias("normal"), dot(normal, midpoint(a, b)).alias("offset"))


def side(vector: Column, normal: Column, offset: Column) -> Column:
    """R below the plane, else L: a point on the plane is left, as are all without a plane."""
    return F.when(dot(vector, normal) < offset, "R").otherwise("L")


def _at_nodes(shared, seed: int, batch: pa.RecordBatch) -> Iterator[tuple[int, str, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """tree, path, leaf, places of a batch of points (id, vector) after the top nodes, with all ids and vectors."""
    ids, x = batch.column("id").to_numpy(), matrix(batch.column("vector"))
    for tree, nodes in shared.value.items():
        for path, leaf, at in T.routed(nodes, "r", seed, ids, x):
            yield tree, path, leaf, at, ids, x


def _least_members(shared, active, seed: int):
    """tree, path, key, id, vector of the two members of each active node with the least keys in a task."""

    def run(batches):
        best: dict[tuple[int, str], list] = {}
        for batch in batches:
            for tree, path, _, at, ids, x in _at_nodes(shared, seed, batch):
                if (tree, path) in active.value:
                    two = [(key, i, x[at[place]]) for key, i, place in T.least_two(seed, tree, path, ids[at])]
                    best[tree, path] = sorted(best.get((tree, path), []) + two, key=lambda r: r[:2])[:2]
        rows = [(tree, path, key, i, v.tolist()) for (tree, path), two in best.items() for key, i, v in two]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["tree", "path", "key", "id", "vector"])

    return run


def _counts(shared, active, seed: int, bins: int):
    """tree, path, place, n: how many members of an active node are to the left (0) and right (1) of its plane, and of a halving (2, 3); or, with ``bins``, in which interval of its direction, and at place -1 and -2 the ends."""

    def run(batches):
        counts: dict[tuple[int, str, int], float] = {}
        for batch in batches:
            for tree, path, _, at, ids, x in _at_nodes(shared, seed, batch):
                if (tree, path) not in active.value:
                    continue
                normal, offset, stuck, ends = active.value[tree, path]
                along = T.dots(x[at], normal)
                if bins and ends is None:
                    for place, value, how in ((-1, along.min(), min), (-2, along.max(), max)):
                        counts[tree, path, place] = how(counts.get((tree, path, place), value), float(value))
                    continue
                if bins:
                    own = np.clip(((along - ends[0]) / max(ends[1] - ends[0], 1e-300) * BINS).astype(int), 0, BINS - 1)
                    own = dict(zip(*(a.tolist() for a in np.unique(own, return_counts=True)), strict=True))
                else:
                    left = ~(along < offset)
                    own = {0: int(left.sum()), 1: int((~left).sum())}
                    if stuck:
                        half = T.halves(seed, path, ids[at])
                        own |= {2: int(half.sum()), 3: int((~half).sum())}
                for place, n in own.items():
                    counts[tree, path, place] = counts.get((tree, path, place), 0) + n
        rows = [(*k, float(n)) for k, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.float64()), strict=True)], ["tree", "path", "place", "n"])

    return run


def _point_counts(shared, active, seed: int):
    """tree, path, point, n: how many members of an active node are copies of a point, by the md5 of the point."""

    def run(batches):
        import hashlib

        for batch in batches:
            for tree, path, _, at, _, x in _at_nodes(shared, seed, batch):
                if (tree, path) in active.value:
                    found, n = np.unique(T.point_keys(x[at]), return_counts=True)
                    points = [hashlib.md5(v.tobytes()).digest() for v in found]
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(n), pa.int32()), pa.array([path] * len(n), pa.string()), pa.array(points, pa.binary()), pa.array(n, pa.int64())], ["tree", "path", "point", "n"])

    return run


def _dealing(shared, placed, seed: int):
    """A row for each tree of a point: its cell, or the leaf above the cells, with the vector."""

    def run(batches):
        for batch in batches:
            for tree, path, _, at, ids, x in _at_nodes(shared, seed, batch):
                depth, same, leaf = placed.value[tree, path]
                for a in range(0, len(at), 4096):
                    own = at[a : a + 4096]
                    n = len(own)
                    columns = [pa.array([tree] * n, pa.int32()), pa.array([path] * n, pa.string()), pa.array([depth] * n, pa.int32()), pa.array([same] * n, pa.int32()), pa.array([leaf] * n, pa.bool_()), pa.array(ids[own]), lists(x[own])]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "cell", "depth", "same", "leaf", "id", "vector"])

    return run


def _growing(config: ForestConfig, k: int):
    """Grows the subtree of a cell; a row for each of its nodes and for each of its members, with the nearest others in its leaf."""
    from lanternfish.operators.exact import block_function

    def run(key, table):
        tree, cell = (x.as_py() for x in key)
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), matrix(table.column("vector"))
        depth, same, leaf = (table.column(c)[0].as_py() for c in ("depth", "same", "leaf"))
        if leaf:
            nodes, leaves = [], [(cell, depth, np.arange(len(ids)))]
        else:
            nodes, leaves = T.grown(config.seed, tree, cell, depth, same, ids, x, config.min_leaf, config.max_leaf, config.max_depth, config.split)
        top, at = block_function(k, False, True) if k else None, np.concatenate([a for *_, a in leaves])
        sizes = [len(a) for *_, a in leaves]
        near = None
        if k:
            found = [top(ids[a], x[a], ids[a], x[a]) for *_, a in leaves]
            number, others, dists = [], [f[1] for f in found], [f[2] for f in found]
            for (*_, a), f in zip(leaves, found, strict=True):
                number.append(np.bincount(np.searchsorted(ids[a], f[0]), minlength=len(a)))
            entries = pa.StructArray.from_arrays([pa.array(np.concatenate(others)), pa.array(np.concatenate(dists))], ["neighbor_id", "sq_dist"])
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(number))]).astype(np.int32)), entries)
        n, m = len(ids), len(nodes)
        kind = pa.list_(pa.struct([("neighbor_id", pa.int64()), ("sq_dist", pa.float64())]))
        members = {"id": pa.array(ids[at]), "path": pa.array([p for (p, *_), s in zip(leaves, sizes, strict=True) for _ in range(s)], pa.string()), "depth": pa.array(np.repeat([d for _, d, _ in leaves], sizes), pa.int32()), "near": near if near is not None else pa.nulls(n, kind)}
        parts = {
            "path": pa.array([p for p, *_ in nodes], pa.string()), "depth": pa.array([d for _, d, _ in nodes], pa.int32()), "normal": lists(np.array([v.normal for *_, v in nodes])) if m else None,
            **{c: pa.array([getattr(v, c) for *_, v in nodes], t) for c, t in (("offset", pa.float64()), ("n_left", pa.int64()), ("n_right", pa.int64()), ("merged", pa.string()), ("left_leaf", pa.bool_()), ("right_leaf", pa.bool_()), ("halved", pa.bool_()), ("same", pa.int32()))},
        }
        schema = {"tree": pa.int32(), "cell": pa.string(), "id": pa.int64(), "path": pa.string(), "depth": pa.int32(), "normal": pa.list_(pa.float64()), "offset": pa.float64(), "n_left": pa.int64(), "n_right": pa.int64(), "merged": pa.string(), "left_leaf": pa.bool_(), "right_leaf": pa.bool_(), "halved": pa.bool_(), "same": pa.int32(), "near": kind}

        def rows(have: dict, size: int) -> pa.Table:
            have = have | {"tree": pa.array([tree] * size, pa.int32()), "cell": pa.array([cell] * size, pa.string())}
            return pa.table([have[c] if have.get(c) is not None else pa.nulls(size, t) for c, t in schema.items()], names=list(schema))

        return pa.concat_tables([rows(members, n), rows(parts, m)])

    return run


def grow(points: DataFrame, config: ForestConfig, k: int = 0, cell_bytes: int = CELL_BYTES) -> Forest:
    """Grows ``config.n_trees`` trees over the points (id, vector), and with ``k`` finds the ``k`` nearest others of each point in its leaves.

    Ids are unique. Each vector is exchanged once a tree, to its cell. Above cells
    of ``cell_bytes`` a level takes two passes over the points (of projections
    four, and the median is found as the edge of one of 4096 intervals).
    """
    if -1 in (config.n_trees, config.min_leaf, config.max_leaf):
        raise ValueError("the config must be resolved")
    spark = points.sparkSession
    vectors = points.select("id", "vector")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    room = max(2 * config.max_leaf, cell_bytes // (8 * max(1, size["d"] or 1)))
    if size["n"] <= room:
        tops, tree = {}, F.explode(F.sequence(F.lit(0), F.lit(config.n_trees - 1))).alias("tree")
        dealt = vectors.select(tree, F.lit("r").alias("cell"), F.lit(0).alias("depth"), F.lit(0).alias("same"), F.lit(False).alias("leaf"), "id", "vector")
        cells = config.n_trees
    else:
        tops, placed = _tops(vectors, config, room, size["d"])
        dealt = vectors.mapInArrow(_dealing(spark.sparkContext.broadcast(tops), spark.sparkContext.broadcast(placed), config.seed), MEMBERS)
        cells = len(placed)
    parts = min(2 * cells, 20_000)
    found = cut(dealt.repartition(parts, "tree", "cell").groupBy("tree", "cell").applyInArrow(_growing(config, k), GROWN))
    members, inner = found.filter("id IS NOT NULL"), found.filter("id IS NULL").select("tree", *[c.split()[0] for c in NODE.split(", ")], "cell")
    above = [(t, path, len(path) - 1, v.normal.tolist(), v.offset, v.n_left, v.n_right, v.merged, v.left_leaf, v.right_leaf, v.halved, v.same, None) for t, nodes in tops.items() for path, v in nodes.items()]
    nodes = spark.createDataFrame(above, inner.schema).union(inner) if above else inner
    return Forest(config, members.select("tree", "id", "path", "depth", "cell"), nodes, tops, members.select("tree", "id", "near") if k else None, k)


def _tops(vectors: DataFrame, config: ForestConfig, room: int, d: int) -> tuple[Tops, dict]:
    """The nodes of more than ``room`` members, and the depth, same and leaf of their children that are cells or leaves."""
    sc, seed = vectors.sparkSession.sparkContext, config.seed
    tops: Tops = {t: {} for t in range(config.n_trees)}
    active = {(t, "r"): (0, 0) for t in tops}
    placed: dict[tuple[int, str], tuple[int, int, bool]] = {}

    def summed(known: dict, bins: int = 0, ends: bool = False) -> dict[tuple[int, str], dict[int, float]]:
        parts = vectors.mapInArrow(_counts(sc.broadcast(tops), sc.broadcast(known), seed, bins), "tree int, path string, place int, n double")
        n = F.when(F.col("place") == -1, F.min("n")).otherwise(F.max("n")) if ends else F.sum("n")
        out: dict = {}
        for r in parts.groupBy("tree", "path", "place").agg(n.alias("n")).collect():  # a few rows a top node
            out.setdefault((r["tree"], r["path"]), {})[r["place"]] = r["n"]
        return out

    while active:
        if config.split == "projection":
            known = {(t, p): (T.direction(seed, t, p, d), 0.0, False, None) for t, p in active}
            known = {at: (known[at][0], 0.0, False, (n[-1], n[-2])) for at, n in summed(known, BINS, True).items()}
            flat = {}
            for at, n in summed(known, BINS).items():
                below = np.cumsum([n.get(b, 0) for b in range(BINS)])
                edge = int(np.abs(below - below[-1] / 2).argmin()) + 1
                lo, hi = known[at][3]
                flat[at] = known[at][0], lo + (hi - lo) * edge / BINS
        else:
            two = vectors.mapInArrow(_least_members(sc.broadcast(tops), sc.broadcast(set(active)), seed), "tree int, path string, key binary, id long, vector array<double>")
            w = Window.partitionBy("tree", "path").orderBy("key", "id")
            held: dict = {}
            for r in two.withColumn("n", F.row_number().over(w)).filter("n <= 2").orderBy("tree", "path", "n").collect():  # two rows a top node
                held.setdefault((r["tree"], r["path"]), []).append(np.array(r["vector"], float))
            flat = {at: T.halfway(v[0], v[-1]) for at, v in held.items()}
        counts, below = summed({at: (*flat[at], False, None) for at in active}), {}
        sides = {at: (int(counts[at].get(0, 0)), int(counts[at].get(1, 0))) for at in active}
        doubtful = {at for at, (_, same) in active.items() if T.doubtful(at[1], flat[at][0], sides[at], same, config.min_leaf, config.max_leaf)}
        unknown = {at for at in doubtful if active[at][1] < T.HALVED}
        if unknown:
            points = vectors.mapInArrow(_point_counts(sc.broadcast(tops), sc.broadcast(unknown), seed), "tree int, path string, point binary, n long")
            points = points.groupBy("tree", "path", "point").agg(F.sum("n").alias("n")).filter(F.col("n") > config.max_leaf).select("tree", "path").distinct()
            doubtful = doubtful - unknown | {(r["tree"], r["path"]) for r in points.collect()}  # a row a top node
        halved = summed({at: (*flat[at], True, None) for at in doubtful}) if doubtful else {}
        for (t, path), (depth, same) in active.items():
            half = tuple(int(halved[t, path].get(place, 0)) for place in (2, 3)) if (t, path) in halved else None
            node = T.decided(path, depth, *flat[t, path], sides[t, path], half, same, config.min_leaf, config.max_leaf, config.max_depth)
            tops[t][path] = node
            whole = node.n_left + node.n_right
            sizes = {node.merged: whole} if node.merged else {"L": node.n_left, "R": node.n_right}
            for way, size in sizes.items():
                if node.leaf(way) or size <= room:
                    placed[t, path + way] = depth + 1, node.same, node.leaf(way)
                else:
                    below[t, path + way] = depth + 1, node.same
        active = below
    return tops, placed


def tops_of(nodes: DataFrame) -> Tops:
    """The nodes above the cells, of which there are few."""
    tops: Tops = {}
    for tree, path, node in _nodes(nodes.filter("cell IS NULL").toArrow()):
        tops.setdefault(tree, {})[path] = node
    return tops


def _nodes(table: pa.Table) -> Iterator[tuple[int, str, T.Node]]:
    if table.num_rows:
        columns = [table.column(c).to_pylist() for c in ("tree", "path", "offset", "n_left", "n_right", "merged", "left_leaf", "right_leaf", "halved", "same")]
        for normal, (tree, path, *rest) in zip(matrix(table.column("normal")), zip(*columns, strict=True), strict=True):
            yield tree, path, T.Node(normal, *rest)


def leaf_ids(assignment: DataFrame) -> DataFrame:
    """tree, path, leaf_id, n_points, depth: the leaves of each tree numbered from 0 in the order of their paths.

    No leaf's path begins another's, so leaves are numbered within stretches of paths that begin alike, after the stretches before.
    """
    leaves = assignment.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n_points"), F.max("depth").alias("depth"))
    leaves = cut(leaves.withColumn("start", F.substring("path", 1, 13)))
    starts = leaves.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a tree at most
    starts = starts.select("tree", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("tree", "start").orderBy("path")
    return leaves.join(starts, ["tree", "start"]).select("tree", "path", "n_points", "depth", (F.col("first") + F.row_number().over(own) - 1).cast("int").alias("leaf_id"))


def forest_log(assignment: DataFrame) -> DataFrame:
    """tree, depth, max_leaf, min_leaf, total_leaves."""
    leaves = assignment.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n_points"), F.max("depth").alias("depth"))
    return leaves.groupBy("tree").agg(F.max("depth").alias("depth"), F.max("n_points").alias("max_leaf"), F.min("n_points").alias("min_leaf"), F.count(F.lit(1)).alias("total_leaves"))


def log_statistics(log: DataFrame) -> DataFrame:
    """attribute, sum, mean, std (of the population), sem for the numbers of a forest log."""
    names = ["depth", "max_leaf", "min_leaf", "total_leaves"]
    pairs = ", ".join(f"'{n}', cast({n} AS double)" for n in names)
    long = log.selectExpr(f"stack({len(names)}, {pairs}) AS (attribute, value)")
    return long.groupBy("attribute").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))


def leaf_histogram(assignment: DataFrame) -> DataFrame:
    """tree, leaf_size, n_leaves, and with a null tree the leaves of all trees together."""
    sizes = assignment.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("leaf_size")).select("tree", "leaf_size")
    each = sizes.groupBy("tree", "leaf_size").agg(F.count(F.lit(1)).alias("n_leaves"))
    return each.unionByName(each.groupBy("leaf_size").agg(F.sum("n_leaves").alias("n_leaves")).withColumn("tree", F.lit(None).cast("int")))


def bucket_slots(assignment: DataFrame) -> DataFrame:
    """tree, leaf_id, slot, id: each point's place in its leaf, from 0, by id."""
    w = Window.partitionBy("tree", "path").orderBy("id")
    return assignment.join(leaf_ids(assignment).select("tree", "path", "leaf_id"), ["tree", "path"]).select("tree", "leaf_id", (F.row_number().over(w) - 1).cast("int").alias("slot"), "id")


def padded_buckets(assignment: DataFrame) -> DataFrame:
    """tree, leaf_id, bucket_size, members: ids in ascending order, filled up with -1 to the tree's largest leaf."""
    leaf = bucket_slots(assignment).groupBy("tree", "leaf_id").agg(F.array_sort(F.collect_list("id")).alias("members"))  # leaves are bounded
    leaf = cut(leaf.withColumn("bucket_size", F.size("members")))
    most = leaf.groupBy("tree").agg(F.max("bucket_size").alias("most"))  # a row a tree
    filled = F.concat("members", F.array_repeat(F.lit(-1).cast("long"), F.col("most") - F.col("bucket_size")))
    return leaf.join(F.broadcast(most), "tree").select("tree", "leaf_id", "bucket_size", filled.alias("members"))


def unpadded(buckets: DataFrame) -> DataFrame:
    """tree, leaf_id, id without the filling."""
    return buckets.select("tree", "leaf_id", F.explode("members").alias("id")).filter("id <> -1")


def _routing(shared, seed: int, whole: bool):
    """tree, cell, id, path, vector of queries: the leaf to which a query comes, or with ``whole`` false perhaps the cell only."""

    def run(batches):
        held = shared.value
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("vector"))
            for tree, (nodes, cells) in held.items():
                for path, leaf, at in T.routed(nodes, "r", seed, ids, x) if len(ids) else []:
                    cell = next((path[:n] for n in range(1, len(path) + 1) if path[:n] in cells), path) if whole else path
                    for a in range(0, len(at), 4096):
                        own = at[a : a + 4096]
                        n = len(own)
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.int32()), pa.array([cell] * n, pa.string()), pa.array(ids[own]), pa.array([path if whole or leaf else None] * n, pa.string()), lists(x[own])], ["tree", "cell", "id", "path", "vector"])

    return run


def _routing_cell(seed: int):
    def run(key, queries, nodes):
        cell = key[1].as_py()
        held = {path: node for _, path, node in _nodes(nodes)}
        ids, x, done = queries.column("id").to_numpy(), matrix(queries.column("vector")), np.array(queries.column("path").to_pylist(), object)
        at = np.flatnonzero(np.array([p is None for p in done], bool))
        for path, _, own in T.routed(held, cell, seed, ids[at], x[at]) if len(at) else []:
            done[at[own]] = path
        return queries.select(["tree", "cell", "id", "path", "vector"]).set_column(3, "path", pa.array(done, pa.string()))

    return run


ROUTED = "tree int, cell string, id long, path string, vector array<double>"


def routed(queries: DataFrame, forest: Forest, plane_bytes: int = PLANE_BYTES) -> DataFrame:
    """tree, cell, id, path, vector: the leaf of each tree to which a query (id, vector) comes; a side that was merged leads to its sibling.

    Planes of up to ``plane_bytes`` are broadcast, and queries stay where they
    are. Of larger forests only the planes above the cells are, and queries meet the planes of their cells.
    """
    spark, seed = queries.sparkSession, forest.config.seed
    rows = queries.select("id", "vector")
    size = forest.nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("normal")).alias("d")).first()
    trees = range(forest.config.n_trees)
    if not size["n"]:
        return spark.createDataFrame([], ROUTED)
    if size["n"] * size["d"] * 8 <= plane_bytes:
        held: dict = {t: ({}, set()) for t in trees}
        for tree, path, node in _nodes(forest.nodes.toArrow()):
            held[tree][0][path] = node
        for r in forest.nodes.filter("cell IS NOT NULL").select("tree", "cell").distinct().collect():
            held[r["tree"]][1].add(r["cell"])
        return rows.mapInArrow(_routing(spark.sparkContext.broadcast(held), seed, True), ROUTED)
    held = {t: (forest.tops.get(t, {}), set()) for t in trees}
    dealt = rows.mapInArrow(_routing(spark.sparkContext.broadcast(held), seed, False), ROUTED)
    inner = forest.nodes.filter("cell IS NOT NULL")
    return dealt.groupBy("tree", "cell").cogroup(inner.groupBy("tree", "cell")).applyInArrow(_routing_cell(seed), ROUTED)


def route(queries: DataFrame, forest: Forest, plane_bytes: int = PLANE_BYTES) -> DataFrame:
    """tree, id, path of :func:`routed`."""
    return routed(queries, forest, plane_bytes).select("tree", "id", "path")
