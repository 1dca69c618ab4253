"""Exact nearest neighbours by blocks.

A base small enough is sent to all tasks. A larger one is written once to the shared
folder; a task holds some queries, reads the base block by block, and keeps
the k nearest of each query so far. What takes disk is so one copy of the base and
k rows a query, however many blocks there are, and nothing is dealt out by pairs of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.topk import nearest
from lanternfish.plans.lineage import cut, filed, removed

#: A base of up to so many bytes is broadcast.
BROADCAST_BYTES = 32 << 20


#: A matrix of queries and base points has at most so many entries, or one row.
ENTRIES = 1 << 22

#: Vectors of the queries that a task holds while it reads the base take so many bytes at most, or a batch.
HELD_BYTES = 16 << 20

#: So many pairs are measured and ordered at a time.
PAIRS = 1 << 20


def _few_copies(ids, vectors, most: int):
    """The rows by id, but those of a vector beyond its ``most`` least ids: copies are equally near to all, so none of the others comes in."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    if len(np.unique((vectors * vectors).sum(1))) == len(vectors) == len(np.unique(ids)):
        return ids[order], vectors[order]
    seen: dict[bytes, tuple[int, int]] = {}
    chosen = []
    for at in order.tolist():
        key = (vectors[at] + 0.0).tobytes()
        n, last = seen.get(key, (0, None))
        if n < most and ids[at] != last:
            seen[key] = n + 1, ids[at]
            chosen.append(at)
    return ids[chosen], vectors[chosen]


def _same(ids, b_ids):
    """Places in the matrix of queries and base points, in ascending order, whose ids are the same."""
    import numpy as np

    if (b_ids[1:] == b_ids[:-1]).any():
        return np.nonzero(ids[:, None] == b_ids[None, :])
    at = np.minimum(np.searchsorted(b_ids, ids), len(b_ids) - 1)
    own = np.flatnonzero(b_ids[at] == ids)
    return own, at[own]


def block_function(k: int, include_self: bool, same: bool):
    """A function of query ids and vectors, base ids in ascending order and base vectors: the k nearest base points of each query, as its id or with ``places`` its place, their ids and distances. None need be found beyond a query's ``bound``."""

    def measured(q, b_ids, b, may, first):
        """The k nearest, by distance and id, among the base points that each query from ``first`` on may have."""
        import numpy as np

        i, j = np.nonzero(may)
        i += first
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            at = slice(a, a + (1 << 16))
            exact[at] = ((q[i[at]] - b[j[at]]) ** 2).sum(1)
        order = np.lexsort((b_ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        good = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(exact)
        return i[good], b_ids[j[good]], exact[good]

    def top(q_ids, q, b_ids, b, bound=None, places=False):
        import numpy as np

        squares = (b * b).sum(1)
        if not np.isfinite(squares).all():
            b_ids, b, squares = (x[np.isfinite(squares)] for x in (b_ids, b, squares))
        if not len(b_ids):
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        doubled = np.concatenate([-2 * b, squares[:, None]], 1).T
        groups = min(len(b_ids), max(1024, 64 * k))
        out, step = [], max(1, min(1024, ENTRIES // len(b_ids)))
        for a in range(0, len(q_ids), step):
            ids, part = q_ids[a : a + step], q[a : a + step]
            rough = np.concatenate([part, np.ones((len(part), 1))], 1) @ doubled  # less the query's own square
            if same and not include_self:
                rough[_same(ids, b_ids)] = np.inf
            # The k-th least of the groups' least is no nearer than the k-th. All that may be as near, but for rounding, are measured exactly.
            least = rough[:, : len(b_ids) // groups * groups].reshape(len(part), -1, groups).min(1)
            reach = np.partition(least, min(k, groups) - 1, axis=1)[:, min(k, groups) - 1]
            own = (part * part).sum(1)
            if bound is not None:
                reach = np.minimum(reach, bound[a : a + step] - own)
            reach = reach + 8 * (b.shape[1] + 4) * np.finfo(float).eps * (own + squares.max())
            may = rough <= np.minimum(reach, np.finfo(float).max)[:, None]
            ends = may.sum(1).cumsum()
            first = 0
            while first < len(ids):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
                at, *rest = measured(part, b_ids, b, may[first:last], first)
                out.append((at + a if places else ids[at], *rest))
                first = last
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    return top


def _broadcast_map(base, top):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        b_ids, b = base.value
        for batch in batches:
            if batch.num_rows and len(b_ids):
                q = np.array(batch.column(1).to_pylist(), float)
                for a in range(0, len(q), 1024):
                    found = top(batch.column(0).to_numpy()[a : a + 1024], q[a : a + 1024], b_ids, b)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "neighbor_id", "sq_dist"])

    return run


def _file_blocks(folder: str, names: list[str], block: int):
    """Ids and vectors of the base that was written to the shared folder, up to ``block`` rows at a time."""
    import pyarrow.parquet as pq

    from lanternfish.functions.arrow import matrix
    from lanternfish.plans.lineage import file_system

    store, inside = file_system(folder)
    for name in names:
        with store.open_input_file(f"{inside}/{name}") as file:
            for batch in pq.ParquetFile(file).iter_batches(block, columns=["id", "vector"]):
                if batch.num_rows:
                    yield batch.column("id").to_numpy(), matrix(batch.column("vector"))


def _file_map(top, k: int, folder: str, names: list[str], block: int):
    """The k nearest of each query among the base in the shared folder, which is read once for the queries held."""

    def searched(ids, q):
        import numpy as np
        import pyarrow as pa

        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        bound, new, waiting = np.full(len(q), np.inf), [], 0

        def merged():
            at, others, dists = (np.concatenate(x) for x in zip(best, *new, strict=True))
            order = np.lexsort((others, dists, at))
            at, others, dists = at[order], others[order], dists[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            last = rank == k - 1
            bound[at[last]] = dists[last]
            return [c[rank < k] for c in (at, others, dists)]

        for b_ids, b in _file_blocks(folder, names, block):
            new.append(top(ids, q, *_few_copies(b_ids, b, k + 1), bound, True))
            waiting += len(new[-1][0])
            if waiting > len(q) * k // 4:
                best, new, waiting = merged(), [], 0
        best = merged()
        for a in range(0, len(best[0]), 1 << 16):
            at, others, dists = (c[a : a + (1 << 16)] for c in best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others), pa.array(dists)], ["id", "neighbor_id", "sq_dist"])

    def run(batches):
        import pyarrow as pa

        from lanternfish.functions.arrow import matrix

        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if held and sum(x.nbytes for x in held) >= HELD_BYTES:
                rows, held = pa.Table.from_batches(held), []
                yield from searched(rows.column("id").to_numpy(), matrix(rows.column("vector")))
        if held:
            rows = pa.Table.from_batches(held)
            yield from searched(rows.column("id").to_numpy(), matrix(rows.column("vector")))

    return run


def exact_search(base: DataFrame, queries: DataFrame, k: int, include_self: bool = True, same: bool = False, block: int = 8192, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, neighbor_id, sq_dist, rank: the ``k`` nearest points of ``base`` (id, vector) for each query (id, vector).

    Ties go to the least neighbor_id. With ``same`` ids name the same points on both sides, and a point is or isn't its own neighbour as ``include_self`` says.
    A base of more than ``broadcast_bytes`` is read by tasks, ``block`` points at a time.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = base.sparkSession
    top = block_function(k, include_self, same)
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        return queries.sparkSession.createDataFrame([], "id long, neighbor_id long, sq_dist double, rank int")
    schema = "id long, neighbor_id long, sq_dist double"
    if size["n"] * (size["d"] or 0) * 8 <= broadcast_bytes:
        import numpy as np

        rows = base.select("id", "vector").toArrow()
        shared = spark.sparkContext.broadcast(_few_copies(rows.column("id").to_numpy(), np.array(rows.column("vector").to_pylist(), float), k + 1))
        return nearest(queries.select("id", "vector").mapInArrow(_broadcast_map(shared, top), schema), k)
    n = queries.count()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n * (size["d"] or 0) * 8 / HELD_BYTES))
    rows = queries.select("id", "vector").repartition(max(1, min(parts, math.ceil(n / block))))
    folder, names = filed(base.select("id", "vector"), "base")
    try:
        return cut(nearest(rows.mapInArrow(_file_map(top, k, folder, names, block), schema), k))
    finally:
        removed(folder)


def exact_graph(points: DataFrame, k: int, include_self: bool = False, **options) -> DataFrame:
    """The exact nearest-neighbour graph of the points."""
    return exact_search(points, points, k, include_self, same=True, **options)


def _pair_map(queries, base):
    import numpy as np
    import pyarrow as pa

    from lanternfish.functions.arrow import matrix

    a, b = queries.column("id").to_numpy(), base.column("id").to_numpy()
    x, y = matrix(queries.column("vector")), matrix(base.column("vector"))
    found = [((x - v) ** 2).sum(1) if len(x) else np.zeros(0) for v in y]
    found = np.stack(found, 1).ravel() if found else np.zeros(0)
    return pa.table([pa.array(c) for c in (np.repeat(a, len(b)), np.tile(b, len(a)), found)], names=["left_id", "right_id", "sq_dist"])


def pairwise(left: DataFrame, right: DataFrame, block: int = 1024) -> DataFrame:
    """left_id, right_id, sq_dist of all pairs: the feature is the whole matrix, which tasks fill in blocks of ``block`` rows a side."""
    n_left, n_right = (max(1, math.ceil(df.count() / block)) for df in (left, right))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    a, b = dealt(left, "lb", n_left, "rb", n_right), dealt(right, "rb", n_right, "lb", n_left)
    b = b.toDF(*b.columns)  # both sides may come from one table
    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInArrow(_pair_map, "left_id long, right_id long, sq_dist double")
