"""Nearest neighbours within groups of any size: leaves, inverted lists, the edges of a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.arrow import matrix, runs
from lanternfish.operators.exact import block_function
from lanternfish.plans.lineage import cut, few

CANDIDATES = "id long, neighbor_id long, sq_dist double"
#: A part of a group has about so many members and queries at most.
MEMBERS, QUERIES = 8192, 8192


def _joined(found: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "neighbor_id", "sq_dist"])


def _meeting(k: int, include_self: bool, same: bool):
    """The k nearest members of each query in stretches of rows of one part of a group; none farther than the query's bound."""
    top = block_function(k, include_self, same)

    def run(batches: Iterator[pa.RecordBatch]):
        out, n = [], 0
        for table in runs(batches, ["group", "block", "deal"]):
            asks = table.column("asks").to_numpy()
            if asks.all() or not asks.any():
                continue
            ids, x, bound = table.column("id").to_numpy(), matrix(table.column("vector")), table.column("bound").to_numpy()
            base = np.flatnonzero(~asks)
            base = base[np.argsort(ids[base], kind="stable")]
            asking = np.flatnonzero(asks)
            asking = asking[np.argsort(ids[asking], kind="stable")]
            found = top(ids[asking], x[asking], ids[base], x[base])
            near = found[2] <= bound[asking][np.searchsorted(ids[asking], found[0])]
            out.append([c[near] for c in found])
            n += len(out[-1][0])
            if n >= 1 << 14:
                yield _joined(out)
                out, n = [], 0
        if out:
            yield _joined(out)

    return run


def nearest_in_groups(queries: DataFrame, members: DataFrame, k: int, include_self: bool = True, same: bool = False, most: int = MEMBERS, asking: int = QUERIES) -> DataFrame:
    """id, neighbor_id, sq_dist: candidates for the ``k`` nearest of each query among the members of its groups.

    ``queries`` (group, id, vector, and perhaps bound, beyond which nothing is
    wanted) and ``members`` (group, id, vector) meet by group; an id is in a group
    once. A group of more than ``most`` members is cut into blocks, to each of which its queries go,
    and one of more than ``asking`` queries into deals, to each of which its members go, so
    that a task holds one small part at a time.
    """
    if "bound" not in queries.columns:
        queries = queries.withColumn("bound", F.lit(float("inf")))
    rows = queries.select("group", "id", "vector", "bound", F.lit(True).alias("asks"))
    rows = rows.union(members.select("group", "id", "vector", F.lit(0.0), F.lit(False)))
    sizes = queries.select("group", F.lit(1).alias("q"), F.lit(0).alias("m")).union(members.select("group", F.lit(0), F.lit(1))).groupBy("group")
    parts = [F.ceil(F.col(c) / n).cast("int") for c, n in (("m", most), ("q", asking))]
    hot = sizes.agg(F.sum("q").alias("q"), F.sum("m").alias("m")).filter((F.col("q") > asking) | (F.col("m") > most))
    hot = cut(hot.select("group", F.greatest(parts[0], F.lit(1)).alias("blocks"), F.greatest(parts[1], F.lit(1)).alias("deals")))
    blocks, deals = F.coalesce("blocks", F.lit(1)), F.coalesce("deals", F.lit(1))

    def dealt(n, every):
        return F.when(every, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), n).cast("int")))

    rows = rows.join(few(hot, hot.count()), "group", "left").withColumn("blocks", blocks).withColumn("deals", deals)
    rows = rows.withColumn("block", F.explode(dealt(F.col("blocks"), F.col("asks")))).withColumn("deal", F.explode(dealt(F.col("deals"), ~F.col("asks"))))
    rows = rows.select("group", "block", "deal", "asks", "id", "vector", "bound")
    return rows.repartition("group", "block", "deal").sortWithinPartitions("group", "block", "deal").mapInArrow(_meeting(k, include_self, same), CANDIDATES)
