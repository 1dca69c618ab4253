"""Near duplicates among embeddings through a pivot-permutation index.

A bounded sample of the vectors, thinned so that no two are alike, serves as
reference points (pivots). Each vector is described by the first pivots of its
permutation: its nearest ones, the nearest first. An inverted list per pivot
holds the vectors that have it among the very first. Retrieval runs list by
list: two vectors of a list are compared if their descriptions share enough
pivots, which signatures count from above, and a pair that is linked counts in
the first of its common lists only. Links are verified by their cosine, rough
in single precision and, near the threshold, in double precision.

A long list is cut into blocks that meet two by two, so no task holds more than
two blocks, and a task returns counts and a star per component, never pairs.
Copies of a vector are compared once. A dense group has about one pivot of its
own, as others would be too near to it, and so is compared in whole in that
pivot's list, however large it is.

``exact`` deals all distinct vectors into one list, which leaves out no pair.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, named
from .components import components

#: Bits of a signature of the pivots that describe a vector, in words of 64.
WORDS = 4


def _usable(c):
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of unit vectors whose cosine is at least ``least``."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    margin = (x.shape[1] + 4) * 2.0**-23
    i, j = np.nonzero(rough >= np.float32(least - margin))
    good = rough[i, j] > np.float32(least + margin)
    close = np.flatnonzero(~good)
    for a in range(0, len(close), 1 << 16):
        at = close[a : a + (1 << 16)]
        good[at] = (x[i[at]] * y[j[at]]).sum(1) >= least
    return i[good], j[good]


def _signatures(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each pivot (-1: none) of each row at its number modulo the width, and how many pivots share bits."""
    bits = np.zeros((len(near), 64 * WORDS), bool)
    row, at = np.nonzero(near >= 0)
    bits[row, near[row, at] % (64 * WORDS)] = True
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return words, (near >= 0).sum(1) - np.bitwise_count(words).sum(1, dtype=np.int64)


def _retrieved(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shared: int) -> np.ndarray:
    """Whether rows of two sides, by their signatures, may share so many pivots: never too few of them."""
    count = np.minimum(a[1][:, None], b[1][None, :]).astype(np.uint8)
    for w in range(WORDS):
        count += np.bitwise_count(a[0][:, w][:, None] & b[0][:, w][None, :])
    return count >= shared


def _first_met(near: np.ndarray, i: np.ndarray, j: np.ndarray, pivot: int) -> np.ndarray:
    """Whether pairs of rows have no common list (columns of ``near``) of a lesser number than ``pivot``."""
    good = np.ones(len(i), bool)
    own = np.where((near >= 0) & (near < pivot), near, -1)
    some = (own >= 0).any(1)
    at = np.flatnonzero(some[i] & some[j])
    for a in range(0, len(at), 1 << 15):
        k = at[a : a + (1 << 15)]
        x, y = own[i[k]], own[j[k]]
        good[k] = ~((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2))
    return good


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node reachable from each of ``n`` nodes by the edges."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[u], label[v])
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _describing(pivots, near: int):
    """Adds the numbers of a vector's nearest pivots, the nearest first; -1 where there are fewer. Numbers of vectors of other lengths than the pivots' are negative, for lists of their own."""

    def run(batches):
        import pyarrow as pa

        p = pivots.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                rows = part.column("vector")
                starts = rows.offsets.to_numpy()
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
                lengths, starts = np.diff(starts), starts - starts[0]
                found = np.full((part.num_rows, near), -1, np.int32)
                own = np.flatnonzero(lengths == p.shape[1])
                if len(own):
                    close = unit(flat[starts[own][:, None] + np.arange(p.shape[1])]).astype(np.float32) @ p.T
                    k = min(near, len(p))
                    chosen = np.argpartition(-close, k - 1, axis=1)[:, :k]
                    order = np.lexsort((chosen, -np.take_along_axis(close, chosen, 1)), axis=1)
                    found[own, :k] = np.take_along_axis(chosen, order, 1)
                other = np.flatnonzero(lengths != p.shape[1])
                found[other, 0] = -1 - lengths[other]
                offsets = pa.array(np.arange(0, found.size + 1, near, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*batch.schema.names, "near"])

    return run


def _comparing(tile: int, least: float, shared: int, lists: int):
    """Links within one list, or between two of its blocks: a row for each linked vector with its links and its star's centre."""

    def run(key, table):
        import pyarrow as pa

        pivot, one, two = (k.as_py() for k in key)
        table = table.sort_by("rep")  # so that the least place is the least id
        ids, weights = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        near = table.column("near").combine_chunks()
        near = near.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        every = pivot < 0  # no index
        words, hidden = _signatures(near)
        rows = table.column("vector").combine_chunks()
        starts = rows.offsets.to_numpy()
        lengths, starts = np.diff(starts), starts - starts[0]
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
        links, stars = np.zeros(len(ids), np.int64), []
        for d in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == d)
            left = of[block[of] == one]
            right = left if one == two else of[block[of] == two]
            if not len(left) or not len(right):
                continue
            x = unit(flat[starts[left][:, None] + np.arange(d)])
            y = x if one == two else unit(flat[starts[right][:, None] + np.arange(d)])
            for a in range(0, len(left), tile):
                for b in range(a if one == two else 0, len(right), tile):
                    u, v = left[a : a + tile], right[b : b + tile]
                    p, q = np.arange(len(u)), np.arange(len(v))
                    if not every:
                        pairs = _retrieved((words[u], hidden[u]), (words[v], hidden[v]), shared)
                        p, q = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
                    i, j = _linked(x[a + p], y[b + q], least)
                    i, j = p[i], q[j]
                    if not every:
                        own = pairs[i, j]
                        i, j = i[own], j[own]
                    u, v = u[i], v[j]
                    if one == two and a == b:  # each pair twice, and each vector with itself
                        u, v = u[u < v], v[u < v]
                    if len(u) and not every:
                        own = _first_met(near[:, :lists], u, v, pivot)
                        u, v = u[own], v[own]
                    if not len(u):
                        continue
                    links += np.bincount(u, weights[v], len(ids)).astype(np.int64) + np.bincount(v, weights[u], len(ids)).astype(np.int64)
                    label = _least(len(ids), u, v)
                    at = np.flatnonzero(label != np.arange(len(ids)))
                    stars.append((at, label[at]))
        at = np.flatnonzero(links)
        label = _least(len(ids), *(np.concatenate(s) for s in zip(*stars, strict=True))) if stars else np.arange(len(ids))
        return pa.table({"rep": ids[at], "links": links[at], "centre": ids[label[at]]})

    return run


def spread(sample: np.ndarray, most: int, alike: float) -> np.ndarray:
    """Of unit vectors the first ``most`` of which none has a cosine of ``alike`` or more with one before it."""
    kept = np.zeros((0, sample.shape[1]), np.float32)
    for a in range(0, len(sample), 512):
        part = sample[a : a + 512].astype(np.float32)
        part = part[~(part @ kept.T >= alike).any(1)] if len(kept) else part
        within, chosen = part @ part.T >= alike, []
        for k in range(len(part)):
            if not within[k, chosen].any():
                chosen.append(k)
        kept = np.concatenate([kept, part[chosen]])[:most]
        if len(kept) == most:
            break
    return kept


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    near: int = 16,
    lists: int = 8,
    shared: int = 3,
    alike: float = 0.7,
    pivots_per_root: float = 16.0,
    most_pivots: int = 16_384,
    block: int = 8192,
    tile: int = 1024,
    exact: bool = False,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least
    ``least`` and the index retrieves them: they have one of their ``lists``
    nearest pivots in common, and ``shared`` of their ``near`` nearest. The
    pivots come from a sample, by a hash, of ``2 * pivots_per_root * sqrt(n)`` of
    the n distinct vectors (twice ``most_pivots`` at most): those half of it at
    most of which no two have a cosine of ``alike``. All vectors are indexed.
    With ``exact`` all pairs are compared instead, in blocks, at a cost that
    grows with their square. component_id is the least id reachable by links.

    Vectors that are null or empty, all zero, or hold a null or a component
    that isn't finite link with nothing, nor do rows without an id; vectors
    link with others of their length only. Pivots have the commonest length of
    the sample, and vectors of another length are all compared with each other. Rows that repeat an id are vectors
    of their own, with one component. No rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    single = vectors.select(named(vector_col)).schema[0].dataType.simpleString() == "array<float>"
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    keys = F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), F.col("vector")).alias("k2")
    usable = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    classes = cut(usable.select("vec_id", "vector", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if exact:
        described = classes.withColumn("near", F.array(F.lit(-1)))
        listed = described.withColumn("pivot", F.lit(-1))
    else:
        most = min(most_pivots, max(16, math.ceil(pivots_per_root * math.sqrt(n))))
        pivots = spark.sparkContext.broadcast(_pivots(classes, n, most, alike))
        kind = "float" if single else "double"
        described = cut(classes.mapInArrow(_describing(pivots, near), f"k1 long, k2 long, rep long, copies long, vector array<{kind}>, near array<int>"))
        # With fewer pivots than a pair must share, each vector has them all.
        shared = min(shared, len(pivots.value))
        listed = described.withColumn("pivot", F.explode(F.filter(F.slice("near", 1, lists), lambda p: p != -1)))
    lengths = listed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    # A row for each pivot, and for each other length of vectors. Some blocks even of a short list, so that several tasks share the work.
    size = F.least(F.lit(block), F.greatest(F.lit(tile), F.ceil(F.col("n") / 8)))
    blocks = F.ceil(F.col("n") / size).cast("int")
    lengths = cut(lengths.filter("n > 1").select("pivot", blocks.alias("blocks")))
    listed = listed.join(few(lengths, lengths.count()), "pivot").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "copies", "vector", "near")
    found = cut(dealt.groupBy("pivot", "one", "two").applyInArrow(_comparing(tile, least, shared, lists), "rep long, links long, centre long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "centre")
    answer = classes.select("k1", "k2", "rep", "copies").join(linked, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    answer = answer.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    # One more key than answer is dealt by, so that the rows of many copies can be split.
    good = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    # Rows that can't link get a key of their own, so that they don't meet in one task.
    keyed = rows.select("vec_id", good.alias("good"), F.when(good, keys[0]).otherwise(F.xxhash64("vec_id", F.lit("none"))).alias("k1"), F.when(good, keys[1]).otherwise(0).alias("k2"))
    answer = answer.withColumn("good", F.lit(True)).withColumn("k3", F.xxhash64("k1", "k2"))
    out = keyed.withColumn("k3", F.xxhash64("k1", "k2")).join(answer, ["k3", "k1", "k2", "good"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _pivots(classes: DataFrame, n: int, most: int, alike: float) -> np.ndarray:
    """The pivots of ``n`` distinct vectors, drawn by a hash of the vectors; at most ``2 * most`` come to the driver."""
    place = F.pmod(F.xxhash64("k1", F.lit("pivot")), F.lit(1 << 40))
    drawn = classes.filter(place < int((1 << 40) * min(1.0, 4 * most / n))).orderBy(place, "rep").limit(2 * most).select("vector").toArrow().column(0).combine_chunks()
    starts, flat = drawn.offsets.to_numpy(), drawn.values.to_numpy(zero_copy_only=False).astype(float)
    lengths = np.diff(starts)
    kinds, times = np.unique(lengths, return_counts=True)
    common = int(kinds[times.argmax()]) if len(kinds) else 1
    sample = flat[starts[:-1][lengths == common][:, None] + np.arange(common)]
    return spread(unit(sample), most, alike) if len(sample) else np.zeros((0, common), np.float32)
