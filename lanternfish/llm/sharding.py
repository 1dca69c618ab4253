"""Sharding by histogram sort.

Rows lie on a line ordered by a 128-bit key. Splitters that cut the line into
shards of near equal bytes are found by counting: each round puts a bounded
number of probes into the interval in which each splitter must lie, one pass
counts the exact bytes and rows below every probe over all partitions, and the
intervals shrink. Once all splitters are within tolerance the rows are
exchanged once, by ranges within the shards, and numbered there.

The passes read a narrow table of keys and sizes, never the texts. Only
DataFrame functions are used; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few, free, named, text_or_empty

_LOW, _SPAN = -(1 << 63), 1 << 64
#: The line's end: keys are pairs of longs, read as one number of 128 bits.
_END = 1 << 128


def _pair(point: int) -> tuple[int, int]:
    high, low = divmod(point, _SPAN)
    return high + _LOW, low + _LOW


def _cell(points: list[int], key: Column | None = None, tie: Column | None = None, first: int = 0) -> Column:
    """How many of the points are at or below a row's key, by halving."""
    if not points:
        return F.lit(first)
    key, tie = F.col("key") if key is None else key, F.col("tie") if tie is None else tie
    middle = len(points) // 2
    high, low = _pair(points[middle])
    below = (key < F.lit(high).cast("long")) | ((key == F.lit(high).cast("long")) & (tie < F.lit(low).cast("long")))
    return F.when(below, _cell(points[:middle], key, tie, first)).otherwise(_cell(points[middle + 1 :], key, tie, first + middle + 1))


def _keys(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A row's size, key and tie."""
    text = text_or_empty(text_col)
    return (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(named(id_col), text).alias("key"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")


def _probes(a: int, b: int, share: float, rows: int, probes: int) -> set[int]:
    """Probes between two points: half of them evenly spread, the others where keys that are spread evenly would have ``share`` of the bytes below them, so far as ``rows`` of them stray."""
    width, even = b - a, max(1, probes // 2)
    at = {a + width * i // (even + 1) for i in range(1, even + 1)}
    stray, n = 4 / (1 + rows) ** 0.5, probes - even
    for i in range(n):
        x = share + stray * (2 * i / max(1, n - 1) - 1)
        at.add(a + int(min(max(x, 0.0), 1.0) * (1 << 52)) * width // (1 << 52))
    return {p for p in at if a < p < b}


def splitters(keyed: DataFrame, n_shards: int, tolerance: float, probes: int) -> list[int]:
    """Points that cut the rows of ``keyed`` (key, tie, size) into shards of near equal size.

    A splitter is done when the bytes below it are within ``tolerance`` times a
    shard's bytes of their goal, or when a single row lies where it may be. A
    round sends at most ``probes * (n_shards - 1) + 1`` counts to the driver.
    """
    counts = F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")
    whole = keyed.agg(*counts).first()
    total = whole["size"] or 0
    goals = [total * s / n_shards for s in range(1, n_shards)]
    slack = tolerance * total / n_shards
    # The points between which each splitter lies, with the bytes and rows below them.
    spans = [((0, 0, 0), (_END, total, whole["rows"]))] * len(goals)
    while True:
        at = set()
        for ((a, size_a, rows_a), (b, size_b, rows_b)), goal in zip(spans, goals, strict=True):
            if b - a > 1 and rows_b - rows_a > 1 and min(abs(size_a - goal), abs(size_b - goal)) > slack:
                at.update(_probes(a, b, (goal - size_a) / max(1, size_b - size_a), rows_b - rows_a, probes))
        points = sorted(at - {0})
        if not points:
            return [min(span, key=lambda k: abs(k[1] - g))[0] for span, g in zip(spans, goals, strict=True)]
        cells = {r["cell"]: r for r in keyed.groupBy(_cell(points).alias("cell")).agg(*counts).collect()}
        known, size, rows = [], 0, 0
        for i, point in enumerate(points):
            if i in cells:
                size, rows = size + cells[i]["size"], rows + cells[i]["rows"]
            known.append((point, size, rows))
        spans = [
            (max((lo, *(k for k in known if lo[0] < k[0] < hi[0] and k[1] <= g))), min((hi, *(k for k in known if lo[0] < k[0] < hi[0] and k[1] > g))))
            for (lo, hi), g in zip(spans, goals, strict=True)
        ]


def histogram_shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
    probes: int = 15,
    ranges: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1. The law is ``bytes``: shards hold near equal sums of size,
    so far as whole rows allow. A shard's rows are in the order of a hash of id and text, then of a
    hash of their place; slot counts them from 0. Rows that repeat an id and text
    share the first hash and may lie in two shards, so that many repeats still spread.

    A null text has size 1 and the crc32 of no bytes; a null id is a value like
    another. No rows give no rows. Other columns of ``docs`` are ignored. Each
    shard is cut into ``ranges`` parts, by default one for each 50,000 rows,
    that tasks number on their own. Which of several equal rows comes first, and so which of them lie
    in which of two shards, follows from the places of the input's files.
    """
    if n_shards < 1 or probes < 1 or (ranges is not None and ranges < 1):
        raise ValueError("n_shards, ranges and probes must be positive")
    size, *key = _keys(id_col, text_col)
    keyed = cut(docs.select(named(id_col).alias("doc_id"), size, F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"), *key))
    cuts = [0, *splitters(keyed, n_shards, tolerance, probes), _END]
    ranges = ranges or 1 + keyed.count() // (n_shards * 50_000)
    # A shard's stretch of the line is cut into equal parts; a part's rows are numbered after those of the parts before it.
    lows = [_pair(a)[0] for a in cuts[:-1]]
    rates = [ranges * _SPAN / max(b - a, 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    placed = keyed.withColumn("shard", _cell(cuts[1:-1]))
    way = (F.col("key").cast("double") - _nth(lows, "double")) * _nth(rates, "double")
    part = F.least(F.greatest(F.floor(way), F.lit(0)), F.lit(ranges - 1)).cast("int")
    placed = placed.withColumn("part", F.col("shard") * ranges + part)
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, seen = [], 0
    for k in range(n_shards * ranges):
        seen = 0 if k % ranges == 0 else seen
        starts.append((k, seen))
        seen += counts.get(k, 0)
    offsets = few(docs.sparkSession.createDataFrame(starts, "part int, start long"), len(starts))
    w = Window.partitionBy("part").orderBy("key", "tie")
    numbered = placed.withColumn("row", F.row_number().over(w) - 1).join(offsets, "part")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _nth(values: list, kind: str) -> Column:
    """The value of a row's shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("shard") + 1)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, probes: int = 15) -> None:
    """Writes ``docs`` as Parquet under ``path``, a folder per shard, rows in the order of their keys.

    The rows go to their shards by their own keys, so that rows that repeat an id are rows like others. Exchanged once.
    """
    names = free(docs.columns, "_shard"), free(docs.columns, "key"), free(docs.columns, "tie")
    size, *key = _keys(id_col, text_col)
    cuts = splitters(cut(docs.select(size, *key)), n_shards, tolerance, probes)
    shard, first, second = names
    rows = docs.withColumns({first: key[0], second: key[1]})
    rows = rows.withColumn(shard, _cell(cuts, F.col(first), F.col(second)))
    parted = rows.repartitionByRange(n_shards * 4, *names).sortWithinPartitions(*names)
    parted.drop(first, second).write.partitionBy(shard).parquet(path)
