"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix consists of blocks of equal numbers of words. Blocks are seats: each
goes to the source with the highest quotient of its target and 1, 3, 5, ...,
which is found at once as the divisor at which the rounded quotients sum to the
number of seats. A source's quota is apportioned among its shards in the same
way, by their words. Within a shard, documents lie in a seeded order on a line
of words cut into blocks; a quota of q blocks over n takes every block q // n
times and q % n of them, one after the other (round the line's end) from a
seeded start, once more. What a document gives follows from its stretch of the
line by arithmetic, so that no block is ever a row, and all documents but those
at the ends of a run are taken whole.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, few, named, text_or_empty


def sainte_lague(votes: list[int | Fraction], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 q + 1); ties go to the earlier party.

    ``most`` bounds the seats of each party; a party that is full drops out and
    the rest go on. Fewer than ``seats`` are given only when all are full.
    """
    most = most if most is not None else [seats] * len(votes)
    most = [m if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    seats = min(seats, sum(most))
    if seats <= 0:
        return [0] * len(votes)

    def given(d: Fraction) -> list[int]:
        """Seats whose quotient is above d: 2 q - 1 < votes / d."""
        return [min(m, max(0, math.ceil((Fraction(v) / d - 1) / 2))) for v, m in zip(votes, most, strict=True)]

    high, low = Fraction(max(votes)), Fraction(max(votes))
    while sum(given(low)) < seats:
        low /= 2
    least = Fraction(1, 1 << 80)
    while high - low > least * high and sum(given(low)) > seats:
        mid = Fraction(math.floor((high + low) / 2 * (1 << 100)), 1 << 100)
        high, low = (mid, low) if sum(given(mid)) < seats else (high, mid)
    got = given(high) if sum(given(low)) != seats else given(low)
    # The seats left share one quotient.
    order = sorted(range(len(votes)), key=lambda i: (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    for i in order:
        if sum(got) >= seats:
            break
        if got[i] < most[i]:
            got[i] += 1
    return got


def targets_of(sizes: list[int], weights: list[int], budget: int, most_times: int) -> list[Fraction]:
    """Shares of the budget by weight, each at most ``most_times`` its size; what is above goes to the others by weight."""
    targets, free, left = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], Fraction(budget)
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most_times * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = Fraction(most_times * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in full]
    return targets


def n_words(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


#: A shard's share of its source's target has so many blocks at least, or blocks are single words.
SHARE_BLOCKS = 64


def _plan(spark: SparkSession, shards: list, weights: list[int], most_times: int, block: int) -> tuple[DataFrame, int, int]:
    """src, shard, its source's size and target, whole passes and blocks of one more pass; how many rows these are, and the words of a block."""
    names = sorted({r["src"] for r in shards if r["src"] is not None}) + [None] * any(r["src"] is None for r in shards)
    of = {name: sorted((r for r in shards if r["src"] == name), key=lambda r: r["shard"]) for name in names}
    sizes = [sum(r["words"] for r in of[name]) for name in names]
    targets = targets_of(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(sizes), most_times)
    block = max(1, min([block, *(int(t / (SHARE_BLOCKS * len(of[name]))) for name, t in zip(names, targets, strict=True) if t > 0)]))
    n_blocks = [sum(-(-r["words"] // block) for r in of[name]) for name in names]
    # A source at its cap gets all its seats; the last block of a shard is shorter, so other quotas go by a source's real words a block.
    full = [s > 0 and t == most_times * s for t, s in zip(targets, sizes, strict=True)]
    votes = [Fraction(0) if f or not s else t * n / s for t, s, n, f in zip(targets, sizes, n_blocks, full, strict=True)]
    others = sainte_lague(votes, round(sum(votes)), [most_times * n for n in n_blocks])
    seats = [most_times * n if f else q for f, n, q in zip(full, n_blocks, others, strict=True)]
    rows = []
    for name, size, target, quota in zip(names, sizes, targets, seats, strict=True):
        blocks = [-(-r["words"] // block) for r in of[name]]
        for r, n, q in zip(of[name], blocks, sainte_lague([r["words"] for r in of[name]], quota, [most_times * n for n in blocks]), strict=True):
            rows.append((name, r["shard"], size, float(target), n, q // n if n else 0, q % n if n else 0))
    return spark.createDataFrame(rows, "src string, shard int, source_size long, target double, blocks long, passes long, extra long"), len(rows), block


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most_times: int = 3,
    block: int = 32,
    seed: int = 0,
    shard_rows: int = 1000,
    most_shards: int = 1024,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, passes, spans.

    Sources in the order of their code points, null last, have the weights in
    turn and share as many words as there are. A source's target is at most
    ``most_times`` its words. taken is the number of the document's words in
    the mix, at most ``most_times`` its size: the whole text ``passes`` times,
    and the words of each of the ``spans`` (first, last exclusive) once more.

    A source differs from its target by about a block a shard at most; a block
    has ``block`` words, or fewer so that a shard's part of the least target
    has 64 blocks, down to single words. A null
    or empty text takes no part and has taken 0. Equal rows lie
    side by side on the line. No rows give no rows; other columns are ignored.
    A source is dealt into a shard for each ``shard_rows`` rows, ``most_shards``
    at most, so the plan has at most that many rows a source. It is made on
    the driver, which must hold it, and broadcast unless it has over 100,000 rows.
    """
    sized = cut(_sized(docs, id_col, text_col, source_col))
    lines = _lines(sized, weights, most_times, block, seed, shard_rows, most_shards)
    return _empty(sized) if lines is None else _columns(lines)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(named(id_col).alias("doc_id"), named(source_col).cast("string").alias("src"), n_words(text_col).alias("size"), F.xxhash64(text).alias("mark"), *more)


def _lines(sized: DataFrame, weights: tuple[int, ...], most_times: int, block: int, seed: int, shard_rows: int, most_shards: int) -> DataFrame | None:
    """The rows of ``sized`` (doc_id, src, size, mark, and others that are kept) with what the mix takes of each; None if there are none."""
    spark = sized.sparkSession
    # Rows without an id are told apart by their texts.
    key = F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("mark"))
    order = F.xxhash64(F.lit(seed), *key)
    counts = sized.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    dealt = few(spark.createDataFrame([(r["src"], min(most_shards, 1 + r["n"] // shard_rows)) for r in counts], "at string, n_shards int"), len(counts))
    rows = sized.join(dealt, F.col("src").eqNullSafe(F.col("at"))).drop("at")
    rows = rows.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), *key), F.col("n_shards")).cast("int")).drop("n_shards")
    sums = rows.groupBy("src", "shard").agg(F.sum("size").alias("words")).collect()
    plan, n, block = _plan(spark, sums, list(weights), most_times, block)
    plan = few(plan.withColumnsRenamed({"src": "at", "shard": "at_shard"}), n)
    w = Window.partitionBy("src", "shard").orderBy("order", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.withColumn("to", F.sum("size").over(w)).withColumn("from", F.col("to") - F.col("size"))
    lines = lines.join(plan, F.col("src").eqNullSafe(F.col("at")) & (F.col("shard") == F.col("at_shard"))).drop("at", "at_shard")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), F.col("src"), F.col("shard")), F.greatest(F.col("blocks"), F.lit(1)))

    # The blocks taken once more: from start up to the line's end, then from its beginning.
    stop = F.least(start + F.col("extra"), F.col("blocks"))
    runs = [(F.lit(0).cast("long"), F.greatest(start + F.col("extra") - F.col("blocks"), F.lit(0))), (start, stop)]

    def span(first: Column, last: Column) -> Column:
        """The document's words, counted from 0, that lie in a run of blocks."""
        return F.struct((F.greatest(first * block, F.col("from")) - F.col("from")).alias("first"), (F.least(last * block, F.col("to")) - F.col("from")).alias("last"))

    spans = F.filter(F.array(*[span(*run) for run in runs]), lambda s: s["first"] < s["last"])
    lines = lines.withColumn("spans", F.when(F.col("size") > 0, spans).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>")))
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    passes = F.when(F.col("size") > 0, F.col("passes")).otherwise(0)
    return lines.withColumn("passes", passes).withColumn("taken", passes * F.col("size") + more)


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("src").alias("source"), F.col("passes").cast("long").alias("passes"), "spans")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most_times: int = 3,
    block: int = 32,
    seed: int = 0,
    shard_rows: int = 1000,
    most_shards: int = 1024,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix takes it whole, and the parts taken once more.

    A part has its words joined by spaces; where a part is the whole text it is
    left as it is. Rows without an id and rows that share one are documents of their own.
    """
    lines = _lines(_sized(docs, id_col, text_col, source_col, F.struct(*map(named, docs.columns)).alias("row")), weights, most_times, block, seed, shard_rows, most_shards)
    if lines is None:
        return docs.limit(0)
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("last"))
    parts = F.concat(F.array_repeat(whole, F.col("passes").cast("int")), F.col("spans"))
    found = lines.filter("taken > 0").select("row", "size", F.explode(parts).alias("part"))
    first, last, text = F.col("part.first"), F.col("part.last"), F.col("row").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut_out = F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), " ")
    taken = F.when((first == 0) & (last == F.col("size")), text).otherwise(cut_out)
    return found.select(*[taken.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def _empty(sized: DataFrame) -> DataFrame:
    return _columns(sized.selectExpr("doc_id", "src", "size", "0L AS source_size", "0D AS target", "0L AS taken", "0L AS passes", "cast(array() AS array<struct<first:bigint,last:bigint>>) AS spans"))
