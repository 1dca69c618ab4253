"""Exact deduplication through content-defined chunk recipes.

Each text is cut into chunks at places that its content decides: a chunk runs
for at least ``min_chunk`` characters and ends at the first match of
``boundary``, at the text's end, or after ``max_chunk`` characters. Equal texts
so have equal chunks, and an edit moves only the boundaries near it. A chunk's
identifier is a 64-bit hash; one pass over the distinct chunks verifies that no
identifier names two different chunks, and where one does, its chunks get
ordinals that tell them apart. A document's recipe is its ordered list of
identifiers. Documents are compared by their recipes, so whole texts are never
shuffled: each distinct chunk moves once, for the verification.

Only DataFrame functions are used; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, free, halved_by, named, text_or_empty

#: Chunks end behind a punctuation mark and white space, or behind a line.
BOUNDARY = r"[.!?;:]\s|\n"


def chunks_of(text: Column, min_chunk: int, max_chunk: int, boundary: str) -> Column:
    """The chunks of a text in order; joined, they are the text."""
    if not 0 < min_chunk <= max_chunk:
        raise ValueError("0 < min_chunk <= max_chunk is needed")
    pattern = rf"(?s).{{{min_chunk},{max_chunk}}}?(?:{boundary}|\z)|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _collided(texts: DataFrame, ident) -> DataFrame:
    """chunk_hash, chunk, ordinal of the chunks that share a hash with another chunk."""
    distinct = texts.select(F.explode("chunks").alias("chunk")).select(ident(F.col("chunk")).alias("chunk_hash"), "chunk").distinct()
    several = distinct.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_hash")
    if several.isEmpty():
        return several
    w = Window.partitionBy("chunk_hash").orderBy("chunk")
    return cut(distinct.join(several, "chunk_hash").withColumn("ordinal", F.row_number().over(w).cast("long")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = 512,
    max_chunk: int = 4096,
    boundary: str = BOUNDARY,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a
    group is its keep_id.

    Null texts count as empty, and all empty texts form a group. Rows that
    repeat an id and text count each in group_size, and share kept. A null id
    never stays while its group has another; a group of null ids only has
    keep_id null and kept true. No rows give no rows. Other columns of
    ``docs`` are ignored. ``hash_bits`` below 64 only serves tests of collided
    identifiers.
    """
    mask = (1 << hash_bits) - 1 if hash_bits < 64 else -1

    def ident(chunk: Column) -> Column:
        return F.xxhash64(chunk).bitwiseAND(F.lit(mask).cast("long")) if mask != -1 else F.xxhash64(chunk)

    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    texts = norm.withColumn("chunks", chunks_of(F.col("norm"), min_chunk, max_chunk, boundary))
    recipes = cut(texts.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.transform("chunks", ident).alias("recipe")))
    bad = _collided(texts, ident)
    if "ordinal" in bad.columns:
        recipes = _with_ordinals(texts, bad, ident)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join has one more key than the aggregation, so that both sides are
    # exchanged for it and a large group's rows can be split between tasks.
    key = F.xxhash64("recipe")
    found = recipes.withColumn("k", key).join(groups.withColumn("k", key), ["k", "recipe"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_ordinals(texts: DataFrame, bad: DataFrame, ident) -> DataFrame:
    """Recipes in which each chunk's ordinal follows the identifiers of a document that needs it."""
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), "chunks", F.transform("chunks", ident).alias("recipe")))
    parts = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("chunk_hash", ident(F.col("chunk")))
    named = parts.join(bad, ["chunk_hash", "chunk"], "inner").select("row", F.struct("pos", "ordinal").alias("at"))
    ordinals = named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["ordinal"]).alias("ordinals"))
    found = rows.join(ordinals, "row", "left")
    return cut(found.select("doc_id", "text_sha256", F.concat("recipe", F.coalesce("ordinals", F.array().cast("array<bigint>"))).alias("recipe")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows that repeat the id and text that stay, one. See :func:`exact_groups`.

    Only rows whose id the filter of ids that go, or repeat, marks are shuffled.
    """
    groups = exact_groups(docs, id_col, text_col, **options)
    ident, sha, own_sha, rows = (free(docs.columns, x) for x in ("ident", "sha", "own_sha", "rows"))
    fate = groups.groupBy(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias(rows))
    fate = cut(fate.filter(~F.col("kept") | (F.col(rows) > 1)))
    counts = fate.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("again")).first()
    clear, marked = halved_by(docs, fate.select(F.col(ident).alias(id_col)), id_col, counts["n"])
    marked = marked.withColumn(sha, F.sha2(ascii_lower(text_or_empty(text_col)), 256))

    def at(which: DataFrame, how: str) -> DataFrame:
        keys = which.select(ident, F.col(sha).alias(own_sha))
        return marked.join(keys, named(id_col).eqNullSafe(F.col(ident)) & (F.col(sha) == F.col(own_sha)), how)

    stay = at(fate, "left_anti")
    if counts["again"]:
        stay = stay.unionByName(at(fate.filter("kept"), "left_semi").dropDuplicates([id_col, sha]))
    stay = stay.drop(sha)
    return stay if clear is None else clear.unionByName(stay)
