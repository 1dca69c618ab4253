import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lanternfish.llm.sharding import histogram_shards, write_shards


def check(df, n, **options):
    rows = histogram_shards(df, n, **options).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes


def test_every_row_has_a_slot(odd):
    check(odd, 4)
    check(odd, 1, ranges=1)
    check(odd, 16, ranges=3, probes=1)


def test_empty_table(none):
    assert histogram_shards(none).count() == 0


def test_shards_are_even(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = check(df, 8)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 110


@pytest.mark.parametrize("same", [1.0, 0.5])
def test_repeated_rows_spread(spark, same):
    df = spark.range(2000).select(F.when(F.col("id") < 2000 * same, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("some text").alias("text"))
    sizes = check(df, 4)
    assert max(sizes.values()) - min(sizes.values()) <= 40


def test_files_hold_the_shards(spark, whole, tmp_path):
    write_shards(whole, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in whole.collect())
    want = {r.doc_id: r.shard for r in histogram_shards(whole, 4).collect()}
    assert {r.doc_id: r._shard for r in back.select("doc_id", "_shard").collect()} == want


def test_shards_as_cut_from_a_sorted_line(spark):
    """A plain sort of all keys, cut where the bytes below come nearest to each shard's goal."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") * 31 % 97).cast("int")).alias("text"))
    n = 5
    line = sorted((r.key, r.doc_id, r["size"]) for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), (F.octet_length("text") + 1).alias("size")).collect())
    total, below, ends = sum(x[2] for x in line), 0, []
    for _, i, size in line:
        ends.append((below, i))
        below += size
    found = {r.doc_id: (r.shard, r.slot) for r in histogram_shards(df, n, tolerance=0.0).collect()}
    shard, want, slot = 0, {}, 0
    for k, (bytes_below, i) in enumerate(ends):
        after = ends[k + 1][0] if k + 1 < len(ends) else total
        while shard < n - 1 and abs(bytes_below - total * (shard + 1) / n) <= abs(after - total * (shard + 1) / n):
            shard, slot = shard + 1, 0
        want[i] = (shard, slot)
        slot += 1
    assert found == want


def test_rows_that_repeat_an_id_are_written_once_each(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "k1"), (1, "b", "k2"), (1, "a", "k3"), (None, None, "k4"), (None, "a", "k5")], "doc_id long, text string, _shard string")
    write_shards(df, str(tmp_path / "out"), 2)
    assert sorted(r._shard for r in spark.read.parquet(str(tmp_path / "out")).select("_shard").collect()) == ["k1", "k2", "k3", "k4", "k5"]
