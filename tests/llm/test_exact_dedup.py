import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lanternfish.llm.exact_dedup import BOUNDARY, chunks_of, exact_dedup, exact_groups

from llm_plain import ascii_lower


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[ascii_lower(text)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_are_those_of_whole_texts(odd, bits):
    """Also where identifiers collide, as they do with three bits."""
    want = plain((r.doc_id, r.text) for r in odd.collect())
    got = exact_groups(odd, min_chunk=8, max_chunk=40, hash_bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_table(none):
    assert exact_groups(none).count() == 0


def test_chunks_join_to_the_text_and_keep_to_their_bounds(whole):
    rows = whole.select("text", chunks_of(F.coalesce("text", F.lit("")), 10, 50, BOUNDARY).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == (r.text or "")
        assert all(len(c) <= 50 for c in r.c)
        assert all(len(c) >= 10 for c in r.c[:-2])


def test_an_edit_moves_only_chunks_near_it(spark):
    text = ". ".join(f"sentence number {i} of the long text" for i in range(200))
    df = spark.createDataFrame([(text,), ("X" + text,)], "text string")
    a, b = (set(r.c) for r in df.select(chunks_of(F.col("text"), 64, 512, BOUNDARY).alias("c")).collect())
    assert len(a & b) >= len(a) - 2


def test_the_documents_that_stay_keep_their_columns(odd):
    got = exact_dedup(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({ascii_lower(r.text) for r in odd.collect()})
