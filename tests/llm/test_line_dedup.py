import re
from collections import defaultdict

import numpy as np
import pytest

from lanternfish.llm import line_dedup as ld

from llm_plain import ascii_lower


def key(line):
    return ascii_lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def plain(rows, least_chars, least_docs):
    """Each row is a document."""
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and (i is None or last[key(x)] != i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars,docs", [(20, 3), (1, 2), (5, 1)])
def test_lines_as_compared_plainly(odd, chars, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ld.line_dedup(odd, least_chars=chars, least_docs=docs, shard_keys=3).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, chars, docs)


def test_empty_table(none):
    assert ld.line_dedup(none).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    function = ld.PerfectHash.build(keys)
    assert sorted(function.index(keys).tolist()) == list(range(len(keys)))
    assert function.words.nbytes * 8 < 6 * len(keys)


def test_one_shard_in_memory_at_a_time(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ld.line_dedup(odd, least_chars=1, least_docs=2, shard_keys=2, held_bytes=1).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 1, 2)


def test_a_task_maps_each_of_forty_shards_once(tmp_path):
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    f, largest, n = rng.integers(-(2**62), 2**62, len(h)), np.arange(len(h)), np.arange(len(h)) % 9 + 1
    for k in range(40):
        own = h % np.uint64(40) == k
        function = ld.PerfectHash.build(h[own])
        order = np.empty(own.sum(), np.int64)
        order[function.index(h[own])] = np.flatnonzero(own)
        arrays = [function.sizes, function.words, function.before, f[order], largest[order], n[order].astype(np.uint32), np.zeros(0, np.int64)]
        (tmp_path / f"shard-{k}").write_bytes(ld._pack(arrays))
    shards = ld.Shards(str(tmp_path), 40, 1)
    for _ in range(3):
        counts, last = shards.probe(h, f)
        assert (counts == n).all() and (last == largest).all()
        assert not shards.probe(h, f + 1)[0].any()
    assert shards.loads == 40


def test_code_points_count_not_bytes(spark):
    rows = [(i, "é" * 19 + "\n" + "é" * 20) for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 0}
