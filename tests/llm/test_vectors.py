import numpy as np
import pytest
from llm_plain import reachable

from lanternfish.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, near int, block int, rep int"


def plain(rows):
    good = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good.append((place, i, x / np.linalg.norm(x)))
    links, count = [], dict.fromkeys(range(len(rows)), 0)
    for p, a, x in good:
        for q, b, y in good:
            if p != q and len(x) == len(y) and x @ y >= 0.9:
                count[p] += 1
                links.append((a, b))
    least = reachable([i for i, _ in rows if i is not None], links)
    return sorted(((i, count[p], None if i is None else least[i], i is None or least[i] == i) for p, (i, _) in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4) for i, v in rows], SCHEMA)


def got(df, **options):
    return sorted(map(tuple, near_vectors(df, **options).collect()), key=repr)


def clusters(seed, n=40, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), (centre + 0.05 * rng.normal(size=d)).tolist()))
    return rows


@pytest.mark.parametrize("block", [2048, 3])
def test_links_as_compared_plainly(spark, block):
    rows = clusters(1)
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(15)] + [(2000, [2 * x for x in same]), (2001, [-x for x in same])]
    assert got(frame(spark, rows), block=block) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 0.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (None, [1.0, 1.0]), (10, [1e30, 1e30]), (11, [1e-30, 1e-30])]
    assert got(frame(spark, rows)) == plain(rows)


def test_empty_and_unusable_tables(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert got(frame(spark, [(1, None), (2, [0.0])])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.91 in 64 dimensions among others."""
    rng = np.random.default_rng(2)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    a, noise = unit(rng.normal(size=(400, 64))), rng.normal(size=(400, 64))
    noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    b = 0.91 * a + np.sqrt(1 - 0.91**2) * noise
    rows = [(i, v) for i, v in enumerate(np.concatenate([a, b, unit(rng.normal(size=(1000, 64)))]).tolist())]
    linked = {i for i, n, *_ in got(frame(spark, rows)) if n}
    assert sum(i in linked for i in range(400)) >= 0.95 * 400


@pytest.mark.parametrize("block", [2048, 64])
def test_all_links_of_a_near_copy_group_of_a_third_of_the_rows(spark, block):
    """The group's pairs have cosine about 0.93, some on either side of 0.9."""
    rng = np.random.default_rng(3)
    group = rng.normal(size=64) + 0.27 * rng.normal(size=(300, 64))
    rows = list(enumerate(np.concatenate([group, rng.normal(size=(600, 64))]).tolist()))
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert 0.5 * 300 * 299 < want.sum() < 300 * 299
    assert {i: n for i, n, *_ in got(frame(spark, rows), block=block)} == dict(enumerate(want.tolist()))


def test_a_table_of_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1])]
    assert got(frame(spark, rows)) == plain(rows)


@pytest.mark.parametrize("dims", [64, 256, 768])
@pytest.mark.parametrize("pivots", [512, 4096, 16384])
def test_retrieval_of_pairs_at_the_threshold(dims, pivots):
    """Pairs of cosine exactly 0.9, by the operator's own description and counting."""
    import pyarrow as pa

    from lanternfish.llm import vectors as v

    rng = np.random.default_rng(dims + pivots)
    p = v.unit(rng.normal(size=(pivots, dims))).astype(np.float32)
    a, z = v.unit(rng.normal(size=(500, dims))), rng.normal(size=(500, dims))
    z = v.unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * z

    class Shared:
        value = p

    def near(x):
        batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], ["vector"])
        return np.concatenate([np.array(r.column("near").to_pylist()) for r in v._describing(Shared, 16)([batch])])

    x, y = near(a), near(b)
    order = np.argsort(-(a.astype(np.float32) @ p.T), 1)[:, :16]
    assert (x == order).mean() > 0.999  # the nearest first
    met = np.array([bool(set(i[:8]) & set(j[:8])) and len(set(i) & set(j)) >= 3 for i, j in zip(x.tolist(), y.tolist(), strict=True)])
    assert met.mean() >= 0.95
    # Signatures never count too few.
    pairs = v._retrieved(v._signatures(x), v._signatures(y), 3)
    assert pairs[np.arange(500), np.arange(500)][met].all()


def test_exact_mode(spark):
    rows = clusters(7) + [(900, [1.0, 0.0]), (901, [1.0, 0.1])]
    assert got(frame(spark, rows), exact=True) == got(frame(spark, rows), exact=True, tile=5, block=7) == plain(rows)


def test_dense_groups_around_the_threshold(spark):
    """Two groups of a quarter of the rows each whose pairs have cosines of about 0.89 and 0.95."""
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=64) + s * rng.normal(size=(150, 64)) for s in (0.35, 0.23)] + [rng.normal(size=(300, 64))]
    rows = list(enumerate(np.concatenate(rows).tolist()))
    a, b = (dict((r[0], r[1]) for r in got(frame(spark, rows), exact=e)) for e in (True, False))
    assert sum(b.values()) >= 0.99 * sum(a.values()) > 1000
