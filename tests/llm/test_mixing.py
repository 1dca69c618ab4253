import re
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from lanternfish.llm.mixing import mix, mixed_documents, sainte_lague, targets_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def one_by_one(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not free:
            break
        got[max(free, key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), max_size=6), st.integers(0, 60))
def test_seats_go_to_the_highest_quotients(parties, seats):
    votes, most = [v for v, _ in parties], [m for _, m in parties]
    assert sainte_lague(votes, seats, most) == one_by_one(votes, seats, most)


def test_targets_stop_at_three_times_the_size():
    assert targets_of([100, 10, 100], [5, 2, 1], 210, 3) == [150, 30, 30]
    assert targets_of([0, 5], [5, 2], 5, 3) == [0, 5]
    assert targets_of([1, 1000], [5, 2], 1001, 3) == [3, 998]


def check(df, **options):
    rows = mix(df, **options).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(s["last"] - s["first"] for s in r.spans)
    names = sorted(n for n in size if n is not None) + [None] * (None in size)
    want = targets_of([size[n] for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], sum(size.values()), 3)
    for n, t in zip(names, want, strict=True):
        assert abs(target[n] - float(t)) < 1e-6
        assert abs(taken[n] - t) <= max(200, 0.01 * float(t))
    for r in rows:
        assert r.source_size == size[r.source]
    return rows


def test_sources_come_near_their_targets(odd):
    rows = check(odd)
    sizes = Counter((r.doc_id, len(words(r.text))) for r in odd.collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes


def test_small_shards_and_blocks(odd):
    check(odd, shard_rows=2, block=4)


def test_reruns_agree_however_rows_are_dealt(whole):
    a = sorted(map(tuple, mix(whole).collect()), key=repr)
    assert a == sorted(map(tuple, mix(whole.repartition(7)).collect()), key=repr)


def test_empty_table(none):
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_the_mix_holds_the_words_that_it_takes(whole):
    got, want = defaultdict(Counter), {r.doc_id: (r.taken, r["size"]) for r in mix(whole).collect()}
    for r in mixed_documents(whole).collect():
        got[r.doc_id].update(words(r.text))
    texts = {r.doc_id: Counter(words(r.text)) for r in whole.collect()}
    for i, (taken, _) in want.items():
        assert sum(got[i].values()) == taken
        assert all(n <= 3 * texts[i][w] for w, n in got[i].items())
    assert mixed_documents(whole).columns == whole.columns


def test_rows_without_an_id_and_rows_that_share_one_are_taken(spark):
    """Each row's own words come as often as mix takes them, however many rows have its id."""
    texts = [(None if i % 3 == 0 else i % 2, " ".join(f"w{i}x{j}" for j in range(50 + i % 4))) for i in range(30)] + [(5, "equal rows " * 30)] * 2
    docs = spark.createDataFrame([(i, t, ["a", "b"][n % 2], n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, source string, place int")
    want, got = Counter(), Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    rows = mixed_documents(docs).collect()
    for r in rows:
        got[r.doc_id, r.source] += len(words(r.text))
        assert set(words(r.text)) <= set(words(texts[r.place][1]))
    assert got == +want and sum(got.values()) > 0.9 * sum(len(words(t)) for _, t in texts)


def test_small_sources_at_their_cap_are_taken_three_times(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate([("a", 10), ("b", 40), ("c", 100), ("d", 5000)])], "doc_id long, text string, source string")
    taken = {r.source: r.taken for r in mix(docs).collect()}
    assert (taken["a"], taken["b"], taken["c"]) == (30, 120, 300) and abs(taken["d"] - 4700) <= 32


def test_small_sources_come_near_their_targets(spark):
    """Sources of 3, 9 and 5 words."""
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f g", "y"), (3, "h i j k l", "y"), (4, "m n o p q", "z")], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["x"] == 9 and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_the_words_taken_are_those_of_the_blocks(spark):
    """Lays out each source's line of words block by block and counts what each document has in the blocks taken."""
    texts = [(i, " ".join(f"w{j}" for j in range((i * 37) % 200)), "abc"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    block = 32
    rows = mix(docs, block=block).orderBy("doc_id").collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for held in by_source.values():
        size, target = sum(r["size"] for r in held), held[0].target
        own = max(1, min([block, *(int(h[0].target / 64) for h in by_source.values())]))
        order = spark.createDataFrame([(r.doc_id,) for r in held], "doc_id long").selectExpr("doc_id", "xxhash64(0, doc_id, cast(null as long)) AS at").collect()
        place = {r.doc_id: r.at for r in order}
        line = [(r.doc_id, w) for r in sorted(held, key=lambda r: (place[r.doc_id], r.doc_id)) for w in range(r["size"])]
        blocks = -(-len(line) // own)
        counts = Counter()
        for r in held:
            for s in r.spans:
                counts.update((r.doc_id, w) for w in range(s["first"], s["last"]))
        again = [b for b in range(blocks) if any(counts[x] for x in line[b * own : (b + 1) * own])]
        # A block is taken once more in whole or not at all, and those taken follow each other round the line.
        assert all(counts[x] == (b in set(again)) for b in range(blocks) for x in line[b * own : (b + 1) * own])
        assert sum((b - 1) % blocks not in set(again) for b in again) <= 1
        passes = {r.passes for r in held if r["size"]}
        assert len(passes) == 1
        quota = passes.pop() * blocks + len(again)
        assert abs(quota * size / blocks - target) <= own
