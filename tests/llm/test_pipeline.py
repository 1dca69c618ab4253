"""The pipeline's stages against plain versions of them."""

import re
from collections import Counter, defaultdict

import tiktoken
from llm_plain import ascii_lower, reachable

import corpus_pipeline as cp
from lanternfish.llm.bpe import parse_ranks
from lanternfish.llm.common import fresh_folder
from lanternfish.llm.mixing import targets_of
from lanternfish.llm.queries import table, tokenizer
from lanternfish.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_each_stage(spark):
    docs = table(spark, SF, "documents")
    columns, outs = docs.columns, [docs]
    for name, stage in cp.STAGES:
        path = fresh_folder(spark, name)
        stage(spark, outs[-1], SF).write.parquet(path)
        outs.append(spark.read.parquet(path))
    assert all(x.columns == columns for x in outs[:-1])
    raw, clean, single, apart, mixed = (x.collect() for x in outs[:-1])

    toxic = {r.doc_id for r in toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert sorted(clean) == sorted(r for r in raw if r.doc_id not in toxic)

    last = {}
    for r in clean:
        last[ascii_lower(r.text)] = max(r.doc_id, last.get(ascii_lower(r.text), -1))
    assert sorted(single) == sorted(r for r in clean if last[ascii_lower(r.text)] == r.doc_id)

    sets = {r.doc_id: grams(r.text) for r in single}
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    least = reachable(sets, links)
    assert sorted(apart) == sorted(r for r in single if least[r.doc_id] == r.doc_id)

    size, got = Counter(), Counter()
    for r in apart:
        size[r.source] += len(r.text.split())
    times = defaultdict(Counter)
    for r in mixed:
        got[r.source] += len(r.text.split())
        times[r.doc_id].update(r.text.split())
        assert r.n_chars == len(r.text)
    names = sorted(size)
    want = targets_of([size[n] for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], sum(size.values()), 3)
    for n, t in zip(names, want, strict=True):
        assert abs(got[n] - t) <= max(64, 0.02 * float(t))
    whole = {r.doc_id: Counter(r.text.split()) for r in apart}
    assert all(n <= 3 * whole[i][w] for i, c in times.items() for w, n in c.items())

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    encoded = Counter((r.doc_id, ",".join(map(str, library.encode_ordinary(r.text)))) for r in mixed)
    assert Counter((r.doc_id, r.ids_text) for r in outs[-1].collect()) == encoded


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_text"] and rows.count() > 0
