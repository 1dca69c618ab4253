import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lanternfish.llm import bpe
from lanternfish.llm.queries import tokenizer

PATH, PATTERN = tokenizer("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return [int(x) for x in text.split(",")] if text else []


def test_documents_as_the_library_encodes_them(odd, library):
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    rows = bpe.encode(odd, PATH, PATTERN, decoded=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            want = library.encode_ordinary(texts[r.doc_id])
            assert ids(r.ids_text) == want and r.n_tokens == len(want)
            assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_decoding_alone(whole):
    encoded = bpe.encode(whole, PATH, PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in whole.collect()}


def test_empty_table(none):
    assert bpe.encode(none, PATH, PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abetn  \n.'1é日\x1c　½")), max_size=60), max_size=8))
def test_both_ways_of_merging_agree_with_the_library(ranks, library, texts):
    for many in (1, 10**9):
        encoder, bpe.MANY = bpe.Encoder(ranks, PATTERN), many
        try:
            found = list(encoder.ids_texts(texts))
        finally:
            bpe.MANY = 10_000
        assert [ids(x) for x in found] == [library.encode_ordinary(t) for t in texts]
        assert [encoder.decode(x) for x in found] == [t.encode() for t in texts]


def test_a_very_long_pre_token(ranks, library):
    text = "na" * 40_000
    assert ids(bpe.Encoder(ranks, PATTERN).ids_text(text)) == library.encode_ordinary(text)


def test_queue_gives_ranks_in_order():
    queue = bpe.RankQueue(300_000)
    for rank in (299_999, 5, 64, 63, 4096, 5):
        queue.push(rank, rank)
    got = []
    while queue.top:
        got.append(queue.take_first())
    assert got == [(5, [5, 5]), (63, [63]), (64, [64]), (4096, [4096]), (299_999, [299_999])]


def test_query_digests(spark):
    from lanternfish.llm.queries import op1_bpe

    row = op1_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
