"""Input columns that are called as the operators' own columns are."""

import pytest

from lanternfish.llm.exact_dedup import exact_dedup
from lanternfish.llm.jaccard import jaccard_dedup
from lanternfish.llm.mixing import mixed_documents
from lanternfish.llm.toxicity import clean_documents

NAMES = """ident sha own_sha rows kept place word marks gone score _place _word _marks _gone _sha _part _stay_id _stay_sha _rows _size _toxicity_score
row size src mark order shard to from at at_shard blocks passes extra spans part taken key tie near k n token cell block doc a.b Text_2""".split()
TEXTS = ["one two three four five six seven", "ONE two three four five six seven", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, "", "x"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "s", "en", *[f"{name}{i}" for name in NAMES]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


def check(clashing, found, stay):
    assert found.columns == clashing.columns
    whole = {r.doc_id: r for r in clashing.collect()}
    rows = found.collect()
    assert {r.doc_id for r in rows} == stay
    assert all(tuple(r)[2:] == tuple(whole[r.doc_id])[2:] for r in rows)


def test_exact_dedup(clashing):
    check(clashing, exact_dedup(clashing), {1, 2, 4, 5})


def test_jaccard_dedup(clashing):
    check(clashing, jaccard_dedup(clashing), {0, 2, 3, 4, 5})


def test_mixed_documents(clashing):
    check(clashing, mixed_documents(clashing), {0, 1, 2, 5})


def test_clean_documents(spark, clashing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    check(clashing, clean_documents(clashing, labels), set(range(6)))
