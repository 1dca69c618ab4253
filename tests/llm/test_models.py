"""The fitted operators: toxicity, quality and language."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def check_rows(df, rows):
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r.doc_id for r in df.collect()), key=repr)
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1


def test_toxicity_on_held_out_documents(documents, labels):
    rows = toxicity.toxicity(documents, labels)
    check_rows(documents, rows.collect())
    found = rows.join(labels, "doc_id").filter("held_out").toPandas()
    said, true = found.predicted == 1, found.toxic == 1
    assert ((found.score >= 0.7) == said).all()
    assert (said & true).sum() >= 0.75 * true.sum() and (said & ~true).sum() <= 1


def test_toxicity_never_sees_held_out_labels(documents, labels):
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(documents, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(odd, none, labels, no_labels):
    for given in (labels, no_labels):
        check_rows(odd, toxicity.toxicity(odd, given).collect())
        assert toxicity.toxicity(none, given).count() == 0
    kept = toxicity.clean_documents(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(0)
    true = rng.random(4000) < 0.2
    votes = np.zeros((4000, 5), np.int8)
    for v, (right, says) in enumerate([(0.95, 0.7), (0.9, 0.8), (0.85, 0.9), (0.8, 0.9)]):
        vote = np.where(rng.random(4000) < right, true, ~true)
        votes[:, v] = np.where(rng.random(4000) < says, np.where(vote, 1, -1), 0)
    votes[:, 4] = votes[:, 3]  # a copy of the weakest
    model = toxicity.LabelModel(0.2)
    p = model.fit(votes)
    assert ((p > 0.5) == true).mean() > 0.92
    assert any({3, 4} <= set(g) for g in model.groups)
    assert model.accuracies[0] > model.accuracies[3]


def test_copies_count_once_in_learning():
    text = "some words that are here in this text and no other one"
    assert toxicity.unlike([text, text, text + " more", "quite another text with other words in it"]) == [0, 3]


def test_quality_on_held_out_documents(documents, labels):
    rows = quality.quality(documents, labels)
    check_rows(documents, rows.collect())
    found = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.97
    assert (found.predicted[found.quality == 1] == 1).mean() >= 0.98


def test_quality_of_odd_rows(odd, none, labels, no_labels):
    for given in (labels, no_labels):
        check_rows(odd, quality.quality(odd, given).collect())
        assert quality.quality(none, given).count() == 0
    assert {r.score for r in quality.quality(odd, no_labels).collect()} == {0.5}


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.5).astype(float)
    views = [rng.normal(size=(3000, 4)) + 2 * y[:, None] * (np.arange(4) == v) for v in range(2)]
    few = slice(0, 30)
    model = quality.CoTraining(rounds=4).fit(views[0][few], views[1][few], y[few], views[0][30:2000], views[1][30:2000])
    assert min(model.exchanged) > 100
    p = model.score(views[0][2000:], views[1][2000:])
    assert ((p[:, 2] > 0.5) == y[2000:]).mean() > 0.85


def test_language_on_held_out_documents(documents):
    rows = language.identify_language(documents)
    check_rows(documents, rows.collect())
    found = rows.join(documents, "doc_id").filter("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() >= 0.98


def test_language_uses_no_column_but_the_text(documents):
    """Held-out rows get the same answer whatever their lang and source say."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = documents.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = (sorted(map(tuple, language.identify_language(d).collect())) for d in (documents, other))
    assert a == b


def test_language_of_odd_rows(spark, odd, none):
    rows = language.identify_language(odd).collect()
    check_rows(odd, rows)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
    assert language.identify_language(none).count() == 0
    unknown = spark.createDataFrame([(1, "text", None), (2, "½ 12", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_language(unknown).collect()} == {"und"}


def test_unseen_words_back_off():
    model = language.LanguageModel.fit(["wordlike things here " * 3] * 3 + ["schöne wörter hier " * 3] * 3, ["en"] * 3 + ["de"] * 3)
    assert "wordlikes" not in model.words
    scores = model.score_words(["wordlikes", "wörtern", "ö", "☃"])
    en, de = model.langs.index("en"), model.langs.index("de")
    assert scores[0, en] > scores[0, de] and scores[1, de] > scores[1, en] and scores[2, de] > scores[2, en]
    assert (scores[3] == 0).all()


def test_the_pool_is_drawn_from_all_ids():
    from lanternfish.llm.quality import _drawn

    rows = np.arange(12_000)[:, None]
    drawn = _drawn(rows, 4000)
    assert len(drawn) == 4000 and 0.3 < (drawn >= 8000).mean() < 0.37
    assert (_drawn(rows, 20_000) == rows).all()
