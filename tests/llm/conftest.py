"""Documents with every odd case."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunks string, size int, key int, spans int, kept int"


def odd_documents():
    rng = random.Random(7)
    words = ["the", "and", "river", "Stone", "über", "été", "año", "日本", "x1", "well-known", "of", "light"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 6, 40, 60, 80, 120)]
    texts = [None, "", " ", "\n", "\t\n \n", "a", "A", "one two three four five", *base]
    texts += [base[-1].upper(), base[-1] + " end", "begin " + base[-1], base[4], base[4], base[4].replace("the", "THE")]
    texts += ["this line is repeated in many documents\n" + f"own line number {i} of a document" for i in range(5)]
    texts += ["  THIS line is repeated in many documents \t\nthis line is repeated in many documents"]
    texts += [" ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(20_000)), "z" * 30_000, "ab " * 9_000]
    rows = []
    for i, t in enumerate(texts):
        source = [None, "s1", "s2", "S0", "é"][i % 5] if i % 7 else "s1"
        rows.append((i, t, ["en", None, "de"][i % 3], source, None if i % 4 == 0 else len(t or ""), "c", i, i, i, i))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, copies, repeated rows and rows without an id."""
    rows = odd_documents()
    rows += [rows[12], rows[12], (None, "no id here at all", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def whole(spark):
    """The same documents with unique ids."""
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
