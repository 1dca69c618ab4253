"""Quality scores by co-training.

Two classifiers see each document from different sides: one its content
(characters, words, lines and their repetition), the other the metadata that
stands beside it (source, language, number of characters), which it takes from
those columns alone. Both start from the labelled documents. In
each round either labels the documents of an unlabelled pool of which it is
most confident, and hands them to the other to learn from. At the end each
view's logits are calibrated on labelled documents that it wasn't fitted on, a
combination of the two is fitted there too, and all documents are scored.

Executors make the features, so the driver sees numbers only, never texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, named, text_or_empty
from .linear import calibrate, fit_logistic, sigmoid
from .sampling import of_each_class
from .toxicity import near_hashes, unlike_hashes

SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SOURCES, LANGS = 32, 16


def content_features(text: str) -> list[float]:
    """Shares of characters and words, how much repeats, and the layout of lines."""
    n, chars = max(1, len(text)), Counter(text)
    upper = sum(v for c, v in chars.items() if c.isupper())
    letters = sum(v for c, v in chars.items() if c.isalpha())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    spaces = sum(v for c, v in chars.items() if c.isspace())
    signs = sum(chars.get(c, 0) for c in SIGNS)
    entropy = -sum(v / n * math.log2(v / n) for v in chars.values())
    words = text.split()
    m, counts = max(1, len(words)), Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    lengths = Counter(map(len, words))
    capital = sum(v for w, v in counts.items() if len(w) > 2 and w.isupper())
    mixed = sum(v for w, v in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    bare = sum(v for w, v in counts.items() if not any(map(str.isalpha, w)))
    numbers = [upper / max(1, letters), letters / n, digits / n, spaces / n, signs / n, (n - letters - digits - spaces - signs) / n]
    ratios = [len(counts) / m, len(counts) / math.sqrt(m) / 10, top / m, sum(v for k, v in lengths.items() if k <= 3) / m, sum(v for k, v in lengths.items() if k > 12) / m, capital / m, mixed / m, bare / m]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    lines = text.split("\n")
    wide = [len(x) for x in lines]
    layout = [len(set(lines)) / len(lines), max(wide) / n, math.log1p(sum(wide) / len(lines)), math.log1p(len(lines)), sum(x < 3 for x in wide) / len(lines), len(text.encode()) / n - 1]
    return [*numbers, *ratios, *layout, again, entropy, math.log1p(len(words)), sum(k * v for k, v in lengths.items()) / m, *(math.log1p(1000 * chars.get(c, 0) / n) for c in SIGNS)]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """What is known of a page without reading it: where it comes from, its language and how long it is."""
    size = 0 if n_chars is None else max(0, n_chars)
    row = [0.0] * (SOURCES + LANGS)
    row[zlib.crc32((source or "").encode()) % SOURCES] = 0.3
    row[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 0.3
    step = [float(math.log1p(size) > b) for b in (3, 4, 5, 6, 7, 8, 9)]
    return [*row, *step, math.log1p(size), float(source is None), float(lang is None), float(n_chars is None)]


N_CONTENT = len(content_features(""))
N_METADATA = len(metadata_features(None, None, None))


class View:
    """A logistic regression over standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = fit_logistic((x - self.mean) / self.scale, y, weight, ridge=3.0)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]


class CoTraining:
    """Both views, their calibrations and their combination; of fixed size."""

    def __init__(self, rounds: int = 5, share: float = 0.06, sure: float = 0.9):
        self.rounds, self.share, self.sure = rounds, share, sure

    def _teach(self, xs: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray]) -> list[View]:
        """Views fitted after all rounds of exchange."""
        given = [(np.zeros(0, np.int64), np.zeros(0)) for _ in xs]
        free = [np.ones(len(pools[0]), bool) for _ in xs]  # what view k may still be taught
        views = []
        for round_no in range(self.rounds + 1):
            views = []
            for x, pool, (at, labels) in zip(xs, pools, given, strict=True):
                weight = np.concatenate([np.ones(len(y)), np.full(len(at), 0.5)])
                views.append(View().fit(np.concatenate([x, pool[at]]), np.concatenate([y, labels]), weight))
            if round_no == self.rounds or not len(pools[0]):
                break
            for k, view in enumerate(views):
                other = 1 - k
                p = sigmoid(view.logit(pools[k]))
                for label, share in ((1.0, y.mean()), (0.0, 1 - y.mean())):
                    trust = p if label else 1 - p
                    order = np.argsort(-trust, kind="stable")
                    order = order[free[other][order] & (trust[order] >= self.sure)][: max(1, int(self.share * share * len(p)))]
                    free[other][order] = False
                    given[other] = (np.concatenate([given[other][0], order]), np.concatenate([given[other][1], np.full(len(order), label)]))
        self.exchanged = [len(g[0]) for g in given]
        return views

    def fit(self, content: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_metadata: np.ndarray) -> CoTraining:
        y = np.asarray(y, float)
        xs, pools = [content, metadata], [pool_content, pool_metadata]
        if not len(y) or y.min() == y.max():
            self.views = None
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        fold = np.arange(len(y)) % 3
        out = np.zeros((len(y), 2))
        for k in range(3):
            train, test = fold != k, fold == k
            if test.any() and y[train].min() < y[train].max():
                views = self._teach([x[train] for x in xs], y[train], pools)
                out[test] = np.stack([v.logit(x[test]) for v, x in zip(views, xs, strict=True)], 1)
        self.slopes = [calibrate(out[:, v], y) for v in range(2)]
        both = np.stack([out[:, v] * s[0] + s[1] for v, s in enumerate(self.slopes)], 1)
        self.mix = fit_logistic(both, y, ridge=0.1)
        self.views = self._teach(xs, y, pools)
        return self

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Columns: the content's probability, the metadata's, and that of both."""
        if self.views is None:
            return np.full((len(content), 3), self.constant)
        z = np.stack([v.logit(x) * s[0] + s[1] for v, x, s in zip(self.views, (content, metadata), self.slopes, strict=True)], 1)
        return sigmoid(np.column_stack([z, z @ self.mix[:-1] + self.mix[-1]]))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, source, lang, n_chars; null where a column is missing."""

    def given(name: str, kind: str):
        return (named(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), given("source", "string"), given("lang", "string"), given("n_chars", "long"))


def _row(batch: pa.RecordBatch, k: int) -> tuple[list[float], list[float]]:
    text = batch.column("text")[k].as_py()
    return content_features(text), metadata_features(*(batch.column(c)[k].as_py() for c in ("source", "lang", "n_chars")))


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            rows = [[x for own in _row(part, k) for x in own] for k in range(part.num_rows)]
            near = np.array([near_hashes(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.list_(pa.float64())), pa.array(near.tolist(), pa.list_(pa.int64()))], ["doc_id", "label", "x", "near"])


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [_row(part, k) for k in range(part.num_rows)]
                p = model.value.score(np.array([r[0] for r in rows]).reshape(-1, N_CONTENT), np.array([r[1] for r in rows]).reshape(-1, N_METADATA))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, c]) for c in range(3))], ["doc_id", "content_score", "metadata_score", "score"])

    return run


def _drawn(rows: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the rows, drawn from all over them, in their order."""
    return rows[np.sort(np.random.default_rng(0).permutation(len(rows))[:most])]


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    most: int = 4000,
    pool: int = 4000,
    rounds: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, content_score, metadata_score, score, predicted, kept.

    ``labels`` has ids and quality, 0 or 1; those of held-out documents are
    never read. The classifiers are fitted on about ``most`` labelled documents
    of each class and exchange labels over a pool of about ``pool`` others, whole
    texts. predicted is 1, and kept true, from ``threshold`` on.

    A null text counts as empty; null or missing source, lang and n_chars are
    values of their own. A null id is not held out and never learnt from. Rows
    repeat as they come; equal rows have equal scores. No rows give no rows.
    Labels of one class only, or none, give each document that class's share, or 0.5.
    """
    spark = docs.sparkSession
    rows = _columns(docs, id_col, text_col)
    known = labels.filter(~held_out(id_col) & F.col("quality").isin(0, 1)).groupBy(named(id_col).alias("at")).agg(F.max("quality").cast("int").alias("label"))
    chosen = of_each_class(known, most).select("at", "label")
    learnable = rows.filter(~held_out() & F.col("doc_id").isNotNull())
    share = int((1 << 40) * min(1.0, (pool + 2 * most) / max(1, learnable.count())))
    place = F.pmod(F.xxhash64("doc_id", F.lit("pool")), F.lit(1 << 40))
    sample = learnable.join(F.broadcast(chosen), F.col("doc_id") == F.col("at"), "left").drop("at").filter(F.col("label").isNotNull() | (place < share))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = sample.mapInArrow(_featuring, f"doc_id {kind}, label int, x array<double>, near array<long>").toPandas()
    made = made.sort_values("doc_id", kind="stable").reset_index(drop=True)
    made = made.iloc[unlike_hashes(made["near"].tolist())]
    x = np.array(made["x"].tolist(), float).reshape(-1, N_CONTENT + N_METADATA)
    given = made["label"].notna().to_numpy()
    y = made["label"].to_numpy(float)[given]
    drawn = _drawn(x[~given], pool)
    model = CoTraining(rounds).fit(x[given][:, :N_CONTENT], x[given][:, N_CONTENT:], y, drawn[:, :N_CONTENT], drawn[:, N_CONTENT:])
    shared = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scoring(shared), f"doc_id {kind}, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("kept"))
