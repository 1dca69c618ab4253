"""Toxicity scores by weak supervision.

Many voters look at a text: word lists by theme, words and word beginnings that
mark toxic documents among the labelled ones, and patterns of such hits (several
at once, dense ones, abuse that is addressed to someone), while others vote for
clean where hits are missing or stand alone. Each votes toxic, clean or not at
all. A generative label model finds, without labels, how often each voter is
right and which voters repeat each other given the true class: it is a mixture
of two classes over groups of voters, where correlated voters form one group
with a joint table. Its posteriors are the labels of a linear classifier over
words, beginnings and hits, and that classifier scores all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, held_out, mapped, named, text_or_empty
from .linear import calibrate, fit_logistic, sigmoid
from .sampling import of_each_class

#: Common English terms of abuse by theme.
THEMES = {
    "wits": "idiot idiots moron morons stupid dumb imbecile imbeciles fool fools retard retards dimwit cretin clown clowns",
    "worth": "worthless useless loser losers pathetic failure nobody trash garbage rubbish waste",
    "disgust": "disgusting scum filth filthy vile vermin pig pigs swine rat rats parasite parasites",
    "abuse": "bastard bastards bitch bitches asshole assholes jerk jerks shit shitty fuck fucking damn",
    "threat": "kill destroy hate hated despise",
}
ADDRESSED = re.compile(r"\byou(?:'re|r| are)?\s+(?:\w+\s+){0,2}(\w+)")
LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features.
STEMS = (5, 7)
#: Voters that share the learnt words, those with the best odds first.
LISTS = 8


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def near_hashes(text: str) -> list[int]:
    """For each of four hash functions the smallest hash of three words in a row; near copies have most in common."""
    h = np.array([zlib.crc32(w.encode()) for w in words_of(text)] or [0], np.uint64)
    with np.errstate(over="ignore"):
        if len(h) > 2:
            h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        h ^= h >> np.uint64(29)
        return [int(((h * np.uint64(m)) ^ (h >> np.uint64(31))).min()) for m in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def unlike(texts: list[str]) -> list[int]:
    return unlike_hashes([near_hashes(t) for t in texts])


def unlike_hashes(near: list) -> list[int]:
    """Places of the near hashes of texts that are no copies or near copies of texts before them: none of their hashes has come up."""
    seen: list[set[int]] = [set() for _ in range(4)]
    found = []
    for place, least in enumerate(near):
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            found.append(place)
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return found


def _marked(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, chance: float, least: int) -> dict[str, float]:
    """Items in more toxic documents than chance gives, with their log odds."""
    share, found = n_toxic / max(1, n_toxic + n_clean), {}
    for item, t in toxic.items():
        c = clean.get(item, 0)
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if t < least or odds < math.log(4):
            continue
        n = t + c
        # Bound on the chance of t or more of n, after Chernoff.
        p = t / n
        gain = p * math.log(p / share) + (0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - share)))
        if math.exp(-n * gain) < chance:
            found[item] = odds
    return found


class Lexicon:
    """The word lists, given and learnt, and what a text has of them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], vocabulary: list[str]):
        self.words, self.stems = words, stems
        self.themes = {name: frozenset(listed.split()) for name, listed in THEMES.items()}
        self.given = frozenset().union(*self.themes.values())
        by_odds = sorted(words, key=lambda w: (-words[w], w))
        self.lists = [frozenset(by_odds[len(words) * k // LISTS : len(words) * (k + 1) // LISTS]) for k in range(LISTS)]
        self.column = {w: i for i, w in enumerate(vocabulary)}
        self.known = frozenset(vocabulary)

    def look(self, text: str) -> tuple[np.ndarray, list[int], np.ndarray]:
        """A text's votes, the vocabulary's columns that it has, and its other features."""
        words = words_of(text)
        own = set(words)
        stems = {w[:n] for w in own for n in STEMS if len(w) > n} if self.stems else set()
        listed = own & self.words.keys()
        marked = stems & self.stems.keys()
        given = own & self.given
        strong = own & (self.themes["wits"] | self.themes["worth"] | self.themes["disgust"] | self.themes["abuse"])
        hits = len(listed | strong)
        size = len(own)
        votes = [1 if own & listed_words else 0 for listed_words in self.themes.values()]
        votes += [1 if own & listed_words else 0 for listed_words in self.lists]
        evidence = sum(self.words[w] for w in listed) + 2 * len(strong - self.words.keys())
        addressed = bool(strong) and any(m in strong for m in ADDRESSED.findall(text.lower()))
        spread = len(strong & self.given)
        votes += [
            1 if len(listed) >= 2 else -1 if not listed else 0,
            1 if len(strong) >= 2 else 0,
            1 if hits >= 3 else -1 if hits == 0 else 0,
            1 if marked and listed else -1 if not marked and not given else 0,
            1 if evidence > 4 + math.log1p(size) else -1 if evidence < math.log1p(size) / 2 else 0,
            1 if size and hits / size > 0.02 else -1 if size and hits / size < 0.002 else 0,
            1 if addressed else 0,
            -1 if size > 100 and evidence < 3.5 else 0,
            -1 if size < 5 and not hits else 0,
        ]
        columns = [self.column[w] for w in (own | stems) & self.known]
        dense = [math.log1p(hits), math.log1p(len(listed)), min(3, spread), math.log1p(evidence), min(0.2, hits / max(1, size)) * 10, math.log1p(size) / 5, hits >= 2, len(marked) > 0]
        return np.array(votes, np.int8), columns, np.array(dense, np.float32)


class LabelModel:
    """Two hidden classes; groups of voters, each with a table of vote patterns by class.

    ``fit`` first takes the voters as independent given the class. Pairs whose
    votes still correlate within the classes are then put into one group, up to
    three voters in each, and the tables are estimated anew.
    """

    def __init__(self, prior: float, link: float = 0.25, most: int = 3, rounds: int = 40):
        self.prior, self.link, self.most, self.rounds = min(max(prior, 0.005), 0.5), link, most, rounds

    @staticmethod
    def _codes(votes: np.ndarray, group: list[int]) -> np.ndarray:
        code = np.zeros(len(votes), np.int64)
        for v in group:
            code = code * 3 + (votes[:, v].astype(np.int64) + 1)
        return code

    def _run(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        codes = [self._codes(votes, g) for g in self.groups]
        for _ in range(self.rounds):
            z = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
            self.tables = []
            for code, group in zip(codes, self.groups, strict=True):
                n = 3 ** len(group)
                t = np.bincount(code, p, n)
                c = np.bincount(code, 1 - p, n)
                both = (t + c + 0.1) / (t + c + 0.1).sum()
                t, c = (t + 4 * both) / (t.sum() + 4), (c + 4 * both) / (c.sum() + 4)
                self.tables.append(np.log(t / c))
                z += self.tables[-1][code]
            new = sigmoid(z)
            if np.abs(new - p).max() < 1e-5:
                return new
            p = new
        return p

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """The posteriors of the documents whose votes are given, a row each."""
        lean = (votes == 1).sum(1) - (votes == -1).sum(1)
        p = np.where(lean > 0, 0.9, np.where(lean < 0, 0.02, self.prior))
        self.groups = [[v] for v in range(votes.shape[1])]
        p = self._run(votes, p)
        # What is left of the votes when each class's mean is taken off.
        v = votes.astype(float)
        rest = v - np.outer(p, (p @ v) / max(p.sum(), 1e-9)) - np.outer(1 - p, ((1 - p) @ v) / max((1 - p).sum(), 1e-9))
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        self.correlations = (rest.T @ rest) / len(v) / np.outer(scale, scale)
        n = votes.shape[1]
        pairs = sorted(((abs(self.correlations[i, j]), i, j) for i in range(n) for j in range(i)), reverse=True)
        group = {i: [i] for i in range(n)}
        for strength, i, j in pairs:
            a, b = group[i], group[j]
            if strength >= self.link and a is not b and len(a) + len(b) <= self.most:
                a += b
                for k in b:
                    group[k] = a
        self.groups = [sorted(g) for g in {id(g): g for g in group.values()}.values()]
        p = self._run(votes, p)
        agree = np.where(votes == 1, p[:, None], np.where(votes == -1, 1 - p[:, None], 0))
        self.accuracies = agree.sum(0) / np.maximum(1, (votes != 0).sum(0))
        return p


class ToxicityModel:
    """All that scoring needs; of bounded size."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, slope: np.ndarray):
        self.lexicon, self.weights, self.slope = lexicon, weights, slope

    def score(self, text: str) -> tuple[float, int]:
        votes, columns, dense = self.lexicon.look(text)
        n = len(self.lexicon.column)
        z = float(self.weights[columns].sum() + self.weights[n:-1] @ dense + self.weights[-1])
        return float(sigmoid(self.slope[0] * z + self.slope[1])), int((votes == 1).sum())


def learnt_words(n_toxic: int, n_clean: int, toxic: Counter, clean: Counter, toxic_stems: Counter, clean_stems: Counter, most_words: int, most_stems: int, most_features: int) -> Lexicon:
    """The lexicon of the words and beginnings that mark toxic documents, given in how many documents of either class each is."""
    words = _marked(toxic, clean, n_toxic, n_clean, 1e-4, 3)
    begun = _marked(toxic_stems, clean_stems, n_toxic, n_clean, 1e-5, 4)
    ranked = sorted(words, key=lambda w: (-toxic[w] * words[w], w))
    stems = sorted(begun, key=lambda s: (-toxic_stems[s] * begun[s], s))[:most_stems]
    vocabulary = sorted({*ranked[:most_features], *stems[: most_features // 3]})
    return Lexicon({w: words[w] for w in ranked[:most_words]}, {s: begun[s] for s in stems}, vocabulary)


def no_labels() -> ToxicityModel:
    """The model of the given word lists alone."""
    weights = np.zeros(9)
    weights[0], weights[1], weights[-1] = 2.5, 0.0, -4.0
    return ToxicityModel(Lexicon({}, {}, []), weights, np.array([1.0, 0.0]))


def fit_looks(lexicon: Lexicon, looks: list[tuple], labels: np.ndarray) -> ToxicityModel:
    """Fits on what the lexicon sees in the labelled texts. The labels serve for the share of toxic texts and to calibrate."""
    votes = np.array([v for v, _, _ in looks])
    model = LabelModel(labels.mean())
    posterior = model.fit(votes)
    n = len(lexicon.column)
    x = np.zeros((len(looks), n + len(looks[0][2])), np.float32)
    for i, (_, columns, dense) in enumerate(looks):
        x[i, columns] = 1
        x[i, n:] = dense
    weights = fit_logistic(x, posterior, ridge=2.0, steps=12)
    found = ToxicityModel(lexicon, weights, calibrate(x @ weights[:-1] + weights[-1], labels))
    found.label_model = model
    return found


def words_and_stems(text: str) -> tuple[set[str], set[str]]:
    own = set(words_of(text))
    return own, {w[:n] for w in own for n in STEMS if len(w) > n}


def fit_toxicity(texts: list[str], labels: np.ndarray, most_words: int = 3000, most_stems: int = 1500, most_features: int = 1500) -> ToxicityModel:
    """Fits on labelled texts at hand, of copies the first. :func:`fit_documents` does the same where texts are."""
    labels = np.asarray(labels, np.int64)
    first = unlike(texts)
    texts, labels = [texts[i] for i in first], labels[first]
    if not len(labels) or labels.min() == labels.max():
        return no_labels()
    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    for text, label in zip(texts, labels.tolist(), strict=True):
        for held, own in zip(counts, words_and_stems(text), strict=True):
            held[label].update(own)
    n1 = int(labels.sum())
    lexicon = learnt_words(n1, len(labels) - n1, counts[0][1], counts[0][0], counts[1][1], counts[1][0], most_words, most_stems, most_features)
    return fit_looks(lexicon, [lexicon.look(t) for t in texts], labels)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """at, label, text of about ``most`` documents of each class among those that may be learnt from.

    A document with several labels has the largest; of several texts with an id, the last in order counts.
    """
    known = labels.filter(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(named(id_col).alias("at")).agg(F.max(label).cast("int").alias("label"))
    chosen = of_each_class(known, most).select("at", "label")
    texts = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # About 2 * most ids at most; the join's other side stays where it is.
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["at"]).groupBy("at", "label").agg(F.max("text").alias("text"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [near_hashes(t.as_py()) for t in batch.column("text")]
        hashes = pa.array(np.array(near, np.uint64).reshape(-1).view(np.int64))
        offsets = pa.array(np.arange(0, len(hashes) + 1, 4, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), pa.ListArray.from_arrays(offsets, hashes)], ["at", "label", "near"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within a batch: the item, whether it is a beginning, and the toxic and the clean documents that have it."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            for stem, own in zip((False, True), words_and_stems(text.as_py()), strict=True):
                for item in own:
                    counts.setdefault((item, stem), [0, 0])[label] += 1
        rows = [(item, stem, n[1], n[0]) for (item, stem), n in counts.items()]
        for a in range(0, len(rows), 100_000):
            part = list(zip(*rows[a : a + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.bool_()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64())], ["item", "stem", "toxic", "clean"])


def _looking(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looks = [lexicon.value.look(t.as_py()) for t in batch.column("text")]
            columns = [[v.tolist() for v, _, _ in looks], [c for _, c, _ in looks], [d.tolist() for _, _, d in looks]]
            kinds = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["at", "label", "votes", "columns", "dense"])

    return run


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, most_words: int, most_stems: int, most_features: int) -> ToxicityModel:
    """Fits on a sample of labelled documents. Executors count words and look at texts, so the driver sees counts and numbers only."""
    sample = cut(labelled_sample(docs, labels, "toxic", most, id_col, text_col))
    kind = sample.schema["at"].dataType.simpleString()
    near = sample.mapInArrow(_near, f"at {kind}, label int, near array<long>").toPandas().sort_values("at", kind="stable")
    chosen = near.iloc[unlike_hashes(near["near"].tolist())]
    n1 = int(chosen["label"].sum())
    if not 0 < n1 < len(chosen):
        return no_labels()
    ids = sample.sparkSession.createDataFrame([(x,) for x in chosen["at"].tolist()], f"at {kind}")
    sample = cut(sample.join(F.broadcast(ids), "at"))  # 2 * most ids at most
    counts = sample.mapInArrow(_items, "item string, stem boolean, toxic long, clean long").groupBy("item", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The least that _marked asks for.
    odds = (F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (len(chosen) - n1 + 1))
    rows = counts.filter((F.col("toxic") >= 3) & (odds >= 3.99)).toPandas()
    held = [[dict(zip(part["item"], part[c].tolist(), strict=True)) for c in ("toxic", "clean")] for part in (rows[~rows["stem"]], rows[rows["stem"]])]
    lexicon = learnt_words(n1, len(chosen) - n1, *held[0], *held[1], most_words, most_stems, most_features)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)
    looks = sample.mapInArrow(_looking(shared), f"at {kind}, label int, votes array<int>, columns array<int>, dense array<float>").toPandas().sort_values("at", kind="stable")
    triples = [(np.array(v, np.int8), c.tolist() if hasattr(c, "tolist") else c, np.array(d, np.float32)) for v, c, d in zip(looks["votes"], looks["columns"], looks["dense"], strict=True)]
    return fit_looks(lexicon, triples, looks["label"].to_numpy(np.int64))


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            columns = [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_votes"])

    return run


def _adding(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            found = pa.array([model.value.score(texts[k].as_py() or "")[0] for k in range(batch.num_rows)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "score"])

    return run


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, most: int = 4000, most_words: int = 3000, most_stems: int = 1500, most_features: int = 1500) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns, where they are. See :func:`toxicity`."""
    model = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, id_col, text_col, most, most_words, most_stems, most_features))
    # Columns go by their places, as Python workers can't be given all names.
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = rows.columns[[c.lower() for c in docs.columns].index(text_col.lower())]
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return mapped(rows, _adding(model, text), schema).filter(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    most: int = 4000,
    most_words: int = 3000,
    most_stems: int = 1500,
    most_features: int = 1500,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_votes.

    ``labels`` has ids and toxic, 0 or 1; those of held-out documents are never
    read. The model is fitted on about ``most`` labelled documents of each class at
    most, whole texts, and has a bounded size: of the words and beginnings that
    mark toxic documents those with the most evidence, ``most_words`` and
    ``most_stems``, and ``most_features`` words with a weight of their own. n_votes is how many voters said toxic.

    A null text counts as empty and gets a score like any other. A null id is
    not held out. Rows repeat as they come; equal texts have equal scores. No
    rows give no rows. Without labels of both classes the score rests on the
    given word lists alone. Other columns of ``docs`` are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, id_col, text_col, most, most_words, most_stems, most_features))
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = mapped(rows, _scoring(model), f"doc_id {kind}, score double, n_votes int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_votes")
