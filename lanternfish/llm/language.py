"""Language identification by words first, then by shorter and shorter n-grams.

A word met often enough in learning scores by its log frequency in each
language. A word that wasn't backs off: its character n-grams of the greatest
length of which any is known score it by theirs, and so on down to single
letters; a word with no known letter says nothing. A document's score is the
mean over its words, weighted by their letters, of the log odds.

New words are looked up together, as arrays of n-gram hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, held_out, named, text_or_empty
from .sampling import of_each_class

WORD_OF_LETTERS = re.compile(r"[^\W\d_]+")
NO_LANGUAGE = "und"
#: Lengths of n-grams, the longest first. A word has a mark at either end.
LENGTHS = (5, 4, 3, 2, 1)
#: Words that a worker remembers when it begins a text, at most.
REMEMBERED = 400_000
#: Texts are taken together up to so many bytes.
WORK_BYTES = 16_000_000


def words_of(text: str) -> list[str]:
    return WORD_OF_LETTERS.findall(text.lower())


def lettered(text: str) -> list[str]:
    """The words of a text that has a letter; digits and the like in other scripts alone make none."""
    words = words_of(text)
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of marked words, one after the other, and the word that each belongs to."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    own = owner[: len(h)] == owner[n - 1 :]
    if n == 1:
        own &= points > 3  # the marks aren't letters
    return h[own], owner[: len(h)][own]


def budget(n_langs: int, most: int, most_scores: int) -> int:
    """Items of each language: ``most``, or fewer where the languages are so many that a table with a column for each would hold more than ``most_scores`` numbers."""
    return max(1, min(most, most_scores // max(1, n_langs) ** 2))


class LanguageModel:
    """Log frequencies of words and n-grams by language; of bounded size."""

    def __init__(self, langs: list[str], words: dict[str, int], word_scores: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.words, self.word_scores, self.tables = langs, words, word_scores, tables

    @classmethod
    def of_counts(cls, langs: list[str], words: tuple[list[str], np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """From how often the chosen words, and the chosen n-grams of each length in ascending order, are in each language."""
        return cls(langs, {w: k for k, w in enumerate(words[0])}, cls._scores(words[1]), [(keys, cls._scores(sums)) for keys, sums in tables])

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], least: int = 3, most_words: int = 20_000, most_grams: int = 30_000, most_scores: int = 1 << 23) -> LanguageModel:
        """Fits on texts at hand; :func:`fit_documents` does the same where texts are.

        Words in fewer than ``least`` texts count as unseen. Of words, and of n-grams of a length, the most frequent of each language stay.
        """
        names = sorted(set(langs))
        counts: dict[str, np.ndarray] = {}
        held: dict[str, int] = {}
        for text, lang in zip(texts, langs, strict=True):
            own = Counter(words_of(text))
            for w, n in own.items():
                counts.setdefault(w, np.zeros(len(names)))[names.index(lang)] += n
                held[w] = held.get(w, 0) + 1
        listed = sorted(counts)
        if not listed:
            return cls([], {}, np.zeros((0, 0), np.float32), [])
        total = np.array([counts[w] for w in listed]).reshape(len(listed), len(names))
        often = np.array([held[w] for w in listed]) >= least

        def top(sums: np.ndarray, most: int) -> np.ndarray:
            """Places of the most frequent of each language; ties go to the first."""
            n = budget(len(names), most, most_scores)
            return np.unique(np.concatenate([(o := np.lexsort((np.arange(len(sums)), -sums[:, k]))[:n])[sums[o, k] > 0] for k in range(len(names))]))

        chosen = top(total * often[:, None], most_words)
        tables = []
        for n in LENGTHS:
            h, owner = grams(listed, n)
            keys, at = np.unique(h, return_inverse=True)
            weight = np.sqrt(total)  # a frequent word's letters count less than as many others
            sums = np.stack([np.bincount(at, weight[owner, k], len(keys)) for k in range(len(names))], 1) if len(keys) else np.zeros((0, len(names)))
            kept = top(sums, most_grams) if len(keys) else np.zeros(0, np.int64)
            tables.append((keys[kept], sums[kept]))
        return cls.of_counts(names, ([listed[i] for i in chosen.tolist()], total[chosen]), tables)

    @staticmethod
    def _scores(sums: np.ndarray) -> np.ndarray:
        """Log frequencies by language, less their mean over the languages, within bounds."""
        if not sums.size:
            return sums.astype(np.float32)
        share = (sums + 0.05) / (sums.sum(0) + 0.05 * len(sums))
        score = np.log(share)
        score -= score.mean(1, keepdims=True)
        return np.clip(score, -6, 6).astype(np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        found = np.zeros((len(words), len(self.langs)), np.float32)
        if not self.langs:
            return found
        places = np.array([self.words.get(w, -1) for w in words], np.int64)
        if len(self.word_scores):
            found[places >= 0] = self.word_scores[places[places >= 0]]
        left = np.flatnonzero(places < 0)
        for n, (keys, scores) in zip(LENGTHS, self.tables, strict=True):
            if not len(left) or not len(keys):
                continue
            h, owner = grams([words[i] for i in left.tolist()], n)
            at = np.minimum(keys.searchsorted(h), len(keys) - 1)
            hit = keys[at] == h
            at, owner = at[hit], owner[hit]
            number = np.bincount(owner, minlength=len(left))
            known = number > 0
            sums = np.stack([np.bincount(owner, scores[at, k], len(left)) for k in range(len(self.langs))], 1)
            found[left[known]] = (sums[known] / number[known, None]).astype(np.float32)
            left = left[~known]
        return found


class Identifier:
    """Scores texts, remembering words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        new = self.new = []

        class Numbers(dict):
            def __missing__(self, word):
                new.append(word)
                number = self[word] = len(self)
                return number

        self.number = Numbers()
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)
        self.lengths = np.zeros(0, np.float32)

    def identify(self, texts) -> list[tuple[str, float]]:
        from array import array

        if len(self.number) > REMEMBERED:
            self._forget()
        numbers = [np.frombuffer(array("i", map(self.number.__getitem__, lettered(text))), np.int32) for text in texts]
        if self.new:
            self.rows = np.concatenate([self.rows, self.model.score_words(self.new)])
            self.lengths = np.concatenate([self.lengths, np.minimum([len(w) for w in self.new], 12).astype(np.float32)])
            self.new.clear()
        out = []
        for own in numbers:
            if not len(own) or not self.model.langs:
                out.append((NO_LANGUAGE, 0.0))
                continue
            weight = self.lengths[own]
            mean = weight @ self.rows[own] / weight.sum()
            z = mean.astype(float) * min(10.0, 2 + float(np.sqrt(len(own))))
            p = np.exp(z - z.max())
            best = int(p.argmax())
            out.append((self.model.langs[best], float(p[best] / p.sum())))
        return out


def language_sample(docs: DataFrame, most: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """at, lang, text of about ``most`` documents of each language among those that may be learnt from."""
    rows = docs.select(named(id_col).alias("at"), text_or_empty(text_col).alias("text"), named(lang_col).cast("string").alias("lang"))
    known = rows.filter(~held_out("at") & F.col("at").isNotNull() & F.col("lang").isNotNull())
    return of_each_class(known, most, class_col="lang").groupBy("at", "lang").agg(F.max("text").alias("text"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n, texts: how often a word is in a batch's texts of a language, and in how many of them."""
    for batch in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            for w, n in Counter(words_of(text.as_py())).items():
                held = counts.setdefault((lang, w), [0, 0])
                held[0] += n
                held[1] += 1
        rows = [(lang, w, n, texts) for (lang, w), (n, texts) in counts.items()]
        for a in range(0, len(rows), 100_000):
            part = list(zip(*rows[a : a + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64())], ["lang", "word", "n", "texts"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, length, gram, n of the n-grams of words, a word's by the root of its count."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False).astype(object)
        words, weight = batch.column("word").to_pylist(), np.sqrt(batch.column("n").to_numpy().astype(float))
        for lang in sorted(set(langs)):
            own = np.flatnonzero(langs == lang)
            for length in LENGTHS:
                h, owner = grams([words[i] for i in own.tolist()], length)
                keys, at = np.unique(h, return_inverse=True)
                sums = np.bincount(at, weight[own[owner]], len(keys)) if len(keys) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([length] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "length", "gram", "n"])


def _of_most(counts: DataFrame, keys: list[str], item: str, most: Column) -> DataFrame:
    """The counts (lang, keys, item, n) of the items that are among the ``most`` most frequent of a language."""
    w = Window.partitionBy("lang", *keys).orderBy(F.desc("n"), item)
    top = counts.filter("n > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*keys, item).distinct()
    return counts.join(top, [*keys, item], "left_semi")


def fit_documents(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int, least: int, most_words: int, most_grams: int, most_scores: int) -> LanguageModel:
    """Fits on a sample of documents. Executors count words and n-grams, so the driver sees the counts of those that stay only."""
    sample = language_sample(docs, most, id_col, text_col, lang_col)
    counts = cut(sample.mapInArrow(_word_counts, "lang string, word string, n long, texts long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), [])
    often = counts.groupBy("word").agg(F.sum("texts").alias("held")).filter(F.col("held") >= least).select("word")
    words = _of_most(counts.select("lang", "word", "n").join(often, "word", "left_semi"), [], "word", F.lit(budget(len(names), most_words, most_scores))).toPandas()
    grammed = counts.select("lang", "word", "n").mapInArrow(_gram_counts, "lang string, length int, gram long, n double").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    found = _of_most(cut(grammed), ["length"], "gram", F.lit(budget(len(names), most_grams, most_scores))).toPandas()
    index = {name: k for k, name in enumerate(names)}

    def table(items: np.ndarray, langs, n) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(items, return_inverse=True)
        sums = np.zeros((len(keys), len(names)))
        np.add.at(sums, (at, np.array([index[x] for x in langs], np.int64)), n)
        return keys, sums

    keys, sums = table(words["word"].to_numpy(object), words["lang"], words["n"].to_numpy(float))
    tables = []
    for length in LENGTHS:
        part = found[found["length"] == length]
        tables.append(table(part["gram"].to_numpy(np.int64).view(np.uint64), part["lang"], part["n"].to_numpy(float)))
    return LanguageModel.of_counts(names, (keys.tolist(), sums), tables)


def _identifying(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(model.value)
        for batch in batches:
            texts, start, held = batch.column(1), 0, 0
            for k in range(batch.num_rows):
                held += len(texts[k].as_buffer())
                if held >= WORK_BYTES or k == batch.num_rows - 1:
                    found = identifier.identify(texts[i].as_py() for i in range(start, k + 1))
                    columns = [batch.column(0).slice(start, k + 1 - start), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])
                    start, held = k + 1, 0

    return run


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most: int = 2000,
    least: int = 3,
    most_words: int = 20_000,
    most_grams: int = 30_000,
    most_scores: int = 1 << 23,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from about ``most`` documents of each language, whole texts, that
    have a language and aren't held out; a language's name is nothing but a
    label. Words in fewer than ``least`` of these texts back off to n-grams. Of
    words, and of n-grams of each length, the model knows the most frequent of
    each language, ``most_words`` and ``most_grams``, or fewer where there are so
    many languages that one table would hold over ``most_scores`` numbers.

    lang_pred is ``und``, with score 0, for a null text, one without a letter, and
    where nothing could be learnt. Otherwise score is the language's share
    among the learnt ones, from 0 to 1; ties go to the name that sorts first.

    A null id is not held out but is never learnt from. Rows repeat as they
    come. No rows give no rows. Other columns of ``docs`` are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, id_col, text_col, lang_col, most, least, most_words, most_grams, most_scores))
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_identifying(model), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
