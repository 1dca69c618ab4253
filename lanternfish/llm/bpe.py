"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A pre-token's merges are ordered by a hierarchical-bitmap rank queue: a bucket
per merge rank lists the positions (in a doubly linked list of symbols) where
that merge applies, a bit per rank marks the buckets that hold any, and bits
over those words of bits lead to the lowest set bit in three steps. The lowest
rank's bucket is worked off from left to right; an entry whose pair has changed
since is stale and skipped. A merge so costs a constant number of steps, however
long the pre-token. Many short pre-tokens are laid end to end, and the queue's
buckets hold arrays of their positions, one step merging a rank in all of them.
Pre-tokens met before come from a bounded memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

#: Pre-tokens that a worker remembers when it begins a batch, at most.
REMEMBERED = 200_000
#: Pre-tokens of up to so many bytes are merged together, where there are so many.
SHORT, MANY = 64, 10_000
#: Bytes of text that are worked on together, but for one text.
WORK_BYTES = 5_000_000
#: An output batch ends when its text has this many bytes.
BATCH_BYTES = 4_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file on the driver's machine or in any store that Spark reads."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return parse_ranks(data)


class RankQueue:
    """Positions by rank, with a bitmap of three levels that marks the ranks that have any.

    A bit of ``low`` stands for a rank, a bit of ``mid`` for a word of ``low``
    that isn't zero, a bit of ``top`` for a word of ``mid`` that isn't.
    """

    def __init__(self, n_ranks: int):
        n = max(1, n_ranks)
        self.buckets: dict[int, list] = {}
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        old = self.low[word]
        self.low[word] = old | 1 << (rank & 63)
        if not old:
            group = word >> 6
            old = self.mid[group]
            self.mid[group] = old | 1 << (word & 63)
            if not old:
                self.top |= 1 << group

    def take_first(self) -> tuple[int, list]:
        """Removes the lowest rank and its positions. The queue must hold some."""
        top = self.top
        group = (top & -top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        ranks = self.low[word]
        lowest = ranks & -ranks
        rank = word << 6 | lowest.bit_length() - 1
        ranks ^= lowest
        self.low[word] = ranks
        if not ranks:
            bits &= bits - 1
            self.mid[group] = bits
            if not bits:
                self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of a pre-token: the lowest-ranked adjacent pair is merged, the leftmost of equals first, until none has a rank.

    The queue is empty before and after.
    """
    get, push = ranks.get, queue.push
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [-1] * n  # the rank of the pair that begins at a position, or -1
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair[i] = rank
            push(rank, i)
    while queue.top:
        rank, bucket = queue.take_first()
        if len(bucket) > 1:
            bucket.sort()
        for k, i in enumerate(bucket):
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[gone] = -1
            lowest = rank
            new = None
            if end < n:
                before[end] = i
                new = get(piece[i : after[end]])
            if new is None:
                pair[i] = -1
            else:
                pair[i] = new
                push(new, i)
                lowest = new
            left = before[i]
            if left >= 0:
                new = get(piece[left:end])
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    push(new, left)
                    if new < lowest:
                        lowest = new
            if lowest < rank:  # a lower rank has come up; the rest of the bucket waits
                for j in bucket[k + 1 :]:
                    push(rank, j)
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """The rank of what two tokens make, for arrays of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        shift = max(ranks.values(), default=0) + 2
        found = {
            ranks[token[:i]] * shift + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.shift, self.none = shift, shift - 1  # none: a token that makes no pair
        self.keys = np.array([*sorted(found), 1 << 62], np.int64)
        self.made = np.array([*(found[k] for k in sorted(found)), -1], np.int32)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.int64(self.shift) * left + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs, queue: RankQueue) -> list[list[int]]:
    """As :func:`merge` for each of the pieces, none of them empty.

    A step takes the lowest rank's bucket and merges its leftmost place in each
    piece; other places in the same pieces wait, as a lower rank may come up.
    """
    lengths = np.array([len(p) for p in pieces])
    n = int(lengths.sum())
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
    token = np.append(single[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(pairs.none))  # place n stands for the end
    if (token[:n] < 0).any():
        raise KeyError("a byte has no rank")
    last = np.cumsum(lengths) - 1
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[last], before[last - lengths + 1] = n, n
    pair = np.append(pairs.look(token[:-1], token[after[:-1]]), np.int32(-1))

    def push(places, made):
        known = made >= 0
        if not known.all():
            places, made = places[known], made[known]
        if len(made) > 1:
            order = made.argsort(kind="stable")
            places, made = places[order], made[order]
            starts = np.flatnonzero(made[1:] != made[:-1]) + 1
            if len(starts):
                for rank, own in zip(made[np.append(0, starts)].tolist(), np.split(places, starts), strict=True):
                    queue.push(rank, own)
                return
        if len(made):
            queue.push(int(made[0]), places)

    push(np.arange(n, dtype=np.int32), pair[:-1])
    while queue.top:
        rank, bucket = queue.take_first()
        at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
        at = at[pair[at] == rank]  # the others are stale
        if len(at) > 1:
            at = np.sort(at)
            own = owner[at]
            later = own[1:] == own[:-1]
            if later.any():
                queue.push(rank, at[1:][later])
                at = at[np.append(True, ~later)]
        elif not len(at):
            continue
        gone = after[at]
        end = after[gone]
        after[at], before[end] = end, at
        token[at], token[gone], pair[gone] = rank, -1, -1
        left = before[at]
        made, made_left = pairs.look(rank, token[end]), pairs.look(token[left], rank)
        pair[at], pair[left] = made, made_left
        push(np.concatenate((at, left)), np.concatenate((made, made_left)))
    alive = np.flatnonzero(token[:n] >= 0)
    ids, ends = token[alive].tolist(), np.cumsum(np.bincount(owner[alive], minlength=len(pieces))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Texts to ids, decimal and joined by commas, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks, self.queue, self.pairs = ranks, RankQueue(max(ranks.values(), default=0) + 1), None
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        new = self.new = []  # pre-tokens whose ids aren't known yet

        class Numbers(dict):
            def __missing__(self, piece):
                new.append(piece)
                number = self[piece] = len(self)
                return number

        self.number, self.encoded = Numbers(), []

    def _learn(self) -> None:
        """Encodes the new pre-tokens."""
        ranks, pieces = self.ranks, [p.encode() for p in self.new]
        self.new.clear()
        found: list = [[ranks[p]] if p in ranks else None for p in pieces]
        short = [i for i, p in enumerate(pieces) if found[i] is None and len(p) <= SHORT]
        if len(short) >= MANY:
            self.pairs = self.pairs or Pairs(ranks)
            for i, ids in zip(short, merge_many([pieces[i] for i in short], ranks, self.pairs, self.queue), strict=True):
                found[i] = ids
        for i, ids in enumerate(found):
            self.encoded.append(",".join(map(str, merge(pieces[i], ranks, self.queue) if ids is None else ids)))

    def ids_texts(self, texts) -> Iterator[str]:
        """The ids of each of the texts, which must fit the memory together."""
        from array import array

        if len(self.encoded) > REMEMBERED:
            self._forget()
        numbers = [array("I", map(self.number.__getitem__, self.find(text))) for text in texts]
        self._learn()
        return (",".join(map(self.encoded.__getitem__, own)) for own in numbers)

    def ids_text(self, text: str) -> str:
        return next(self.ids_texts([text]))

    def decode(self, ids_text: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids_text.split(","))) if ids_text else b""


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of a column of texts with up to ``most`` bytes each, or one text."""
    sizes, start, held = column.cast(pa.large_binary()), 0, 0
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    for k, length in enumerate(lengths.tolist()):
        if k > start and held + length > most:
            yield start, k
            start, held = k, 0
        held += length
    if len(column):
        yield start, len(column)


def _encoding(ranks, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, WORK_BYTES):
                start, held, out, counts, back = a, 0, [], [], []
                for k, found in enumerate(encoder.ids_texts(texts[i].as_py() for i in range(a, b)), a):
                    out.append(found)
                    counts.append(found.count(",") + 1 if found else 0)
                    if decoded:
                        back.append(encoder.decode(found))
                    held += len(found)
                    if held >= BATCH_BYTES or k == b - 1:
                        columns = [ids.slice(start, k + 1 - start), pa.array(counts, pa.int64()), pa.array(out, pa.string())]
                        names = ["doc_id", "n_tokens", "ids_text"]
                        if decoded:
                            columns.append(pa.array(back, pa.binary()))
                            names.append("decoded")
                        yield pa.RecordBatch.from_arrays(columns, names)
                        start, held, out, counts, back = k + 1, 0, [], [], []

    return run


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_text, and decoded where asked for.

    ids_text is the ids in decimal, joined by commas: each match of ``pattern``
    is encoded on its own, without special tokens. decoded is the bytes that the
    ids stand for, found from ids_text alone.

    A null text counts as empty: no tokens, an empty ids_text, no bytes. Texts
    are encoded whole, of any length. Rows repeat as they come, with null ids too. No rows give
    no rows. Other columns of ``docs`` are ignored. What each worker gets besides
    is the vocabulary, whose size is fixed.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_text string" + ", decoded binary" * decoded
    return mapped(rows, _encoding(ranks, pattern, decoded), schema)


def _decoding(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {str(rank): token for token, rank in ranks.value.items()}
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].as_py()
                found = b"".join(map(bytes_of.__getitem__, ids.split(","))) if ids else b""
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([found], pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids_text") -> DataFrame:
    """One row per row of ``encoded``: doc_id and the decoded bytes. Null ids_text counts as empty; an id outside the vocabulary raises."""
    spark = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    rows = encoded.select(F.col(id_col).alias("doc_id"), text_or_empty(ids_col).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, _decoding(ranks), f"doc_id {kind}, decoded binary")
