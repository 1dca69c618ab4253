"""Line deduplication through a sharded minimal perfect hash.

A first pass counts, for each distinct line hash, the documents that hold the
line, and the largest of their ids. The hashes of lines in enough documents are
dealt into shards; over each shard a minimal perfect hash is built, which gives
every hash its own index into arrays of fingerprints, counts and largest ids. The
shards are files in the shared folder. A second pass streams through the
documents, whose lines probe the arrays in place: no line is joined or shuffled,
and a line whose fingerprint differs from the one at its index is not in the set.

Hash and fingerprint are the two halves of a 128-bit hash of the line's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, fresh_folder, named, text_or_empty

#: ASCII white space, stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: An output batch ends when its text has this many bytes.
BATCH_BYTES = 8_000_000
#: Bits of a level of the minimal perfect hash for each key that is left.
GAMMA = 1.7


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def is_long(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit keys for each level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, and the number of bits set before each word.

    At each level a key whose place no other key shares sets the bit there; the
    others go on to the next level. A key's index is the number of bits set
    before its own. A key outside the set gets any index, or -1.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(keys):
            size = max(64, -(-int(len(keys) * GAMMA) // 64) * 64)
            place = (_mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[place]]
            level += 1
            if level > 200:
                raise ValueError("the keys of a perfect hash must be distinct")
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(np.array(sizes, np.int64), bits, np.cumsum(counts) - counts)

    def index(self, keys: np.ndarray) -> np.ndarray:
        found, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = start + (place >> 6), (place & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            lower = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[left[hit]] = self.before[word[hit]] + np.bitwise_count(lower).astype(np.int64)
            left, start = left[~hit], start + (size >> 6)
        return found


#: Kinds of arrays in a shard's file.
KINDS = [np.dtype(np.int64), np.dtype(np.uint64), np.dtype(np.uint32)]


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Their number, the kind and length of each, and then the arrays themselves, each from a multiple of 8 bytes on."""
    head = np.array([len(arrays), *(x for a in arrays for x in (KINDS.index(a.dtype), len(a)))], np.int64)
    return b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in (head, *arrays))


def _unpack(buffer) -> list[np.ndarray]:
    """Views of the arrays."""
    n = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 2 * n, 8).reshape(-1, 2).tolist()
    at, arrays = 8 + 16 * n, []
    for kind, length in head:
        arrays.append(np.frombuffer(buffer, KINDS[kind], length, at) if length else np.zeros(0, KINDS[kind]))
        at += -(-length * KINDS[kind].itemsize // 8) * 8
    return arrays


def _line_hashes(least: int):
    """A row for each distinct long key of a document: its hash, fingerprint and the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, rows, digests = batch.column(0), [], []

            def out():
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), ids.take(pa.array(rows, pa.int32()))], ["h", "f", "doc_id"])

            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_buffer().to_pybytes()
                own = {xxh3_128_digest(key) for line in text.split(b"\n") if len(line) >= least and is_long(key := key_of(line), least)}
                digests.extend(own)
                rows.extend([k] * len(own))
                if len(rows) >= 100_000:
                    yield out()
                    rows, digests = [], []
            if rows:
                yield out()

    return run


def _build(folder: str):
    """Writes a shard's file; returns its number and how many keys it has."""

    def run(key, pdf):
        import pandas as pd

        shard = int(key[0])
        pdf = pdf.sort_values(["h", "f"])
        h = pdf["h"].to_numpy().view(np.uint64)
        first = np.concatenate([[True], h[1:] != h[:-1]])
        twins = pdf[~first]  # other keys with the same 64-bit hash: kept as a list, as good as never any
        pdf, h = pdf[first], h[first]
        function = PerfectHash.build(h)
        order = np.empty(len(h), np.int64)
        order[function.index(h)] = np.arange(len(h))
        columns = [pdf[c].to_numpy(np.int64)[order] for c in ("f", "largest")] + [pdf["n"].to_numpy(np.int64).clip(0, 2**32 - 1).astype(np.uint32)[order]]
        extra = twins[["h", "f", "largest"]].to_numpy(np.int64).reshape(-1)
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        import uuid

        draft = f"{path}/draft-{uuid.uuid4().hex}"  # a lost or repeated task leaves the file whole
        with store.open_output_stream(draft) as f:
            f.write(_pack([function.sizes, function.words, function.before, *columns, extra]))
        store.move(draft, f"{path}/shard-{shard}")
        return pd.DataFrame({"shard": [shard], "n_keys": [len(h) + len(twins)]})

    return run


class Shards:
    """The shards' arrays in the shared folder.

    Where that is a mounted folder its files are mapped, so nothing is loaded
    but the pages that are probed, and workers of a machine share them.
    Elsewhere files are read when first probed, and the ones used last stay, up to a bound.
    """

    #: Mapped files at a time.
    MAPPED = 1024

    def __init__(self, folder: str, n_shards: int, held_bytes: int):
        from collections import OrderedDict

        self.folder, self.n, self.most, self.held, self.loads = folder, n_shards, held_bytes, OrderedDict(), 0

    def shard(self, k: int) -> tuple:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        import pyarrow.fs as fs

        store, path = file_system(self.folder)
        path, mapped = f"{path}/shard-{k}", isinstance(store, fs.LocalFileSystem)
        with pa.memory_map(path) if mapped else store.open_input_file(path) as f:
            buffer = f.read_buffer(f.size())
        self.loads += 1

        def full() -> bool:
            return len(self.held) >= self.MAPPED if mapped else sum(b.size for b, *_ in self.held.values()) + buffer.size > self.most

        while self.held and full():
            self.held.popitem(last=False)
        arrays = _unpack(buffer)
        self.held[k] = (buffer, PerfectHash(*arrays[:3]), *arrays[3:6], arrays[6].reshape(-1, 3))
        return self.held[k]

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash and fingerprint: the count, 0 outside the set, and the largest id."""
        counts, largest = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = (h % np.uint64(self.n)).astype(np.int64)
        for k in np.unique(shard).tolist():
            at = np.flatnonzero(shard == k)
            _, function, prints, last, number, extra = self.shard(k)
            index = function.index(h[at])
            hit = (index >= 0) & (prints[index] == f[at])
            counts[at[hit]], largest[at[hit]] = number[index[hit]], last[index[hit]]
            for twin in extra:
                same = (h[at].view(np.int64) == twin[0]) & (f[at] == twin[1])
                counts[at[same]], largest[at[same]] = 1, twin[2]
        return counts, largest


def _drop(folder: str, n_shards: int, least: int, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shards = Shards(folder, n_shards, held_bytes) if n_shards else None

        def flush(ids, docs):
            """docs: the lines of consecutive documents, with the places and digests of the long ones."""
            number = np.array([len(d) for _, _, d in docs])
            pair = np.frombuffer(b"".join(x for _, _, d in docs for x in d), np.uint64).reshape(-1, 2)
            owner = np.repeat([-1 if i is None else i for i in ids.to_pylist()], number)
            known = np.repeat([i is not None for i in ids.to_pylist()], number).astype(bool)
            if shards and len(pair):
                counts, largest = shards.probe(pair[:, 0], pair[:, 1].view(np.int64))
                drops = (counts > 0) & ~(known & (owner == largest))
            else:
                drops = np.zeros(len(pair), bool)
            kept, n_dropped, at = [], [], 0
            for lines, places, digests in docs:
                own = np.flatnonzero(drops[at : at + len(digests)]).tolist()
                at += len(digests)
                gone = {places[i] for i in own}
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else b"\n".join(lines))
                n_dropped.append(len(gone))
            columns = [ids, pa.array([len(d[0]) for d in docs], pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])

        for batch in batches:
            start, held, docs = 0, 0, []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_buffer().to_pybytes()
                lines, places, digests = text.split(b"\n"), [], []
                for i, line in enumerate(lines):
                    if len(line) >= least and is_long(key := key_of(line), least):
                        places.append(i)
                        digests.append(xxh3_128_digest(key))
                docs.append((lines, places, digests))
                held += len(text)
                if held >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield flush(batch.column(0).slice(start, k + 1 - start), docs)
                    start, held, docs = k + 1, 0, []

    return run


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = 20,
    least_docs: int = 3,
    shard_keys: int = 500_000,
    held_bytes: int = 128 << 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that is left).

    A text's lines are what ``\\n`` parts. A line's key is the line without
    ASCII white space at its ends, A-Z in lower case. Keys of ``least_chars``
    code points or more, in ``least_docs`` documents or more, lose their lines
    everywhere but in the document with the largest id that holds them; there
    all of them stay.

    A null or empty text is one empty line. Each row is a document; rows that
    repeat an id count each, and keep the lines that their id keeps. A row
    whose id is null counts but keeps nothing, so lines held by null ids alone
    go everywhere. No rows give no rows. Ids are integers; other columns of
    ``docs`` are ignored. Shards of ``shard_keys`` keys lie in the shared folder
    until the driver ends; workers map them, or where the folder isn't mounted
    hold ``held_bytes`` of them at most, and one.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    hashes = rows.mapInArrow(_line_hashes(least_chars), "h long, f long, doc_id long")
    common = hashes.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("largest")).filter(F.col("n") >= least_docs)
    common = cut(common.withColumn("largest", F.coalesce("largest", F.lit(-(1 << 63)))))
    n_shards = -(-common.count() // shard_keys)
    folder = fresh_folder(spark, "lines")
    if n_shards:
        # As Python reads the hash: without a sign.
        shard = F.expr(f"cast(pmod(cast(h as decimal(20,0)) + case when h < 0 then 18446744073709551616BD else 0BD end, {n_shards}) as int)")
        common.withColumn("shard", shard).groupBy("shard").applyInPandas(_build(folder), "shard int, n_keys long").agg(F.sum("n_keys")).collect()
    return rows.mapInArrow(_drop(folder, n_shards, least_chars, held_bytes), "doc_id long, n_lines long, n_dropped long, kept string")
