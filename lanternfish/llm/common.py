"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def free(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it if one of the columns is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves, but only in plain local mode, where one machine
    runs everything; elsewhere this raises.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if now is None:
        if given is None:
            master = sc.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="lanternfish-")
        sc.setCheckpointDir(given)
        now = sc.getCheckpointDir()
    return now


#: Spark's setting that deletes the shuffle files of a query as soon as it has ended.
CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; lineage ends there, and the shuffle files behind it are deleted."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANING, "false")
    conf.set(CLEANING, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANING, before)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other call uses. What is there when the driver ends is deleted."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows as a Parquet table in the shared folder, of which each reader takes the columns that it needs, and its path."""
    path = fresh_folder(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.parquet(path), path


def written(df: DataFrame, path: str) -> None:
    """Writes Parquet, after which the shuffle files behind it are deleted."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANING, "false")
    conf.set(CLEANING, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        conf.set(CLEANING, before)


def removed(path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more. One that can't be deleted from here stays; it only takes place."""
    try:
        store, inside = file_system(path)
        store.delete_dir(inside)
    except (OSError, ValueError, ImportError):
        pass


def file_system(folder: str):
    """The file system of the shared folder, and the path in it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def trimmed(run):
    """``run``, a function from Arrow batches to Arrow batches, after which the Python worker, which waits for other tasks, gives its free memory back."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library, which has its own ways

    return wrapped


#: Spark's setting of the bytes of a batch of rows for a Python worker, its default, and the size for whole texts.
BATCH_SIZE, DEFAULT_SIZE, TEXT_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows`` through ``run``, see :func:`trimmed`, in batches of up to ``TEXT_SIZE`` or one row.

    A task's JVM and its Python worker each hold batches, so these bound what it takes. The size is the
    session's and stays set, as rows are read later; a session that has another size than Spark's default keeps it.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SIZE, f"{DEFAULT_SIZE}b") == f"{DEFAULT_SIZE}b":
        conf.set(BATCH_SIZE, TEXT_SIZE)
    return rows.mapInArrow(trimmed(run), schema)


#: Filters of ids have from 2 ** LEAST_BITS to 2 ** MOST_BITS places; beyond so many ids rows are joined instead.
LEAST_BITS, MOST_BITS = 16, 25


def filter_bits(n: int, most_bits: int = MOST_BITS) -> int | None:
    """Places, as a power of two, of a filter in which ``n`` ids mark a quarter at most; None if that needs more than ``most_bits``."""
    bits = max(LEAST_BITS, (4 * n - 1).bit_length())
    return bits if bits <= most_bits else None


def id_filter(ids: DataFrame, id_col: str, bits: int) -> DataFrame:
    """word, marks: a bitmap over the hashes of ids, modulo 2 ** bits, by words of 32 bits. At most 2 ** (bits - 5) rows."""
    place = F.pmod(F.xxhash64(named(id_col)), F.lit(1 << bits)).cast("int")
    marked = ids.select(place.alias("p")).select(F.shiftrightunsigned("p", 5).alias("word"), F.expr("shiftleft(1L, p & 31)").alias("bit"))
    return marked.groupBy("word").agg(F.bit_or("bit").alias("marks"))


def halved_by(rows: DataFrame, ids: DataFrame, id_col: str, n_ids: int, most_bits: int = MOST_BITS) -> tuple[DataFrame | None, DataFrame]:
    """The rows whose id is surely not among ``ids`` (one column of that name), and the others, the ids' and a few more.

    A filter that is broadcast tells them apart, its size by the number of ids
    and bounded; with more ids all rows are in the second part.
    """
    bits = filter_bits(n_ids, most_bits)
    if bits is None:
        return None, rows
    place, word, marks = (free(rows.columns, x) for x in ("place", "word", "marks"))
    words = F.broadcast(id_filter(ids, id_col, bits).withColumnsRenamed({"word": word, "marks": marks}))
    at = F.pmod(F.xxhash64(named(id_col)), F.lit(1 << bits)).cast("int")
    looked = rows.withColumn(place, at).join(words, F.shiftrightunsigned(F.col(place), 5) == F.col(word), "left")
    marked = F.coalesce(F.expr(f"shiftright({marks}, {place} & 31) & 1"), F.lit(0)) == 1
    return looked.filter(~marked).drop(place, word, marks), looked.filter(marked).drop(place, word, marks)


def without(rows: DataFrame, ids: DataFrame, id_col: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` but those whose id is among ``ids`` (one column of that name, no nulls), which is read more than once. Only rows whose id the filter marks are shuffled."""
    gone = free(rows.columns, "gone")
    clear, marked = halved_by(rows, ids, id_col, ids.count(), most_bits)
    rest = marked.join(ids.select(named(id_col).alias(gone)), named(id_col) == F.col(gone), "left_anti")
    return rest if clear is None else clear.unionByName(rest)


def few(df: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """A table of ``n`` narrow rows, to be broadcast unless they are more than ``most``."""
    return F.broadcast(df) if n <= most else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(named(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def held_out(name: str = "doc_id") -> Column:
    """True for the documents that nothing may be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(named(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))
