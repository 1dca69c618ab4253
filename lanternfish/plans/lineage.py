"""Cutting the lineage of loops, tables in the shared folder, and joins with small tables."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lanternfish-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(folder: str):
    """The file system of a folder, and the path in it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def filed(df: DataFrame, name: str) -> tuple[str, list[str]]:
    """Writes the rows once to the shared folder as Parquet, which tasks read: the folder and the names of its files."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder, sorted(unquote(f.rsplit("/", 1)[1]) for f in df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles())


def removed(folder: str) -> None:
    """Deletes a folder that nothing reads any more. One that can't be deleted from here stays; it only takes place."""
    try:
        store, inside = file_system(folder)
        store.delete_dir(inside)
    except (OSError, ValueError, ImportError):
        pass


def few(df: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """A table of ``n`` narrow rows, to be broadcast unless they are more than ``most``."""
    return F.broadcast(df) if n <= most else df
