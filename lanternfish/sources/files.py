"""Readers and writers of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.operators.prep import points_of, split_line, uniform_points


def read_parquet(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return points_of(spark.read.parquet(path), id_col, vector_col)


def read_csv(spark: SparkSession, path: str, label_first: bool = True, header: bool = False) -> DataFrame:
    """id, label, vector of numbers in columns, the label in the first where there is one. The id is a hash of file and row, so rows need no order."""
    rows = spark.read.option("header", header).csv(path)
    names = rows.columns
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names[int(label_first) :]])
    label = F.col(f"`{names[0]}`").cast("double").cast("int") if label_first else F.lit(None).cast("int")
    return rows.select(F.monotonically_increasing_id().alias("id"), label.alias("label"), values.alias("vector"))


def read_text(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """id, vector of lines of separated numbers."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return rows.select(F.monotonically_increasing_id().alias("id"), F.transform(F.split(F.trim("value"), separator), lambda x: x.cast("double")).alias("vector"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label of lines with one number each."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.trim("value").cast("double").cast("int").alias("label"))


def _decoder():
    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column("content")[k].as_py(), np.int32)
                if not len(data):
                    continue
                d = int(data[0])
                if d <= 0 or len(data) % (d + 1) or (data.reshape(-1, d + 1)[:, 0] != d).any():
                    raise ValueError(f"vectors of different sizes in {batch.column('path')[k].as_py()}")
                rows = data.reshape(-1, d + 1)[:, 1:].copy().view(np.float32).astype(float)
                path = batch.column("path")[k]
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, d, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part)), pa.array(np.arange(a, a + len(part))), vectors], ["path", "row", "vector"])

    return decode


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """path, row, vector of files in which each vector follows its length as a 32-bit integer. Files are decoded one a task; other lengths in a file raise."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_decoder(), "path string, row long, vector array<double>")


def write_text(points: DataFrame, path: str) -> None:
    """A line a point, its components separated by spaces."""
    points.select(F.array_join(F.transform("vector", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def catalog(spark: SparkSession) -> dict:
    """Named data sets: functions of a path or of sizes that give points."""
    return {
        "parquet": lambda path: read_parquet(spark, path),
        "csv": lambda path: read_csv(spark, path),
        "text": lambda path: read_text(spark, path),
        "fvecs": lambda path: read_fvecs(spark, path),
        "uniform": lambda n, d, seed=0: uniform_points(spark, n, d, seed),
        "split_line": lambda n, d, seed=0: split_line(spark, n, d, seed),
    }
