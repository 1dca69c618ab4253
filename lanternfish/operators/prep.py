"""Preparation of vectors and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.vectors import hash_uniform
from lanternfish.operators.numbering import sums_before
from lanternfish.plans.lineage import cut

#: A vector of so many copies is dealt to as many tasks.
SALTS = 256


def points_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector: the form in which all operators take points."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def dimension_ranges(points: DataFrame) -> DataFrame:
    """pos, lo, hi, radius: a dimension's least and greatest value, and their distance over the number of points."""
    each = points.select(F.posexplode("vector").alias("pos", "x"))
    return each.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), ((F.max("x") - F.min("x")) / F.count("x")).alias("radius"))


def random_motion(points: DataFrame, force: float = 1.0, seed: int = 0) -> DataFrame:
    """id, vector: each component moved by up to the dimension's radius times ``force``, as a hash of seed, id and dimension decides. Copies so come apart."""
    radii = dimension_ranges(points).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "radius"))), lambda e: e["radius"]).alias("radii"))  # one row, a number a dimension
    moved = F.transform(F.col("vector"), lambda x, i: x + (2 * hash_uniform(seed, F.col("id"), i) - 1) * F.element_at("radii", i + 1) * force)
    return points.join(F.broadcast(radii)).select("id", moved.alias("vector"))


def scale_pixels(points: DataFrame, as_coded: bool = False) -> DataFrame:
    """Pixels from 0 to 255 as 0.01 to 1; ``as_coded`` multiplies by the sum of factor and shift, as one loader of old does."""
    factor, shift = 0.99 / 255, 0.01
    scaled = F.transform("vector", (lambda x: x * (factor + shift)) if as_coded else (lambda x: x * factor + shift))
    return points.select("id", scaled.alias("vector"))


def dedup_vectors(points: DataFrame) -> DataFrame:
    """id, first_id, unique_no, n_copies: for each point the least id with the same vector, and the place of the vector among the distinct ones in order of that id."""
    distinct = cut(points.groupBy("vector").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")))
    number = sums_before(distinct.select("first_id", F.lit(1).alias("one")), "first_id", "one", "unique_no").select("first_id", "unique_no")
    numbered = distinct.join(number, "first_id")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")  # copies of a vector go to several tasks
    dealt = numbered.withColumn("salt", F.explode(F.when(F.col("n_copies") >= SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    many = points.select("id", "vector", salt.alias("salt")).join(dealt.filter(F.col("n_copies") >= SALTS), ["vector", "salt"])
    single = points.join(numbered.filter(F.col("n_copies") < SALTS), "vector")
    columns = ["id", "first_id", "unique_no", "n_copies"]
    return single.select(*columns).union(many.select(*columns))


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the column from 0 at its least to 1 at its greatest."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def hash_split(df: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """``is_train``: true for about ``share`` of the rows, as a hash of seed and id decides."""
    return df.withColumn("is_train", hash_uniform(seed, "split", F.col(id_col)) < share)


def first_by_hash(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """A subset of ``n`` rows: the first in the order of a hash."""
    from lanternfish.functions.vectors import sample_key

    return df.orderBy(sample_key(seed, F.col(id_col)), id_col).limit(n)


def uniform_points(spark, n: int, d: int, seed: int = 0) -> DataFrame:
    """id, vector: ``n`` points with ``d`` components in [0, 1)."""
    values = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: hash_uniform(seed, F.col("id"), i))
    return spark.range(n).select("id", values.alias("vector"))


def split_line(spark, n: int, d: int, seed: int = 0) -> DataFrame:
    """id, vector: two separate halves of a diagonal with a little noise."""
    base = F.when(F.col("id") < n // 2, F.col("id") / n).otherwise(F.col("id") / n + 1.0)
    values = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: base + hash_uniform(seed, F.col("id"), i) * (1.0 / n))
    return spark.range(n).select("id", values.alias("vector"))


def reduce_dimensions(points: DataFrame, d: int) -> DataFrame:
    """id, vector of ``d`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.select("id", array_to_vector("vector").alias("features"))
    model = PCA(k=d, inputCol="features", outputCol="reduced").fit(rows)
    return model.transform(rows).select("id", vector_to_array("reduced").alias("vector"))


def with_class_names(df: DataFrame, names: DataFrame, label_col: str = "label") -> DataFrame:
    """``class_name`` from a table of label and class_name; null where a label has none."""
    return df.join(names.select(F.col("label").alias("_label"), "class_name"), F.col(label_col) == F.col("_label"), "left").drop("_label")
