"""Samples of labelled documents of a bounded number for each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few


def of_each_class(known: DataFrame, most: int, id_col: str = "at", class_col: str = "label") -> DataFrame:
    """About ``most`` rows of each class, all of a smaller class: those whose id's hash is below the class's threshold.

    Thresholds are a small table, broadcast unless the classes are very many. The same ids are taken however the rows are dealt.
    """
    limit = F.when(F.col("n") <= most, F.lit(1 << 40)).otherwise(F.floor(F.lit(float(1 << 40)) * most / F.col("n")))
    limits = cut(known.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n")).select("class", limit.cast("long").alias("limit")))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    return known.join(few(limits, limits.count()), F.col(class_col) == F.col("class")).filter(place < F.col("limit")).select(known.columns)
