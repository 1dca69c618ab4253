"""Running sums over all rows of a table, in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternfish.plans.lineage import cut


def sums_before(df: DataFrame, by: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over the rows with lesser ``by``, which is unique.

    Rows are dealt to ranges of about the same number of rows, and a range starts where those before it end, so no
    window spans all rows. Which ranges there are doesn't change the sums.
    """
    columns = df.columns
    at = next(c for c in ("at", *(f"at{i}" for i in range(len(columns) + 1))) if c not in columns)
    dealt = df.repartitionByRange(parts, by) if parts else df.repartitionByRange(by)
    ranged = cut(dealt.withColumn(at, F.spark_partition_id()))
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy(at).agg(F.sum(value).alias("n")).select(at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy(at).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(F.broadcast(starts), at).select(*columns, (F.col(out) + F.col("start")).alias(out))
