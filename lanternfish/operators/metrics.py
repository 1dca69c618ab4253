"""Quality and speed of approximate graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nne_rate(real: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """recall: the share of real neighbours that were found, out of k for every point of ``real``."""
    hits = real.select("id", "neighbor_id").distinct().join(found.select("id", "neighbor_id").distinct(), ["id", "neighbor_id"])
    n = real.agg(F.countDistinct("id").alias("n"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).join(F.broadcast(n)).select((F.col("hits") / (F.col("n") * k)).alias("recall"))


def recall_eps(real: DataFrame, found: DataFrame, k: int, eps: float) -> DataFrame:
    """recall: the share of found neighbours within (1 + eps) times the farthest real one's distance, out of k for every point."""
    reach = real.groupBy("id").agg((F.max("sq_dist") * (1 + eps)).alias("reach"))
    n = real.agg(F.countDistinct("id").alias("n"))
    near = found.join(reach, "id").agg(F.sum(F.when(F.col("sq_dist") <= F.col("reach"), 1).otherwise(0)).alias("near"))
    return near.join(F.broadcast(n)).select((F.coalesce("near", F.lit(0)) / (F.col("n") * k)).alias("recall"))


def mean_distance(found: DataFrame) -> DataFrame:
    return found.agg(F.avg("sq_dist").alias("mean_sq_dist"))


def missing_neighbors(points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """id, missing of the points with fewer than k neighbours."""
    n = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return points.select("id").join(n, "id", "left").select("id", (F.lit(k) - F.coalesce("n", F.lit(0))).alias("missing")).filter("missing > 0")


def throughput(results: DataFrame) -> DataFrame:
    """points_per_second from n_points and seconds."""
    return results.withColumn("points_per_second", F.col("n_points") / F.col("seconds"))


def project(curve: DataFrame, values: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``level``, ``projected``: y at each of ``values`` (level), on the line through the two points of the curve around it, or the two at its end."""
    w = Window.partitionBy(*by).orderBy(x)
    pieces = curve.withColumn("x0", F.lag(x).over(w)).withColumn("y0", F.lag(y).over(w)).withColumn("x1", F.col(x)).withColumn("y1", F.col(y)).withColumn("xn", F.lead(x).over(w))
    pieces = pieces.filter(F.col("x0").isNotNull()).withColumn("first", F.row_number().over(w) == 1)
    inside = (F.col("first") | (F.col("level") > F.col("x0"))) & (F.col("xn").isNull() | (F.col("level") <= F.col("x1")))
    slope = (F.col("level") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return pieces.join(F.broadcast(values), inside).select(*by, "level", (F.col("y0") + slope * (F.col("y1") - F.col("y0"))).alias("projected"))


def speed_up(results: DataFrame, baseline: str, levels: list[float]) -> DataFrame:
    """method, level, speed_up: the baseline's seconds over a method's, at equal quality; ``results`` has method, quality, seconds."""
    spark = results.sparkSession
    values = spark.createDataFrame([(v,) for v in levels], "level double")
    at = project(results, values, ["method"], "quality", "seconds")
    base = at.filter(F.col("method") == baseline).select("level", F.col("projected").alias("base"))
    return at.join(base, "level").select("method", "level", (F.col("base") / F.col("projected")).alias("speed_up"))


def label_agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """agreement: the share of neighbours with the point's own label; ``labels`` has id and label."""
    a = labels.select("id", F.col("label").alias("own"))
    b = labels.select(F.col("id").alias("neighbor_id"), F.col("label").alias("other"))
    rows = found.join(a, "id").join(b, "neighbor_id")
    return rows.agg(F.avg(F.when(F.col("own") == F.col("other"), 1.0).otherwise(0.0)).alias("agreement"))
