"""Benchmark results: a flat table, nested JSON and wide tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset string, k int, method string, param_name string, param_value double, quality_name string, quality double, seconds double"


def no_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add(results: DataFrame, **row) -> DataFrame:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return results.unionByName(results.sparkSession.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA))


def remove(results: DataFrame, method: str) -> DataFrame:
    return results.filter(F.col("method") != method)


def wide(results: DataFrame) -> DataFrame:
    """dataset, k, param_value, and for each method its seconds, quality."""
    return results.groupBy("dataset", "k", "param_value").pivot("method").agg(F.first("seconds").alias("seconds"), F.first("quality").alias("quality"))


def to_json(results: DataFrame) -> str:
    """dataset, k, method, parameter, quality name: parallel lists of parameters, qualities and seconds, in the order of the parameter."""
    keys = ["dataset", "k", "method", "param_name", "quality_name"]
    entry = F.array_sort(F.collect_list(F.struct("param_value", "quality", "seconds")))
    out: dict = {}
    for r in results.groupBy(*keys).agg(entry.alias("rows")).collect():  # a benchmark's results, not data
        at = out
        for key in keys[:-1]:
            at = at.setdefault(str(r[key]), {})
        at[r["quality_name"]] = {"parameters": [x[0] for x in r["rows"]], "quality": [x[1] for x in r["rows"]], "time": [x[2] for x in r["rows"]]}
    return json.dumps(out, sort_keys=True)


def sweep(points: DataFrame, k: int, configs: dict, quality, dataset: str, param_name: str, quality_name: str) -> DataFrame:
    """Results of the neighbour graph for each parameter value's config; ``quality`` maps a graph to a number."""
    import time

    from lanternfish.operators.graph import knn_graph
    from lanternfish.plans.lineage import cut

    rows = []
    for value, config in configs.items():
        began = time.perf_counter()
        graph = cut(knn_graph(points, k, config))
        seconds = time.perf_counter() - began
        rows.append((dataset, k, "forest", param_name, float(value), quality_name, float(quality(graph)), seconds))
    return points.sparkSession.createDataFrame(rows, SCHEMA)
