"""Neighbour graph of generated or stored points, for spark-submit or ``python -m lanternfish``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from lanternfish.operators.graph import knn_graph
from lanternfish.operators.metrics import mean_distance
from lanternfish.plans.config import ForestConfig
from lanternfish.plans.lineage import cut
from lanternfish.sources.files import catalog


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs one graph, prints and returns points, neighbours, seconds and mean squared distance."""
    ask = argparse.ArgumentParser(prog="lanternfish", description=__doc__)
    ask.add_argument("--data", choices=["uniform", "split_line", "parquet", "csv", "text"], default="uniform")
    ask.add_argument("--path", help="of stored points")
    ask.add_argument("--points", type=int, default=10_000)
    ask.add_argument("--dims", type=int, default=2)
    ask.add_argument("--k", type=int, default=32)
    ask.add_argument("--trees", type=int, default=5)
    ask.add_argument("--min-leaf", type=int, default=33)
    ask.add_argument("--max-leaf", type=int, default=66)
    ask.add_argument("--explore", type=int, default=1)
    ask.add_argument("--seed", type=int, default=0)
    ask.add_argument("--out", help="folder for the graph as Parquet")
    given = ask.parse_args(args)
    generated = given.data in ("uniform", "split_line")
    if not generated and not given.path:
        ask.error("--path is needed")
    spark = spark or SparkSession.builder.appName("lanternfish").getOrCreate()
    make = catalog(spark)[given.data]
    points = make(given.points, given.dims, given.seed) if generated else make(given.path)
    config = ForestConfig(seed=given.seed, n_trees=given.trees, min_leaf=given.min_leaf, max_leaf=given.max_leaf, explore=given.explore)
    began = time.perf_counter()
    graph = cut(knn_graph(points, given.k, config))
    report = {"seconds": round(time.perf_counter() - began, 3), "neighbours": graph.count(), "mean_sq_dist": mean_distance(graph).first()[0]}
    if given.out:
        graph.write.parquet(given.out)
    print(report)
    return report


if __name__ == "__main__":
    main()
