"""Nearest neighbours of arriving points: a stream joined with a fixed base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lanternfish.operators.exact import exact_search
from lanternfish.operators.forest import Forest
from lanternfish.operators.graph import search_forest


def stream_search(stream: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, forest: Forest | None = None) -> StreamingQuery:
    """Starts a query that searches ``base`` for each micro-batch of points (id, vector) and gives the neighbours to ``sink``: exactly, or over a grown forest."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(search_forest(base, rows, forest, k) if forest else exact_search(base, rows, k), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
