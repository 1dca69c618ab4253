"""Vector arithmetic as Spark expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, the only metric of the engine."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def scale(a: Column, factor: float, shift: float = 0.0) -> Column:
    return F.transform(a, lambda x: x * factor + shift)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that the parts decide: the first 13 hex digits of their md5, as a fraction."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns])), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sample_key(*parts: Column | str | int) -> Column:
    """The md5 by which samples are ordered."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))
