"""Vector arithmetic on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sum_of(vector: str, dims: int, weight: str | None = None) -> Column:
    """Element-wise (weighted) sum over a group of the named columns.

    One plain ``sum`` per dimension: partial aggregation happens before the
    shuffle, so a group of any size costs one buffer per task.
    """
    factor = f" * {weight}" if weight else ""
    return F.expr("array(" + ", ".join(f"sum(CAST(get({vector}, {d}) AS DOUBLE){factor})" for d in range(dims)) + ")")


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def text(vector: Column, digits: int = 5) -> Column:
    """Comma list of rounded values, for reports and comparisons."""
    fixed = F.transform(vector, lambda x: F.round(x.cast("double"), digits).cast("decimal(20,%d)" % digits).cast("string"))
    return F.array_join(fixed, ",")
