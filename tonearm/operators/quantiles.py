"""Exact quantiles and modes by rank selection over counted values.

Rows are counted per value first, so a value that a third of all rows share is
one row. The counted values are range-partitioned and summed up in order
(``ids.running_sum``); the value at a rank is the smallest one whose running
sum passes it. No task sees more than its range of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .ids import running_sum


def counted(df: DataFrame, column: str) -> DataFrame:
    """(column, n): written counts of the values, null left out; NaN counts as the largest value."""
    return materialize(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def quantiles(counts: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linear interpolation at ``share * (rows - 1)`` for each share; all ``None`` where there are no rows."""
    rows = counts.agg(F.sum("n")).first()[0]
    if not rows:
        return [None] * len(shares)
    summed = running_sum(counts, [F.col(column)], "n", "_upto", "_place")
    places = [s * (rows - 1) for s in shares]
    edges = sorted({e for p in places for e in (math.floor(p), math.ceil(p))})
    found = summed.agg(*[F.min(F.when(F.col("_upto") > e, F.col(column))).alias(f"at_{i}") for i, e in enumerate(edges)]).first()
    at = dict(zip(edges, found))

    def value(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        if low == high or at[low] == at[high]:
            return float(at[low])
        return (high - place) * float(at[low]) + (place - low) * float(at[high])

    return [value(p) for p in places]


def median(df: DataFrame, column: str) -> Column:
    """The exact median as a literal; null where there are no values."""
    return F.lit(quantiles(counted(df, column), column, [0.5])[0]).cast("double")


def mode(df: DataFrame, column: str) -> Column:
    """The most frequent value, the smallest of those on ties; null where there are no values."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return top.orderBy(F.desc("n"), column).limit(1).select(column).scalar()
