"""Exact score arithmetic.

Scores are added as whole billionths. Whole numbers add up to the same total
in any order, so a ranking does not depend on how tasks were merged or
retried, and equal scores tie exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def billionths(value: Column) -> Column:
    return F.floor(value * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def score(total: Column, divisor: Column | None = None) -> Column:
    """A sum of billionths, over an optional divisor, as a score with six decimals."""
    unit = F.lit(1000.0) if divisor is None else F.lit(1000.0) * divisor
    return F.floor(total / unit + F.lit(0.5)) / F.lit(1e6)
