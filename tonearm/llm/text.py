"""Words of whole texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def split_words(text: Column | str, gap: str) -> Column:
    """The runs between matches of ``gap``, a class of single characters; none for a null text.

    Splitting at the gaps is several times faster in the JVM than collecting
    the runs; the empty strings it leaves at the ends are cut off.
    """
    parts = F.split(F.coalesce(text, F.lit("")), f"{gap}+")
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def count_words(text: Column | str, gap: str) -> Column:
    return F.size(split_words(text, gap)).cast("bigint")
