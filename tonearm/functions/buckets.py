"""Fixed-edge bins, levels and other step functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Upper edges of the age, tenure, length and watch-time bins and
# the experience needed for levels 2 to 6.
AGE_EDGES = (0, 12, 18, 25, 35, 50, 80)
TENURE_EDGES = (30, 180, 365, 730, 1825, 3650)
LENGTH_MINUTES = (1, 2, 3, 4, 5, 300)
LENGTH_LABELS = ("0-1", "1-2", "2-3", "3-4", "4-5", "5+")
WATCH_EDGES = (10, 30, 60, 180)
WATCH_WEIGHTS = (0.0, 0.1, 0.3, 0.5, 0.7)
LEVEL_XP = (50, 100, 200, 400, 800)


def steps(col: Column, edges: Sequence, values: Sequence, closed: str, above=None) -> Column:
    """Step function over ascending ``edges``; ``above`` is the value past the last edge."""
    inside = (lambda e: col <= F.lit(e)) if closed == "right" else (lambda e: col < F.lit(e))
    expr = None
    for edge, value in zip(edges, values):
        expr = F.when(inside(edge), F.lit(value)) if expr is None else expr.when(inside(edge), F.lit(value))
    return expr.when(col.isNotNull(), F.lit(above)) if above is not None else expr


def age_group(age: Column) -> Column:
    return F.when(age > -1, steps(age, AGE_EDGES, range(7), "right"))


def tenure_group(days: Column) -> Column:
    return F.when(days >= 0, steps(days, TENURE_EDGES, range(6), "right", above=6))


def length_label(millis: Column) -> Column:
    minutes = millis / F.lit(60000.0)
    return F.when(minutes >= 0, steps(minutes, LENGTH_MINUTES, LENGTH_LABELS, "left"))


def watch_weight(seconds: Column) -> Column:
    return steps(seconds, WATCH_EDGES, WATCH_WEIGHTS[:-1], "left", above=WATCH_WEIGHTS[-1])


def level(xp: Column) -> Column:
    expr = F.lit(1)
    for threshold in LEVEL_XP:
        expr = expr + (xp >= threshold).cast("int")
    return expr


def level_floor(xp: Column) -> Column:
    """Experience at which the current level starts."""
    expr = F.lit(0)
    for threshold in LEVEL_XP:
        expr = F.when(xp >= threshold, threshold).otherwise(expr)
    return expr


def level_span(xp: Column) -> Column:
    """Experience between the current level and the next; null at the top level."""
    expr = None
    for low, high in zip((0, *LEVEL_XP[:-1]), LEVEL_XP):
        cond = xp < high
        expr = F.when(cond, high - low) if expr is None else expr.when(cond, high - low)
    return expr
