"""Mixing sources to target weights: a time-varying curriculum over whole documents.

Every source has a share of the mix and a schedule, a piecewise-linear weight
over training progress 0..1.  The integral of the schedule up to progress t,
times the target, is the number of words the source has delivered by then.  A
document starts where its source has delivered all that lies before it, so its
training position is the inverse of that integral at its running word count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import order_key
from ..operators.ids import running_sum
from ..session import materialize
from .text import count_words

#: What stands between words: space, tab and the line breaks U+000A to U+000D.
GAP = r"[\x20\x09-\x0D]"
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: (progress, relative weight) knots per weight class: fading, level and growing sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def integrate(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, weight at t0, slope, share delivered before t0) per segment; the whole integral is 1."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    if area <= 0 or min(w for _, w in knots) < 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from 0 to 1 with weights of at least 0, not all 0")
    out, done = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        out.append((t0, t1, a / area, (b - a) / (t1 - t0) / area, done))
        done += (t1 - t0) * (a + b) / 2 / area
    return out


def progress_at(share: Column, knots) -> Column:
    """Training progress at which a source with this schedule has delivered ``share`` (0..1) of its target."""
    out = F.lit(1.0)
    for t0, t1, weight, slope, done in reversed(integrate(knots)):
        rest = share - F.lit(done)
        if slope == 0:
            step = rest / F.lit(weight) if weight else F.lit(t1 - t0)
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2 * slope) * rest))
            step = (root - F.lit(weight)) / F.lit(slope)
        out = F.when(share < F.lit(done + (t1 - t0) * (weight + slope * (t1 - t0) / 2)), F.lit(t0) + step).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def targets(sources: DataFrame, passes: int) -> DataFrame:
    """Words per source: total x weight share, at most ``passes`` x its size, the excess shared again by weight.

    ``sources`` is a written table (source, source_size, weight).  Each turn is
    one aggregate that returns one row: the level at which the uncapped
    sources, each at level x weight, fill what the capped ones leave.
    """
    cap = F.col("source_size") * passes
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > cap if capped >= 0 else F.lit(False)
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        level = (total - row["held"]) / row["open"] if row["open"] else 0.0
    full = F.lit(level) * F.col("weight") > cap
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(
    documents: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, passes: int = MAX_PASSES, seed: str = "mix"
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions, position.

    Sources in code-point order (null last) take ``weights`` and ``schedules``
    in turn.  A source is read in seeded order, pass after pass, until its
    target is met; the last document of the last pass may be taken in part.
    ``taken`` counts words over all passes, ``positions`` holds the training
    progress at which each pass begins the document, ``position`` is the first
    of them.  The result is range-sorted by it.

    A null text or one without words has size 0, is taken for 0 words and has
    no position (null, sorted last).  A null source is a source of its own.
    Repeated rows are separate documents, null ids are kept, further columns
    are ignored, an empty table gives an empty result.  No window spans a
    source: running sums are over a range partitioning, so a source may hold
    any part of all rows.
    """
    sizes = materialize(
        documents.select("doc_id", "source", count_words("text", GAP).alias("size")),
        "mix-sizes",
    )
    sources = running_sum(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "source_size", "_upto", "_rank"
    )
    kind = ((F.col("_rank") - 1) % len(weights)).cast("int")
    sources = materialize(
        sources.select(
            "source", "source_size", (F.col("_upto") - F.col("source_size")).alias("_before_source"), kind.alias("_kind"),
            F.element_at(F.array(*[F.lit(int(w)) for w in weights]), kind + 1).cast("bigint").alias("weight"),
        ),
        "mix-sources",
    )
    order = [F.col("source").asc_nulls_last(), F.col("_key").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")]
    keyed = sizes.withColumn("_key", order_key(F.col("doc_id"), seed))
    placed = running_sum(keyed, order, "size", "_upto", "_rank").drop("_key", "_rank")
    shared = targets(sources, passes).withColumnRenamed("source", "_source")
    joined = placed.join(shared, F.col("source").eqNullSafe(F.col("_source")), "left")
    start = F.col("_upto") - F.col("size") - F.col("_before_source")
    goal = F.floor("target")
    parts, at = [], []
    for n in range(passes):
        begin = start + F.col("source_size") * n
        part = F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), goal - begin))
        share, where = begin / F.col("target"), F.lit(None).cast("double")
        for k in range(len(weights)):
            where = F.when(F.col("_kind") == k, progress_at(share, schedules[k % len(schedules)])).otherwise(where)
        parts.append(part)
        at.append(F.when(part > 0, where))
    taken = parts[0]
    for part in parts[1:]:
        taken = taken + part
    out = joined.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
        F.array_compact(F.array(*at)).alias("positions"),
    )
    return out.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "doc_id")
