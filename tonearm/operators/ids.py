"""Dense ids, running sums and places in runs without a single-task window.

All are two-pass: a range partitioning written once, one small total per
partition, and a window inside each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition number, fixed on storage.

    The boundaries come from a sample, so both passes must read one copy.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _before(totals: DataFrame) -> DataFrame:
    """Sum of the totals of all earlier partitions; at most one row per partition."""
    running, rows = 0, []
    for row in totals.orderBy("_part").collect():
        rows.append((row["_part"], running))
        running += row["_total"]
    return totals.sparkSession.createDataFrame(rows, "_part int, _before bigint")


def dense_ids(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """(key, out): every distinct non-null key with its position in ascending order."""
    ranged = _ranged(df.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)])
    offsets = _before(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_total")))
    position = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.join(F.broadcast(offsets), "_part").select(
        key, (F.col("_before") + position + F.lit(start - 1)).cast("int").alias(out)
    )


def encode(df: DataFrame, column: str, ids: DataFrame, out: str, how: str = "left") -> DataFrame:
    """Replace a key column by its id; ``how='inner'`` drops unknown keys."""
    return df.join(ids.select(column, out), column, how).drop(column)


def running_sum(df: DataFrame, order: list[Column], value: str, sum_col: str, rank_col: str) -> DataFrame:
    """Running sum and 1-based rank of every row in a global order."""
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_part").agg(
        F.sum(value).alias("_value"), F.count(F.lit(1)).alias("_rows")
    )
    sums = _before(totals.select("_part", F.col("_value").alias("_total"))).withColumnRenamed("_before", "_sum0")
    rows = _before(totals.select("_part", F.col("_rows").alias("_total"))).withColumnRenamed("_before", "_row0")
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(sums), "_part")
        .join(F.broadcast(rows), "_part")
        .withColumn(sum_col, F.col("_sum0") + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(rank_col, F.col("_row0") + F.row_number().over(inside))
        .drop("_part", "_sum0", "_row0")
    )


def run_places(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """1-based place of every row in its run of equal ``value`` among the rows of its keys, in ``order``.

    A key's rows may lie in many partitions; a run that goes on into the next
    one is carried over by its length.
    """
    ranged = _ranged(df, [F.col(c) for c in (*keys, *order)])
    inside = Window.partitionBy("_part").orderBy(*keys, *order)
    row, same = F.row_number().over(inside), F.lit(True)
    for c in (*keys, value):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(inside))
    marked = ranged.withColumns({"_row": row, "_new": (row > 1) & ~same})
    begin = F.max(F.when(F.col("_new"), F.col("_row"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.withColumn("_begin", begin).withColumn("_at", F.col("_row") - F.coalesce("_begin", F.lit(1)) + 1)
    run = F.struct(*keys, value)
    ends = placed.groupBy("_part").agg(
        F.min_by(run, "_row").alias("first"), F.max_by(run, "_row").alias("last"), F.max_by("_at", "_row").alias("length"), F.max("_begin").alias("begin")
    )
    carried, rows = (None, 0), []
    for end in ends.orderBy("_part").collect():
        before = carried[1] if carried[0] == end["first"] else 0
        rows.append((end["_part"], before))
        carried = (end["last"], end["length"] + (before if end["begin"] is None else 0))
    befores = df.sparkSession.createDataFrame(rows, "_part int, _before bigint")
    place = F.col("_at") + F.when(F.col("_begin").isNull(), F.col("_before")).otherwise(0)
    return placed.join(F.broadcast(befores), "_part").withColumn(out, place).drop("_part", "_row", "_new", "_begin", "_at", "_before")
