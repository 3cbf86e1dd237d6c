"""Running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Seed of the column that deals equal rows to several ranges.
SPREAD = 11


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column | str]) -> DataFrame:
    """``df`` with one running sum per entry of ``sums`` inside each group of equal ``keys``, in ``order``.

    The rows are dealt by ranges of (keys, order), so a group may hold any part
    of all rows and equal rows may lie in several ranges.  Sums run inside each
    range; what a group had in earlier ranges is added from one small row per
    range.  Null keys form a group of their own.  The order of equal rows among
    each other is arbitrary, but fixed once read, as the ranges are written.
    """
    spark = df.sparkSession
    named = df.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"_in_{k}") for k, v in sums.items()])
    ranged = named.withColumn("_spread", F.rand(SPREAD)).repartitionByRange(*[F.col(k) for k in keys], *order, F.col("_spread"))
    ranged = materialize(ranged.drop("_spread").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part", *keys).agg(*[F.sum(f"_in_{k}").alias(k) for k in sums])
    group = F.struct(*keys)
    ends = totals.groupBy("_part").agg(F.min(group).alias("low"), F.max(F.struct(group.alias("key"), *sums)).alias("high")).orderBy("_part")
    rows, held = [], None  # ``held``: the group that the ranges so far end with, and its sums
    for end in ends.collect():
        mine = held is not None and held[0] == end["low"]
        if mine:
            rows.append((end["_part"], held[0], *held[1:]))
        last = [end["high"][k] for k in sums]
        if mine and end["low"] == end["high"]["key"]:
            last = [a + b for a, b in zip(held[1:], last)]
        held = (end["high"]["key"], *last)
    schema = totals.select("_part", group.alias("_group"), *[F.col(k).alias(f"_old_{k}") for k in sums]).schema
    carried = spark.createDataFrame(rows, schema)
    joined = ranged.join(F.broadcast(carried), "_part", "left")
    old = F.col("_group").eqNullSafe(group)
    made = [(F.sum(f"_in_{k}").over(inside) + F.coalesce(F.when(old, F.col(f"_old_{k}")), F.lit(0))).alias(k) for k in sums]
    return joined.select(*df.columns, *made)
