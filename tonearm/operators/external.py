"""External metadata: matching, de-duplication, joining values per recording code."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text

SEPARATOR = " || "


def matched(rows: DataFrame) -> DataFrame:
    """Rows for which the lookup found an entity."""
    return rows.filter(F.col("wd_qid").isNotNull()).withColumn("isrc", text.match_key(F.col("isrc")))


def dedupe(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row per code: the first that has a description, else the first."""
    value = F.struct(*[c for c in rows.columns if c != "isrc"])
    first = F.min_by(value, F.struct(F.col("desc_en").isNull(), F.col(order))).alias("v")
    return rows.groupBy("isrc").agg(first).select("isrc", "v.*")


def uniq_join(rows: DataFrame, column: str, key: str = "isrc", order: str = "doc_id") -> DataFrame:
    """Distinct non-empty values of a column per key, in order of first appearance.

    Repeats are dropped by an aggregate on (key, value) first, so a key's list
    is as long as its number of distinct values, however many rows it has.
    """
    value = F.trim(F.col(column).cast("string"))
    once = (
        rows.select(key, value.alias("v"), order).filter("v <> ''").groupBy(key, "v").agg(F.min(order).alias("o"))
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda s: s["v"])
    return once.groupBy(key).agg(F.array_join(listed, SEPARATOR).alias(column))


def flags(rows: DataFrame, key: str = "isrc") -> DataFrame:
    """Featuring, single and vocal flags per code; each text is tested where it lies."""
    return rows.groupBy(key).agg(
        F.bool_or(text.has_featuring(F.col("desc_en"))).cast("int").alias("has_feat"),
        F.bool_or(text.has_word(F.col("type_label"), "single")).cast("int").alias("is_single"),
        F.bool_or(text.has_word(F.col("type_label"), "with vocals")).cast("int").alias("has_vocal"),
    )


def match_songs(songs: DataFrame, external: DataFrame, how: str) -> DataFrame:
    """Songs joined to per-code metadata by the trimmed, upper-cased code."""
    keyed = songs.withColumn("match_key", text.match_key(F.col("isrc")))
    side = external.withColumn("match_key", text.match_key(F.col("isrc"))).drop("isrc")
    return keyed.join(side, "match_key", how)
