"""Affinity of a user to a song from plays, likes and favourites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import buckets

# Signal weights and limits.
SKIP_SECONDS = 5
SKIP_PENALTY = -0.1
SKIP_FLOOR = -0.5
LIKE_WEIGHT = 0.5
DISLIKE_WEIGHT = -1.0
FAVORITE_WEIGHT = 0.5
FILTER_BELOW = -0.5
DEFAULT_AFFINITY = 0.3


def score(seconds: Column, skips: Column, favorite: Column, like_state: Column) -> Column:
    raw = (
        buckets.watch_weight(seconds)
        + F.greatest(skips * F.lit(SKIP_PENALTY), F.lit(SKIP_FLOOR))
        + F.when(favorite, FAVORITE_WEIGHT).otherwise(0.0)
        + F.when(like_state == 1, LIKE_WEIGHT).when(like_state == -1, DISLIKE_WEIGHT).otherwise(0.0)
    )
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))


def signals(history: DataFrame, likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """One long table of signals, so that one aggregation replaces three joins.

    likes: (user_id, item_id, is_liked); favorites: (user_id, item_id).
    """
    none_int, no = F.lit(0), F.lit(False)
    skip = F.col("watch_seconds") < SKIP_SECONDS
    plays = history.select(
        "user_id", "item_id",
        F.when(skip, 0).otherwise(F.col("watch_seconds")).alias("seconds"),
        skip.cast("int").alias("skips"),
        no.alias("favorite"),
        none_int.alias("like_state"),
    )
    liked = likes.select(
        "user_id", "item_id", none_int.alias("seconds"), none_int.alias("skips"), no.alias("favorite"),
        F.when(F.col("is_liked"), 1).otherwise(-1).alias("like_state"),
    )
    saved = favorites.select(
        "user_id", "item_id", none_int.alias("seconds"), none_int.alias("skips"), F.lit(True).alias("favorite"),
        none_int.alias("like_state"),
    )
    return plays.unionByName(liked).unionByName(saved)


def aggregate(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("user_id", "item_id").agg(
        F.sum("seconds").alias("total_watch_seconds"),
        F.sum("skips").alias("skip_count"),
        F.bool_or("favorite").alias("is_favorited"),
        F.sum("like_state").cast("int").alias("like_state"),
    )
    return grouped.withColumn(
        "score",
        F.round(score(F.col("total_watch_seconds"), F.col("skip_count"), F.col("is_favorited"), F.col("like_state")), 6),
    )


def affinity_scores(history: DataFrame, likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """(user_id, item_id, total_watch_seconds, skip_count, is_favorited, like_state, score)."""
    return aggregate(signals(history, likes, favorites.select("user_id", "item_id").distinct()))
