"""Choice of algorithm, recompute rule and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import languages
from . import affinity
from .embeddings import WARM_MIN_ITEMS
from .itemknn import rank_users

PENALTY = 0.2
PAGE = 9


def algorithm_choice(users: DataFrame, history: DataFrame, picks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(user_id, n_history, algorithm): warm from ten distinct songs when the model knows one of them.

    Users without onboarding picks get no recommendations at all.
    """
    counts = (
        history.select("user_id", "item_id").distinct()
        .join(vocabulary.select("item_id", F.lit(1).alias("known")), "item_id", "left")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_history"), F.count("known").alias("n_known"))
    )
    seeds = picks.select("user_id").distinct().withColumn("has_seed", F.lit(1))
    n = F.coalesce("n_history", F.lit(0))
    choice = (
        F.when(F.col("has_seed").isNull(), "none")
        .when((n >= WARM_MIN_ITEMS) & (F.coalesce("n_known", F.lit(0)) > 0), "purecf")
        .otherwise("hybrid")
    )
    return (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .join(seeds, "user_id", "left")
        .select("user_id", n.alias("n_history"), choice.alias("algorithm"))
    )


def recalc_due(users: DataFrame, history: DataFrame, batches: DataFrame) -> DataFrame:
    """Users whose recommendations must be computed again: no batch yet, or ten new songs since."""
    songs = history.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_history"))
    stored = batches.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_batches"))
    joined = users.select("user_id").join(songs, "user_id", "left").join(stored, "user_id", "left").fillna(0)
    due = (F.col("n_batches") == 0) | (F.floor(F.col("n_history") / 10) > F.col("n_batches") - 1)
    return joined.withColumn("is_due", due.cast("int"))


def language_rerank(recs: DataFrame, users: DataFrame, catalogue: DataFrame, top_n: int = PAGE) -> DataFrame:
    """Candidates outside the preferred languages are pushed down, then cut to a page.

    Scores of users with preferences are lifted so that the lowest is at least
    one before the penalty applies.
    """
    known = recs.join(catalogue.select("item_id", "language"), "item_id").join(
        users.select("user_id", languages.accepted_codes(F.col("preferred_languages")).alias("codes")), "user_id"
    )
    # A user's candidates are a bounded list (one page request), so this window is small.
    lift = F.greatest(F.lit(0.0), F.lit(1.0) - F.min("score").over(Window.partitionBy("user_id")))
    raised = F.col("score") + lift
    weighted = F.when(F.array_contains("codes", F.col("language")), raised).otherwise(raised * PENALTY)
    adjusted = F.when(F.size("codes") > 0, weighted).otherwise(F.col("score"))
    return rank_users(known.select("user_id", "item_id", F.round(adjusted, 6).alias("score")), top_n)


def affinity_rerank(recs: DataFrame, affinities: DataFrame, top_n: int = PAGE) -> DataFrame:
    """Scores times one plus the affinity; strongly disliked songs are dropped."""
    known = affinities.select("user_id", "item_id", F.col("score").alias("aff"))
    aff = F.coalesce("aff", F.lit(0.0))
    joined = recs.join(known, ["user_id", "item_id"], "left").filter(aff >= affinity.FILTER_BELOW)
    return rank_users(joined.select("user_id", "item_id", F.round(F.col("score") * (aff + 1), 6).alias("score")), top_n)
