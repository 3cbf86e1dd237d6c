"""Recommendations from item and tag vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors
from ..session import materialize, side_by_side
from . import affinity
from .blocks import topk_products

BIAS_BETA = 0.3
ALPHA = 0.5
WARM_MIN_ITEMS = 10
#: Items whose vectors a task sums up.
ITEMS_PER_TASK = 50_000


def dims_of(table: DataFrame, column: str = "embedding") -> int:
    """Vector length of a model table, read from one row."""
    return table.select(F.size(column)).first()[0]


def warm_vectors(history: DataFrame, affinities: DataFrame | None, items: DataFrame, dims: int | None = None) -> DataFrame:
    """(user_id, embedding): mean of the history's item vectors, weighted by affinity.

    Items below the affinity limit are left out; a missing affinity counts as
    the default; a user whose weights are all zero, and everyone when there is
    no affinity table, gets the plain mean.
    """
    dims = dims or dims_of(items)
    rows = history.select("user_id", "item_id").distinct()
    vectors_of = items.select("item_id", "embedding")
    plain = [F.count(F.lit(1)).alias("n"), vectors.sum_of("embedding", dims).alias("plain_sum")]
    plain_mean = vectors.scale(F.col("plain_sum"), F.lit(1.0) / F.col("n"))
    if affinities is None:
        summed = rows.join(vectors_of, "item_id").groupBy("user_id").agg(*plain)
        return summed.select("user_id", plain_mean.alias("embedding"))
    known = affinities.select("user_id", "item_id", F.col("score").alias("aff"))
    aff = F.coalesce("aff", F.lit(affinity.DEFAULT_AFFINITY))
    weighted = (
        rows.join(known, ["user_id", "item_id"], "left")
        .filter(aff >= affinity.FILTER_BELOW)
        .select("user_id", "item_id", F.greatest(aff + 0.5, F.lit(0.0)).alias("w"))
    )
    summed = (
        weighted.join(vectors_of, "item_id")
        .groupBy("user_id")
        .agg(F.sum("w").alias("total"), vectors.sum_of("embedding", dims, "w").alias("weighted_sum"), *plain)
    )
    mean = F.when(F.col("total") > 0, vectors.scale(F.col("weighted_sum"), F.lit(1.0) / F.col("total"))).otherwise(plain_mean)
    return summed.select("user_id", mean.alias("embedding"))


def tag_vectors(tagged: DataFrame, tags: DataFrame, dims: int) -> DataFrame:
    """(user_id, embedding, bias): mean over the user's tags that the model knows."""
    known = tagged.select("user_id", F.explode("tags").alias("tag")).join(tags, "tag")
    inv = F.lit(1.0) / F.col("n")
    return (
        known.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), vectors.sum_of("embedding", dims).alias("s"), F.sum("bias").alias("b"))
        .select("user_id", vectors.scale(F.col("s"), inv).alias("embedding"), (F.col("b") * inv).alias("bias"))
    )


def cold_vectors(
    tagged: DataFrame, tags: DataFrame, picks: DataFrame, items: DataFrame, alpha: float = ALPHA, dims: int | None = None
) -> DataFrame:
    """(user_id, embedding, bias): tag mean and onboarding mean, mixed; either alone when the other is missing."""
    dims = dims or dims_of(items)
    features = tag_vectors(tagged, tags, dims).select("user_id", F.col("embedding").alias("f"), "bias")
    taste = warm_vectors(picks, None, items, dims).select("user_id", F.col("embedding").alias("t"))
    mixed = vectors.add(vectors.scale(F.col("f"), F.lit(alpha)), vectors.scale(F.col("t"), F.lit(1 - alpha)))
    return features.join(taste, "user_id", "full_outer").select(
        "user_id", F.coalesce(mixed, "t", "f").alias("embedding"), F.coalesce("bias", F.lit(0.0)).alias("bias")
    )


def hybrid_vectors(history: DataFrame, tagged: DataFrame, tags: DataFrame, items: DataFrame, dims: int | None = None) -> DataFrame:
    """(user_id, embedding) of known users: the mean of their items plus the mean of their tags; the former alone without a known tag."""
    dims = dims or dims_of(items)
    own = warm_vectors(history, None, items, dims).select("user_id", F.col("embedding").alias("own"))
    features = tag_vectors(tagged, tags, dims).select("user_id", F.col("embedding").alias("f"))
    return own.join(features, "user_id", "left").select("user_id", F.coalesce(vectors.add(F.col("own"), F.col("f")), "own").alias("embedding"))


def full_item_vectors(items: DataFrame, tagged: DataFrame, tags: DataFrame, dims: int | None = None) -> DataFrame:
    """Item vectors plus the sum of their tags' vectors, biases likewise.

    A tagged row is small and its sums are not: items are dealt out by their
    number before tags get vectors, those without a vector are left out. Tags
    are written, so that the planner sees whether they fit a broadcast.
    """
    dims = dims or dims_of(items)
    tags = materialize(tags, "tag-vectors")
    tagged = tagged.join(items.select("item_id"), "item_id", "left_semi")
    parts = max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(items.count() / ITEMS_PER_TASK))
    known = tagged.repartition(parts, "item_id").select("item_id", F.explode("tags").alias("tag")).join(tags, "tag")
    sums = known.groupBy("item_id").agg(vectors.sum_of("embedding", dims).alias("s"), F.sum("bias").alias("b"))
    return items.join(sums, "item_id", "left").select(
        "item_id",
        F.coalesce(vectors.add(F.transform("embedding", lambda x: x.cast("double")), F.col("s")), F.transform("embedding", lambda x: x.cast("double"))).alias("embedding"),
        (F.col("bias") + F.coalesce("b", F.lit(0.0))).alias("bias"),
    )


def tag_weights(tagged: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(user_id, tag, weight): one over the number of the user's tags in the vocabulary."""
    known = tagged.select("user_id", F.explode("tags").alias("tag")).join(vocabulary.select("tag"), "tag")
    n = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "user_id").select("user_id", "tag", (F.lit(1.0) / F.col("n")).alias("weight"))


def score_topk(users: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None = None, beta: float = BIAS_BETA) -> DataFrame:
    """(user_id, item_id, score, rank): best items by inner product plus damped item bias.

    Excluded pairs are removed before ranking, so ``k`` items are returned
    whenever the catalogue has them.
    """
    found = topk_products(
        users.select(F.col("user_id").alias("id"), F.col("embedding").alias("vec")),
        items.select(F.col("item_id").alias("id"), F.col("embedding").alias("vec"), (F.col("bias") * beta).alias("weight")),
        k,
        skip=None if exclude is None else exclude.select(F.col("user_id").alias("id"), F.col("item_id").alias("match_id")),
    )
    return found.select(F.col("id").alias("user_id"), F.col("match_id").alias("item_id"), "score", "rank")


def score_topk_runs(runs: dict[str, tuple[DataFrame, DataFrame]], items: DataFrame, k: int, beta: float = BIAS_BETA) -> DataFrame:
    """(run, user_id, item_id, score, rank) for several sets of user vectors, each with its excluded pairs; two sets at a time are written."""
    one = lambda name, users, hidden: score_topk(users, items, k, hidden, beta).withColumn("run", F.lit(name))
    found = side_by_side(items.sparkSession, [lambda r=(name, *run): one(*r) for name, run in runs.items()], 2)
    return reduce(DataFrame.unionByName, found)


def warm_recs(history: DataFrame, affinities: DataFrame, items: DataFrame, exclude: DataFrame, top_n: int = 9) -> DataFrame:
    return score_topk(warm_vectors(history, affinities, items), items, top_n, exclude)


def cold_recs(
    tagged: DataFrame, tags: DataFrame, picks: DataFrame, items: DataFrame, exclude: DataFrame, top_n: int = 9
) -> DataFrame:
    """The user's own bias shifts all scores alike, so it is added after ranking."""
    users = materialize(cold_vectors(tagged, tags, picks, items), "user-vectors")
    recs = score_topk(users, items, top_n, exclude)
    shift = users.select("user_id", (F.col("bias") * BIAS_BETA).alias("shift"))
    return recs.join(shift, "user_id").withColumn("score", F.col("score") + F.col("shift")).drop("shift")


def exclusion(history: DataFrame, picks: DataFrame) -> DataFrame:
    """History and onboarding items of every user."""
    return history.select("user_id", "item_id").union(picks.select("user_id", "item_id")).distinct()
