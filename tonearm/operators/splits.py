"""Train/test splits.

Random choices are orders by a seeded hash of (user, item). Test rows are
picked by aggregates or group-limited ranks, and the rest comes from an
anti-join on (user, item), so a user with a third of all rows never lands in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import hashing


def labelled(interactions: DataFrame) -> DataFrame:
    """(user_id, item_id, target): one row per pair, positive when any of its rows is."""
    return interactions.groupBy("user_id", "item_id").agg(F.max("target").alias("target"))


def _with_hash(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("h", hashing.order_key(F.col("user_id"), F.col("item_id"), seed))


def leave_one_out(pos: DataFrame, min_pos: int = 2, seed: int = 42) -> DataFrame:
    """(user_id, item_id): one held-out positive per user with at least ``min_pos``."""
    last = F.max(F.struct("h", "item_id")).alias("last")
    picked = _with_hash(pos, seed).groupBy("user_id").agg(last, F.count(F.lit(1)).alias("n"))
    return picked.filter(F.col("n") >= min_pos).select("user_id", F.col("last.item_id").alias("item_id"))


def without(rows: DataFrame, test: DataFrame) -> DataFrame:
    return rows.join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def leave_one_out_rows(pairs: DataFrame, min_pos: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of labelled pairs: everything but the held-out positive, negatives included, is train."""
    test = leave_one_out(pairs.filter("target = 1"), min_pos, seed)
    users = test.select("user_id")
    return without(pairs.join(users, "user_id", "left_semi"), test), test


def first_positives(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id, target, place, n_pos): each user's first ``n`` positives in hash order, with their number in all."""
    pos = pairs.filter("target = 1")
    counts = pos.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pos"))
    order = Window.partitionBy("user_id").orderBy("h", "item_id")
    picked = _with_hash(pos, seed).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return picked.join(counts, "user_id").select("user_id", "item_id", "target", "place", "n_pos")


def placed_positives(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(user_id, item_id, place, n_pos): all positives with their place among ``first_positives``, null beyond them.

    One table from which the test pairs of every smaller seed split are read.
    """
    places = first.groupBy("user_id", "item_id").agg(F.min("place").alias("place"))
    users = first.filter("place = 1").select("user_id", "n_pos")
    pos = pairs.filter("target = 1").select("user_id", "item_id")
    return pos.join(places, ["user_id", "item_id"], "left").join(users, "user_id").select("user_id", "item_id", "place", "n_pos")


def seeds_and_test(first: DataFrame, placed: DataFrame, n_seed: int) -> tuple[DataFrame, DataFrame]:
    """(seeds, test pairs) of users with more than ``n_seed`` positives; ``first`` holds that many or more of each."""
    more = F.col("n_pos") > n_seed
    seeds = first.filter(more & (F.col("place") <= n_seed)).select("user_id", "item_id", "target")
    test = placed.filter(more & (F.col("place").isNull() | (F.col("place") > n_seed))).select("user_id", "item_id")
    return seeds, test


def seed_n(pairs: DataFrame, n_seed: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): ``n_seed`` positives and all negatives against the other positives.

    Covers users with more than ``n_seed`` positives.
    """
    first = first_positives(pairs, n_seed, seed)
    seeds, test = seeds_and_test(first, placed_positives(pairs, first), n_seed)
    negatives = pairs.filter("target = 0").join(seeds.select("user_id"), "user_id", "left_semi")
    return seeds.unionByName(negatives), test


def held_out_users(pairs: DataFrame, n_test_users: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole users held out; their positives count where the item is in train.

    Refuses to hold out every user with a positive.
    """
    users = pairs.filter("target = 1").select("user_id").distinct()
    if n_test_users > 0 and users.limit(n_test_users + 1).count() <= n_test_users:
        raise ValueError(f"{n_test_users} held-out users leave none to train on")
    chosen = (
        users.withColumn("h", hashing.order_key(F.col("user_id"), seed)).orderBy("h", "user_id").limit(n_test_users)
    ).select("user_id")
    train = pairs.join(chosen, "user_id", "left_anti")
    test = (
        pairs.filter("target = 1")
        .join(chosen, "user_id", "left_semi")
        .join(train.select("item_id").distinct(), "item_id", "left_semi")
    )
    return train, test.select("user_id", "item_id")


def train_validation(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Adds ``is_validation`` by hash, the same for every run."""
    return df.withColumn("is_validation", hashing.in_fraction(fraction, *[F.col(k) for k in keys], seed).cast("int"))


def first_seeds(pos: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` items per user in hash order (onboarding picks)."""
    order = Window.partitionBy("user_id").orderBy("h", "item_id")
    return (
        _with_hash(pos.select("user_id", "item_id"), seed)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= n)
        .select("user_id", "item_id")
    )

