"""Item-to-item neighbours by binary cosine, and recommendations from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric
from ..session import materialize
from .gram import BLOCK_ITEMS, co_occurrence
from .lists import SUMMED, add_up, best_met, empty, met_schema, narrow, whole_type

#: Items of a user beyond which the blocked product counts them, list elements that one item may meet in a task.
WIDE_ITEMS, PAIRS_PER_ITEM = 512, 8_000_000
#: Seeds of a user beyond which they are summed by rows.
WIDE_SEEDS = 20_000
#: List elements, and seeds with their neighbours, that a task gets on average.
PAIRS_PER_TASK, SEEDS_PER_TASK = 4_000_000, 100_000


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per item ``i`` from (i, neighbor_id, co, n_neighbor), with their rank.

    For one item the cosine orders neighbours as co^2 / n_neighbor does, and
    that ratio of whole numbers ties exactly when the cosines do.
    """
    strength = F.col("co") * F.col("co") / F.col("n_neighbor")
    order = Window.partitionBy("i").orderBy(F.desc("strength"), "neighbor_id")
    return pairs.withColumn("strength", strength).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _wide_pairs(pos: DataFrame, block_items: int) -> DataFrame:
    """(i, neighbor_id, co), both ways, from the blocked product."""
    half, items = co_occurrence(pos, block_items)
    sides = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = half.select(sides.alias("s"), "co").select("s.*", "co")
    named = lambda at, name: items.select(F.col("at").alias(at), F.col("item_id").alias(name))
    return both.join(named("x", "i"), "x").join(named("y", "neighbor_id"), "y").select("i", "neighbor_id", "co")


def neighbor_lists(
    pos: DataFrame, k: int, block_items: int = BLOCK_ITEMS, wide_items: int = WIDE_ITEMS, pairs_per_item: int = PAIRS_PER_ITEM, popularity: DataFrame | None = None
) -> DataFrame:
    """(item_id, n, ids, sims, ns): an item's count, its best ``k`` neighbours in order, their cosines and their counts.

    ``pos`` holds distinct (user_id, item_id), users and items of any width;
    ``popularity`` is its ``item_popularity``, if that is at hand.

    A user's items travel as one list to each of these items, whose task counts
    the lists and keeps the best ``k``: what moves grows with the lists, and
    co-occurring pairs never leave a task. Users of more than ``wide_items``
    items are counted by the blocked product instead. An item that one of them
    has, or that meets more than ``pairs_per_item`` list elements, gets its
    counts from both ways by a sum over pairs.
    """
    known = pos.select("user_id", "item_id").filter("user_id is not null and item_id is not null")
    counts = (item_popularity(pos) if popularity is None else popularity).select("item_id", F.col("pop").alias("n"))
    counts = materialize(counts.filter("item_id is not null"), "item-counts")
    widths = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("width"))
    facts = widths.agg(
        F.max("width").alias("widest"), F.sum(F.when(F.col("width") <= wide_items, F.col("width") * F.col("width"))).alias("pairs")
    ).first()
    ends = counts.agg(F.min("item_id"), F.max("item_id"), F.max("n")).first()
    lo, hi, most = (v or 0 for v in ends)
    ids_kind, ns_kind = whole_type(lo, hi), whole_type(0, most)
    wide = (facts["widest"] or 0) > wide_items
    listed = known
    if wide:
        users = materialize(widths.filter(F.col("width") > wide_items).select("user_id"), "wide-users")
        listed = known.join(users, "user_id", "left_anti")
    item = F.struct(F.col("item_id").cast(ids_kind).alias("item_id"), F.col("n").cast(ns_kind).alias("n"))
    lists = listed.join(counts, "item_id").groupBy("user_id").agg(F.collect_list(item).alias("l"))
    lists = materialize(lists.select(F.col("l.item_id").alias("ids"), F.col("l.n").alias("ns")), "item-lists")
    rows = lists.select(F.explode("ids").alias("i"), "ids", "ns").withColumn("i", F.col("i").cast("bigint"))
    heavy = None
    if most * min(facts["widest"] or 0, wide_items) > pairs_per_item:
        heavy = rows.groupBy("i").agg(F.sum(F.size("ids")).alias("met")).filter(F.col("met") > pairs_per_item).select("i")
    if wide:
        touched = known.join(users, "user_id", "left_semi").select(F.col("item_id").cast("bigint").alias("i")).distinct()
        heavy = touched if heavy is None else heavy.union(touched).distinct()
    light = rows
    if heavy is not None:
        heavy = materialize(heavy, "heavy-items")
        light = rows.join(heavy, "i", "left_anti")
    # A fixed count: tasks are even in pairs, which adaptive coalescing by bytes cannot see.
    parts = max(pos.sparkSession.sparkContext.defaultParallelism, math.ceil((facts["pairs"] or 0) / PAIRS_PER_TASK))
    schema = met_schema(ids_kind, ns_kind)
    met = light.repartition(parts, "i").sortWithinPartitions("i").mapInArrow(best_met(k, ids_kind, ns_kind), schema)
    if heavy is not None:
        summed = rows.join(heavy, "i", "left_semi").select("i", F.explode("ids").alias("neighbor_id")).filter("i <> neighbor_id")
        summed = summed.groupBy("i", F.col("neighbor_id").cast("bigint").alias("neighbor_id")).agg(F.count(F.lit(1)).alias("co"))
        if wide:
            both = summed.unionByName(_wide_pairs(known.join(users, "user_id", "left_semi"), block_items))
            summed = both.groupBy("i", "neighbor_id").agg(F.sum("co").alias("co"))
        other = counts.select(F.col("item_id").alias("neighbor_id"), F.col("n").alias("n_neighbor"))
        best = _best(summed.join(other, "neighbor_id"), k).groupBy("i").agg(
            F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "co", "n_neighbor"))).alias("l")
        )
        best = best.join(counts.select(F.col("item_id").alias("i"), "n"), "i")
        met = met.unionByName(best.select("i", "n", F.col("l.neighbor_id").alias("ids"), F.col("l.co").alias("cos"), F.col("l.n_neighbor").alias("ns")).to(met.schema))
    long = lambda x: x.cast("bigint")
    sims = F.zip_with("cos", "ns", lambda co, n: F.round(long(co) / F.sqrt(F.col("n") * long(n)), 6))
    return met.filter(F.size("ids") > 0).select(F.col("i").cast(pos.schema["item_id"].dataType).alias("item_id"), "n", "ids", sims.alias("sims"), "ns")


def neighbors(pos: DataFrame, k: int, *options, **named) -> DataFrame:
    """(item_id, neighbor_id, sim, rank): the rows of ``neighbor_lists``, which takes the options."""
    each = neighbor_lists(pos, k, *options, **named).select("item_id", F.posexplode(F.arrays_zip("ids", "sims")).alias("place", "x"))
    neighbor = F.col("x.ids").cast(pos.schema["item_id"].dataType)
    return each.select("item_id", neighbor.alias("neighbor_id"), F.col("x.sims").alias("sim"), (F.col("place") + 1).alias("rank"))


# --- recommendations ------------------------------------------------------------


def _mode(mode: str, alpha: float, pop_min: int) -> Column:
    """What one neighbour adds to the score."""
    pop = F.greatest(F.col("pop"), F.lit(pop_min)).cast("double")
    return {
        "baseline": F.col("sim"),
        "normalize_seed": F.col("sim"),
        "sim2": F.col("sim") * F.col("sim"),
        "pop_pow": F.col("sim") / F.pow(pop, F.lit(alpha)),
        "pop_penalty": F.col("sim") / F.pow(pop, F.lit(alpha)),
        "pop_log": F.col("sim") / F.pow(F.log1p(pop), F.lit(alpha)),
    }[mode]


def _by_rows(seeds: DataFrame, adds: DataFrame, hidden: DataFrame) -> DataFrame:
    """(user_id, item_id, total): sums of any number of rows, then without the hidden items.

    Summed before the hidden items are removed, so the join output shrinks
    map-side and the anti-join runs on the same keys.
    """
    scored = (
        seeds.select("user_id", "item_id")
        .join(adds, "item_id")
        .groupBy("user_id", F.col("neighbor_id").alias("cand"))
        .agg(F.sum("add").alias("total"))
        .withColumnRenamed("cand", "item_id")
    )
    return scored.join(hidden.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").filter("total > 0")


def _scores(
    top_n: int | None,
    seeds: DataFrame,
    neighbors_table: DataFrame,
    mode: str = "baseline",
    sim_threshold: float = 0.0,
    popularity: DataFrame | None = None,
    alpha: float = 0.5,
    pop_min: int = 1,
    seen: DataFrame | None = None,
    wide_seeds: int = WIDE_SEEDS,
) -> DataFrame:
    adds = neighbors_table.filter(F.col("sim") > sim_threshold)
    if mode.startswith("pop_"):
        # Divided once per neighbour row, not once per use.
        adds = adds.join(popularity.select(F.col("item_id").alias("neighbor_id"), "pop"), "neighbor_id")
    adds = adds.select("item_id", "neighbor_id", numeric.billionths(_mode(mode, alpha, pop_min)).alias("add"))
    per_seed = mode == "normalize_seed"
    unit = [F.col("n_seeds")] if per_seed else []

    def plain(seeds: DataFrame, adds: DataFrame) -> DataFrame:
        fresh = _by_rows(seeds, adds, seeds if seen is None else seen)
        if per_seed:
            fresh = fresh.join(seeds.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seeds")), "user_id")
        scored = fresh.select("user_id", "item_id", numeric.score(F.col("total"), *unit).alias("score"))
        return scored if top_n is None else rank_users(scored, top_n)

    if seen is not None:
        return plain(seeds, adds)
    widths = seeds.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    apart = F.col("user_id").isNull() | (F.col("n") > wide_seeds)
    facts = widths.agg(F.count_if(apart).alias("apart"), F.sum(F.when(~apart, F.col("n"))).alias("rows")).first()
    one = F.struct(F.col("neighbor_id").cast("bigint").alias("id"), "add")
    packed = adds.groupBy("item_id").agg(F.collect_list(one).alias("l")).select("item_id", F.col("l.id").alias("ids"), F.col("l.add").alias("adds"))
    packed = materialize(packed, "neighbour-lists")
    listed = seeds.filter("user_id is not null")
    if facts["apart"]:
        wide = materialize(widths.filter(apart).select("user_id"), "wide-users")
        listed = listed.join(wide, "user_id", "left_anti")
    met = listed.select("user_id", "item_id").join(narrow(packed, ["ids", "adds"]), "item_id", "left")
    rows = met.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("seed"), empty("ids"), empty("adds"))
    parts = max(seeds.sparkSession.sparkContext.defaultParallelism, math.ceil((facts["rows"] or 0) / SEEDS_PER_TASK))
    summed = rows.repartition(parts, "user_id").sortWithinPartitions("user_id").mapInArrow(add_up(top_n, per_seed), SUMMED)
    names = [F.col(c).cast(df.schema[f].dataType).alias(c) for c, df, f in (("user_id", seeds, "user_id"), ("item_id", neighbors_table, "neighbor_id"))]
    scored = summed.select(*names, numeric.score(F.col("total"), *unit).alias("score"), *(["rank"] if top_n is not None else []))
    if facts["apart"]:
        unpacked = packed.select("item_id", F.explode(F.arrays_zip("ids", "adds")).alias("a"))
        unpacked = unpacked.select("item_id", F.col("a.ids").cast(neighbors_table.schema["neighbor_id"].dataType).alias("neighbor_id"), F.col("a.adds").alias("add"))
        either = seeds.join(wide, seeds["user_id"].eqNullSafe(wide["user_id"]), "left_semi")
        scored = scored.unionByName(plain(either, unpacked))
    return scored


def scores(seeds: DataFrame, neighbors_table: DataFrame, *options, **named) -> DataFrame:
    """(user_id, item_id, score) of every unseen candidate, from distinct (user_id, item_id) seeds.

    The options: ``mode``, ``sim_threshold``, ``popularity`` (item_id, pop),
    ``alpha``, ``pop_min``, ``seen`` (instead of the seeds), ``wide_seeds``.

    A seed's neighbours travel as one list to the user's task, which adds them
    up and leaves out the seeds. Users of more than ``wide_seeds`` seeds, rows
    without user, and calls with ``seen`` are summed by plain aggregates.
    """
    return _scores(None, seeds, neighbors_table, *options, **named)


def recommend(seeds: DataFrame, neighbors_table: DataFrame, top_n: int = 20, *options, **named) -> DataFrame:
    """(user_id, item_id, score, rank): the best ``top_n`` of ``scores``, which takes the options; the rest never leaves the user's task."""
    return _scores(top_n, seeds, neighbors_table, *options, **named)


def rank_users(scored: DataFrame, top_n: int) -> DataFrame:
    """Best ``top_n`` per user; Spark trims each task's share before the shuffle."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def item_popularity(pos: DataFrame) -> DataFrame:
    return pos.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))


def in_catalogue(scored: DataFrame, catalogue: DataFrame, top_n: int) -> DataFrame:
    """Best ``top_n`` of the scored items that the catalogue has; filtered before the rank, so no page is short."""
    return rank_users(scored.join(catalogue.select("item_id"), "item_id", "left_semi"), top_n)


def skipped_seeds(seeds: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Seeds the neighbour table does not know."""
    return seeds.select("user_id", "item_id").distinct().join(vocabulary.select("item_id").distinct(), "item_id", "left_anti")


def demo_table(sample: DataFrame, seeds: DataFrame, recs: DataFrame, n_seeds: int = 20) -> DataFrame:
    """Sampled users with up to ``n_seeds`` seeds and their ranked recommendations as text."""
    order = Window.partitionBy("user_id").orderBy("item_id")
    chosen = seeds.join(sample, "user_id", "left_semi")
    first = chosen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n_seeds)
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("seed_items"))
    ranked = recs.join(sample, "user_id", "left_semi").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("recs")
    )
    return listed.join(ranked, "user_id", "left")
