"""Ranking metrics, parameter grids and metric reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric
from ..session import materialize
from .lists import RANKED, cell_ranks, empty
from .negatives import candidate_ranks, sampled_lists

KS = (10, 20)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_gain(n: str, k: int) -> Column:
    """Best possible gain of ``n`` relevant items within ``k`` places."""
    return F.expr(f"aggregate(sequence(1, least({n}, {k})), 0D, (acc, r) -> acc + 1.0D / log2(r + 1))")


def loo_metrics(test: DataFrame, recs: DataFrame, known: DataFrame, ks: Sequence[int] = KS, model: str = "ItemKNN") -> DataFrame:
    """(model, k, recall, precision, ndcg, users_evaluated) of a leave-one-out test.

    Users whose test item is not in ``known`` are skipped; users without
    recommendations count as misses.
    """
    usable = test.join(known.select("item_id").distinct(), "item_id", "left_semi")
    hit = usable.join(recs.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    sums = [F.count(F.lit(1)).alias("users_evaluated")]
    for k in ks:
        inside = F.col("rank") <= k
        sums.append(F.count_if(inside).alias(f"hits_{k}"))
        sums.append(F.coalesce(F.sum(F.when(inside, _gain(F.col("rank").cast("double")))), F.lit(0.0)).alias(f"gain_{k}"))
    wide = hit.agg(*sums)
    per_k = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"gain_{k}").alias("gain")) for k in ks])
    )
    long = wide.select("users_evaluated", per_k.alias("m")).select("users_evaluated", "m.*")
    return _ratios(long, model)


def _ratios(long: DataFrame, model: str) -> DataFrame:
    n = F.nullif(F.col("users_evaluated"), F.lit(0))
    return long.select(
        F.lit(model).alias("model"),
        F.col("k").cast("int").alias("k"),
        F.round(F.coalesce(F.col("hits") / n, F.lit(0.0)), 5).alias("recall"),
        F.round(F.coalesce(F.col("hits") / (n * F.col("k")), F.lit(0.0)), 5).alias("precision"),
        F.round(F.coalesce(F.col("gain") / n, F.lit(0.0)), 5).alias("ndcg"),
        "users_evaluated",
    )


def multi_truth_metrics(
    recs: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = KS,
    model: str = "model",
    notes: str = "",
    users: DataFrame | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """(model, k, recall, precision, ndcg, users_evaluated, notes) with several relevant items per user.

    Averages over users that have a prediction row: those in ``users`` when it
    is given (an empty list counts as zero), else those in ``recs``. Where
    ``recs`` holds few items for all users, ``listed`` (item_id) names them:
    only the truths among them are written and met.
    """
    pairs = truth.select("user_id", "item_id").distinct()
    n_truth = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    predicted = (recs if users is None else users).select("user_id").distinct()
    aimed = pairs
    if listed is not None:
        aimed = materialize(truth.select("user_id", "item_id").join(listed.select("item_id"), "item_id", "left_semi").distinct(), "listed-truths")
    hits = recs.select("user_id", "item_id", "rank").join(aimed, ["user_id", "item_id"])
    per_user_sums = []
    for k in ks:
        inside = F.col("rank") <= k
        per_user_sums += [
            F.count_if(inside).alias(f"hits_{k}"),
            F.sum(F.when(inside, _gain(F.col("rank").cast("double"))).otherwise(0.0)).alias(f"gain_{k}"),
        ]
    per_user = (
        n_truth.join(predicted, "user_id", "left_semi").join(hits.groupBy("user_id").agg(*per_user_sums), "user_id", "left").fillna(0)
    )
    totals = [F.count(F.lit(1)).alias("users_evaluated")]
    for k in ks:
        totals += [
            F.avg(F.col(f"hits_{k}") / F.col("n_truth")).alias(f"recall_{k}"),
            F.avg(F.col(f"hits_{k}") / F.lit(k)).alias(f"precision_{k}"),
            F.avg(F.col(f"gain_{k}") / ideal_gain("n_truth", k)).alias(f"ndcg_{k}"),
        ]
    wide = per_user.agg(*totals)
    row = lambda k: F.struct(
        F.lit(k).alias("k"), *[F.round(F.coalesce(f"{m}_{k}", F.lit(0.0)), 5).alias(m) for m in ("recall", "precision", "ndcg")]
    )
    return wide.select("users_evaluated", F.explode(F.array(*[row(k) for k in ks])).alias("m")).select(
        F.lit(model).alias("model"), "m.k", "m.recall", "m.precision", "m.ndcg", "users_evaluated", F.lit(notes).alias("notes")
    )


# --- popularity -------------------------------------------------------------------


def popular(pos_rows: DataFrame, k: int) -> DataFrame:
    """(item_id, n, rank): the ``k`` items with most positive rows."""
    top = pos_rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "item_id")))


def popularity_recs(users: DataFrame, pos_rows: DataFrame, k: int) -> DataFrame:
    """The same ``k`` items for every user."""
    return repeated(users, popular(pos_rows, k))


def repeated(users: DataFrame, top: DataFrame) -> DataFrame:
    """The rows of ``popular`` for every user: one array, repeated by an explode."""
    listed = top.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "n")))).scalar()
    return users.select("user_id", F.explode(listed).alias("r")).select("user_id", "r.item_id", F.col("r.n").alias("score"), "r.rank")


def hit_rate(test: DataFrame, items: DataFrame) -> DataFrame:
    """Share of test rows whose item is among ``items``."""
    flagged = test.join(items.select("item_id", F.lit(1).alias("hit")), "item_id", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("hit").isNotNull()).alias("n_hit")
    ).withColumn("recall", F.round(F.col("n_hit") / F.col("n_test"), 5))


# --- ItemKNN grid -------------------------------------------------------------------

GRID_K = (5, 10, 20, 50, 100)
GRID_THRESHOLD = (0.0, 0.05, 0.1, 0.2)
GRID_MODE = ("baseline", "sim2", "normalize_seed", "pop_pow", "pop_log")
#: Seeds of a user beyond which they are summed by rows, and seeds with their neighbours that a task gets on average.
WIDE_SEEDS, LISTS_PER_TASK = 20_000, 30_000


def _ranks_by_rows(seeds: DataFrame, adds: DataFrame, cells: list[tuple[int, float]], modes: Sequence[str], alpha: float) -> DataFrame:
    """(cell, agg, rank) by sums over rows, for users of any number of seeds (user_id, item_id, t_item)."""
    adds = adds.withColumn("sim", F.col("add") / F.lit(1e9))
    adds = adds.withColumn("add2", numeric.billionths(F.col("sim") * F.col("sim")))
    sums = []
    for i, (k, t) in enumerate(cells):
        used = (F.col("rank") <= k) & (F.col("sim") > t)
        sums += [F.sum(F.when(used, F.col("add"))).alias(f"s{i}"), F.sum(F.when(used, F.col("add2"))).alias(f"q{i}")]

    def by_cell(wide: DataFrame, keep: list[str]) -> DataFrame:
        """One row per cell that proposes the candidate."""
        each = F.array(*[F.struct(F.lit(i).alias("cell"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i in range(len(cells))])
        return wide.select(*keep, "pop", F.explode(each).alias("c")).select(*keep, "pop", "c.*").filter("s is not null")

    pop = F.greatest(F.col("pop"), F.lit(1)).cast("double")
    score = {
        "baseline": numeric.score(F.col("s")),
        "sim2": numeric.score(F.col("q")),
        "normalize_seed": numeric.score(F.col("s"), F.col("n_seeds")),
        "pop_pow": numeric.score(F.col("s"), F.pow(pop, F.lit(alpha))),
        "pop_log": numeric.score(F.col("s"), F.pow(F.log1p(pop), F.lit(alpha))),
    }
    n_seeds = seeds.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    own = (
        seeds.join(adds.withColumnRenamed("neighbor_id", "t_item"), ["item_id", "t_item"])
        .groupBy("user_id", "t_item", "pop")
        .agg(*sums)
        .join(n_seeds, "user_id")
    )
    target = by_cell(own, ["user_id", "t_item", "n_seeds"]).select(
        "user_id", "cell", "t_item", "n_seeds", *[score[m].alias(f"t_{m}") for m in modes]
    )
    cands = (
        seeds.select("user_id", "item_id")
        .join(own.select("user_id"), "user_id", "left_semi")
        .join(adds, "item_id")
        .groupBy("user_id", F.col("neighbor_id").alias("cand"), "pop")
        .agg(*sums)
        .withColumnRenamed("cand", "item_id")
        .join(seeds.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    )
    met = by_cell(cands, ["user_id", "item_id"]).join(target, ["user_id", "cell"])
    ahead = [
        F.count_if(
            (score[m] > F.col(f"t_{m}")) | ((score[m] == F.col(f"t_{m}")) & (F.col("item_id") < F.col("t_item")))
        ).alias(m)
        for m in modes
    ]
    ranks = met.groupBy("user_id", "cell").agg(*ahead)
    return ranks.select("cell", F.explode(F.array(*[F.struct(F.lit(m).alias("agg"), (F.col(m) + 1).alias("rank")) for m in modes])).alias("m")).select(
        "cell", "m.*"
    )


def knn_grid(
    test: DataFrame,
    seeds: DataFrame,
    neighbor_lists: DataFrame,
    item_ks: Sequence[int] = GRID_K,
    thresholds: Sequence[float] = GRID_THRESHOLD,
    modes: Sequence[str] = GRID_MODE,
    alpha: float = 0.5,
    reco_n: int = 20,
    ks: Sequence[int] = KS,
    wide_seeds: int = WIDE_SEEDS,
) -> DataFrame:
    """One row per (mode, item_k, threshold) with leave-one-out metrics.

    One pass for all configurations. A candidate's scores under every (item_k,
    threshold) cell are conditional sums; a configuration's rank of the
    held-out item is one plus the number of candidates that beat it. No list is
    built or sorted per configuration. Users whose held-out item no neighbour
    list of theirs proposes are dropped first; a seed's neighbours travel as
    one list to the tasks of the others. Users of more than ``wide_seeds``
    seeds are summed by rows. ``neighbor_lists`` are those of ``itemknn``.
    """
    cells = [(k, t) for k in item_ks for t in thresholds]
    spark = seeds.sparkSession
    known = seeds.select("item_id").distinct()
    tested = test.join(known, "item_id", "left_semi").select("user_id", F.col("item_id").alias("t_item"))
    first = lambda c: F.slice(c, 1, max(item_ks))
    adds = F.transform(first("sims"), lambda x: numeric.billionths(x).cast("int"))
    names = ["ids", "adds", "pops"]
    packed = materialize(neighbor_lists.select("item_id", first("ids").alias("ids"), adds.alias("adds"), first("ns").alias("pops")), "neighbour-lists")
    own = seeds.select("user_id", "item_id").join(tested, "user_id")
    proposed = own.join(packed.select("item_id", "ids"), "item_id").filter(F.exists("ids", lambda x: x == F.col("t_item")))
    own = materialize(own.join(proposed.select("user_id").distinct(), "user_id", "left_semi"), "grid-seeds")
    widths = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    facts = widths.agg(F.count_if(F.col("n") > wide_seeds).alias("wide"), F.sum(F.when(F.col("n") <= wide_seeds, F.col("n"))).alias("rows")).first()
    asked = own
    if facts["wide"]:
        users = materialize(widths.filter(F.col("n") > wide_seeds).select("user_id"), "wide-users")
        asked = own.join(users, "user_id", "left_anti")
    rows = asked.join(packed, "item_id", "left").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("seed"), F.col("t_item").cast("bigint").alias("t_item"), *[empty(c) for c in names]
    )
    parts = max(spark.sparkContext.defaultParallelism, math.ceil((facts["rows"] or 0) / LISTS_PER_TASK))
    dealt = rows.repartition(parts, "user_id").sortWithinPartitions("user_id")
    ranked = dealt.mapInArrow(cell_ranks(cells, list(modes), alpha, min(max(ks), reco_n)), RANKED)
    if facts["wide"]:
        unpacked = packed.select("item_id", F.posexplode(F.arrays_zip(*names)).alias("place", "a")).select(
            "item_id", F.col("a.ids").cast("bigint").alias("neighbor_id"), F.col("a.adds").cast("bigint").alias("add"), F.col("a.pops").alias("pop"), (F.col("place") + 1).alias("rank")
        )
        ranked = ranked.unionByName(_ranks_by_rows(own.join(users, "user_id", "left_semi"), unpacked, cells, modes, alpha))
    totals = []
    for q in ks:
        inside = F.col("rank") <= min(q, reco_n)
        totals += [
            F.count_if(inside).alias(f"h{q}"),
            F.sum(F.when(inside, _gain(F.col("rank").cast("double"))).otherwise(0.0)).alias(f"g{q}"),
        ]
    found = ranked.groupBy("cell", "agg").agg(*totals)
    configs = [
        F.struct(F.lit(i).alias("cell"), F.lit(m).alias("agg"), F.lit(k).alias("item_k"), F.lit(t).alias("sim_threshold"))
        for m in modes
        for i, (k, t) in enumerate(cells)
    ]
    users = tested.agg(F.count(F.lit(1)).alias("users"))
    table = users.select("users", F.explode(F.array(*configs)).alias("c")).select("users", "c.*")
    out = []
    for q in ks:
        hits, gain = F.coalesce(f"h{q}", F.lit(0)), F.coalesce(f"g{q}", F.lit(0.0))
        out += [
            F.round(hits / F.col("users"), 5).alias(f"recall_{q}"),
            F.round(hits / (F.col("users") * q), 5).alias(f"precision_{q}"),
            F.round(gain / F.col("users"), 5).alias(f"ndcg_{q}"),
        ]
    return table.join(found, ["cell", "agg"], "left").select("agg", "item_k", "sim_threshold", "users", *out)


def best_per(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def grid_matrix(grid: DataFrame, item_ks: Sequence[int], value: str = "recall_10") -> DataFrame:
    """Mean of ``value`` by threshold (rows) and item_k (columns)."""
    return grid.groupBy("sim_threshold").pivot("item_k", list(item_ks)).agg(F.round(F.avg(value), 5))


# --- reports ---------------------------------------------------------------------


def latest(log: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key in the order of ``by``."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*by)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, "last.*")


def with_split(log: DataFrame) -> DataFrame:
    """The split name, taken from ``split=…`` in the notes."""
    return log.withColumn("split", F.regexp_extract("notes", r"split=([A-Za-z0-9_]+)", 1))


def melt(wide: DataFrame, ids: list[str], ks: Sequence[int] = KS, names: Sequence[str] = ("recall", "precision", "ndcg")) -> DataFrame:
    """``recall_10, …`` columns to one row per k."""
    row = lambda k: F.struct(F.lit(k).alias("k"), *[F.col(f"{m}_{k}").alias(m) for m in names])
    return wide.select(*ids, F.explode(F.array(*[row(k) for k in ks])).alias("m")).select(*ids, "m.*")


def combine(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, support, precision, recall, f1) of a 0/1 classifier's scores."""
    cells = scored.groupBy("label", (F.col("score") >= threshold).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    wide = cells.agg(
        *[
            F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("pred") == p), F.col("n"))), F.lit(0)).alias(f"n{a}{p}")
            for a in (0, 1)
            for p in (0, 1)
        ]
    )

    def row(label: int):
        tp, other = F.col(f"n{label}{label}"), 1 - label
        return F.struct(
            F.lit(label).alias("label"),
            tp.alias("tp"),
            (tp + F.col(f"n{label}{other}")).alias("support"),
            (tp + F.col(f"n{other}{label}")).alias("predicted"),
        )

    long = wide.select(F.explode(F.array(row(0), row(1))).alias("r")).select("r.*")
    precision = F.coalesce(F.col("tp") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(F.lit(2.0) * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    return long.select(
        "label", "support", F.round(precision, 5).alias("precision"), F.round(recall, 5).alias("recall"), F.round(f1, 5).alias("f1")
    )


def sampled_negative_metrics(
    test: DataFrame, truth: DataFrame, item_vectors: DataFrame, user_vectors: DataFrame, n_negatives: int, seed: int, ks: Sequence[int] = KS
) -> DataFrame:
    """One positive per user (``test``) ranked among ``n_negatives`` items that are none of the user's."""
    user_vectors = materialize(user_vectors, "user-vectors")
    scored = test.select("user_id", "item_id").join(item_vectors.select("item_id"), "item_id", "left_semi").join(user_vectors.select("user_id"), "user_id", "left_semi")
    scored = materialize(scored, "scored-positives")
    negatives, slots = sampled_lists(scored, truth, item_vectors.select("item_id"), n_negatives, seed)
    ranks = candidate_ranks(negatives, slots, scored, item_vectors, user_vectors)
    sums = [F.count(F.lit(1)).alias("users_evaluated")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.count_if(inside).alias(f"hits_{k}"),
            F.coalesce(F.sum(F.when(inside, _gain(F.col("rank").cast("double")))), F.lit(0.0)).alias(f"gain_{k}"),
        ]
    wide = ranks.agg(*sums)
    per_k = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"gain_{k}").alias("gain")) for k in ks])
    )
    return _ratios(wide.select("users_evaluated", per_k.alias("m")).select("users_evaluated", "m.*"), "sampled_negatives")
