"""One positive among items drawn without repetition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import hashing
from ..functions.vectors import dot
from ..session import materialize
from .ids import dense_ids


#: Items whose vectors a task holds while it scores candidate lists, lists that it scores, and draws made at a time.
ITEMS_PER_BLOCK, LISTS_PER_TASK, DRAWS_AT_ONCE = 16_384, 50_000, 1_000_000


def _draw(order: hashing.Permutation, wanted: int, per_block: int, at_once: int):
    """Lines (user_id, factors, shifts, draws, held slots) to one list of drawn slots per user and block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, at_once), "right")
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                if lo < hi:
                    yield lists(batch.slice(lo, hi - lo))

    def lists(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws = batch.column(3).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(draws)), draws)
        x = np.arange(len(owner)) - np.repeat(np.cumsum(draws) - draws, draws)
        slot = order.values(x, *(batch.column(i).flatten().to_numpy().reshape(len(draws), -1)[owner] for i in (1, 2)))
        own = batch.column(4)
        width = np.diff(own.offsets.to_numpy())
        held = np.sort(np.repeat(np.arange(len(draws)), width) * order.n + own.flatten().to_numpy())
        pair = owner * order.n + slot
        free = slot < order.n
        if len(held):
            free &= held[np.minimum(np.searchsorted(held, pair), len(held) - 1)] != pair
        owner, slot = owner[free], slot[free]
        n = np.bincount(owner, minlength=len(draws))
        first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) < wanted
        owner, slot = owner[first], slot[first]
        block = slot // per_block
        by = np.lexsort((block, owner))
        owner, block, slot = owner[by], block[by], slot[by]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))[: len(owner)])
        slots = pa.ListArray.from_arrays(pa.array(np.append(new, len(owner)), pa.int32()), pa.array(slot, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[new])), pa.array(block[new], pa.int32()), slots], ["user_id", "block", "slots"])

    return run


def sampled_lists(users: DataFrame, truth: DataFrame, items: DataFrame, n_negatives: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(user_id, block, slots) of ``n_negatives`` distinct items per user that are not among the user's in ``truth``, a list per block of items, and (item_id, slot).

    A user draws by a permutation of the catalogue of their own; drawn
    positives are skipped and replaced by the next draws, so every user has
    exactly ``n_negatives``, or all other items where there are fewer. A task
    draws for its users, whose draws are never rows.
    """
    slots = materialize(dense_ids(items, "item_id", "slot"), "item-slots")
    order = hashing.Permutation(slots.count())
    asked = users.select("user_id").distinct()
    held = truth.select("user_id", "item_id").distinct().join(asked, "user_id", "left_semi").join(slots, "item_id")
    held = held.groupBy("user_id").agg(F.collect_list("slot").alias("held"))
    own = F.coalesce("held", F.array().cast("array<int>"))
    draws = F.least(F.lit(order.size), F.lit(n_negatives + order.size - order.n) + F.size(own)).cast("bigint")
    keys = order.keys(F.col("user_id"), seed)
    keyed = asked.join(held, "user_id", "left").select("user_id", keys.alias("keys"), draws.alias("draws"), own.alias("held"))
    lines = keyed.select("user_id", F.transform("keys", lambda x: x["c"]).alias("c"), F.transform("keys", lambda x: x["k"]).alias("k"), "draws", "held")
    kind = users.schema["user_id"].dataType.simpleString()
    return lines.mapInArrow(_draw(order, n_negatives, ITEMS_PER_BLOCK, DRAWS_AT_ONCE), f"user_id {kind}, block int, slots array<int>"), slots


def sampled_negatives(users: DataFrame, truth: DataFrame, items: DataFrame, n_negatives: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(user_id, slot) of the drawn items of ``sampled_lists``, and (item_id, slot)."""
    lists, slots = sampled_lists(users, truth, items, n_negatives, seed)
    return lists.select("user_id", F.explode("slots").alias("slot")), slots


def _score_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate list, how many candidates score above the user's positive; a block of items comes before its lists.

    Scores are compared in whole millionths.
    """
    held = matrix = None
    for batch in batches:
        slots, vectors = batch.column(0), batch.column(1)
        lists = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~lists)
        bounds = [0, *[int(i) for i in starts], batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            if not lists[lo]:
                held = slots[lo].values.to_numpy(zero_copy_only=False)
                matrix = vectors[lo].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
                by_slot = np.argsort(held)
                held, matrix = held[by_slot], matrix[by_slot]
                lo += 1
            if lo == hi:
                continue
            some, own = slots.slice(lo, hi - lo), vectors.slice(lo, hi - lo)
            width = np.diff(some.offsets.to_numpy())
            users = own.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            candidates = np.searchsorted(held, some.flatten().to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(hi - lo), width)
            positive = batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            better = np.zeros(hi - lo, np.int64)
            for a in range(0, len(owner), 100_000):
                part = slice(a, a + 100_000)
                score = np.einsum("ij,ij->i", users[owner[part]], matrix[candidates[part]])
                above = np.floor(score * 1e6 + 0.5) > positive[owner[part]]
                better += np.bincount(owner[part], above, minlength=hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), pa.array(better), pa.array(width.astype(np.int64))], ["user_id", "better", "listed"])


def candidate_ranks(lists: DataFrame, slots: DataFrame, positives: DataFrame, item_vectors: DataFrame, user_vectors: DataFrame) -> DataFrame:
    """(user_id, rank, listed): the rank of each user's positive (user_id, item_id) among the candidates (user_id, slot) or (user_id, block, slots).

    Item vectors are packed into blocks; a user's candidates become one list
    per block, which travels with the user's vector to the block, so no drawn
    row carries a vector.
    """
    n_lists = user_vectors.count()
    shares = max(1, math.ceil(n_lists / LISTS_PER_TASK))
    block = F.floor(F.col("slot") / ITEMS_PER_BLOCK).cast("int")
    named = item_vectors.select("item_id", F.col("embedding").cast("array<double>").alias("vec"))
    packed = slots.join(named, "item_id").groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "vec"))).alias("rows"))
    items = packed.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.transform("rows", lambda r: r["slot"]).alias("slots"),
        F.flatten(F.transform("rows", lambda r: r["vec"])).alias("vec"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("double").alias("positive"),
    )
    users = user_vectors.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("embedding").cast("array<double>").alias("u"))
    own = positives.join(named, "item_id").join(users, "user_id").select(
        "user_id", "u", F.round(F.round(dot(F.col("u"), F.col("vec")), 6) * 1_000_000).alias("positive")
    )
    own = materialize(own, "positives")
    listed = lists
    if "slots" not in lists.columns:
        listed = lists.groupBy("user_id", block.alias("block")).agg(F.collect_list(F.col("slot").cast("int")).alias("slots"))
    asked = listed.join(own, "user_id").select(
        "block", F.pmod(F.xxhash64("user_id"), F.lit(shares)).cast("int").alias("share"), "slots", F.col("u").alias("vec"), "user_id", "positive"
    )
    parts = max(asked.sparkSession.sparkContext.defaultParallelism, shares)
    dealt = items.unionByName(asked).repartition(parts, "block", "share").sortWithinPartitions("block", "share", F.col("user_id").asc_nulls_first())
    partial = dealt.select("slots", "vec", "user_id", "positive").mapInArrow(_score_lists, "user_id bigint, better bigint, listed bigint")
    sums = partial.groupBy("user_id").agg(F.sum("better").alias("better"), F.sum("listed").alias("listed"))
    return own.select("user_id").join(sums, "user_id", "left").select(
        "user_id", (F.coalesce("better", F.lit(0)) + 1).alias("rank"), F.coalesce("listed", F.lit(0).cast("bigint")).alias("listed")
    )
