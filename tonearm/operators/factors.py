"""Logistic factor models with user and item biases, fitted by alternating weighted ridge regressions.

A pair scores ``z = u . v + b_u + b_i`` and is liked with probability
``1 / (1 + exp(-z))``. With the other side fixed, an owner (a user or an item)
meets a logistic regression on its own rows. Its loss is bounded from above by
the quadratic that touches it at the present ``z``, of weight
``tanh(z / 2) / (2 z)``; the bound's minimum is one weighted ridge solve, so no
step raises the regularised loss and no step length is needed.

The sums of a solve are small (``rank + 1`` squared) and add up: an owner of
very many rows is dealt out to several blocks, whose sums meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot
from ..session import materialize
from .solves import Block, Side, by_block, deal, met_block, nested, side_lines, solved

#: Rows of one owner that a single block sums up.
ROWS_PER_SHARE = 50_000


@dataclass
class Factors:
    """(id, embedding, bias) of both sides."""

    users: DataFrame
    items: DataFrame


def _solve(want: dict[int, int], reg: float, biased: bool):
    """The lines of a block: a solve per owner of its own, the sums of owners that several blocks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, _ = met_block(batches, want, biased)
        for at, left, slope in block.equations() if block else ():
            right = np.einsum("nij,nj->ni", left, block.theta[at, : block.size]) - slope
            whole = block.whole[at]
            vec = solved(left[whole], right[whole], reg)
            vec = vec if biased else np.c_[vec, np.zeros(len(vec))]
            yield _out(np.full(len(vec), number), block.ids[at[whole]], nested(vec), pa.nulls(len(vec), pa.binary()))
            data = [a.tobytes() + b.tobytes() for a, b in zip(left[~whole], right[~whole])]
            yield _out(np.full(len(data), -1), block.ids[at[~whole]], pa.nulls(len(data), pa.list_(pa.float64())), pa.array(data, pa.binary()))

    return run


def _out(block: np.ndarray, owner: np.ndarray, vec: pa.Array, sums: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(owner, pa.int64()), vec, sums], ["block", "owner", "vec", "sums"])


def _meet(size: int, reg: float, biased: bool):
    """Sums of shares ordered by owner; one solve per owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, sums = None, np.zeros(0)
        out: list[tuple] = []

        def close():
            if owner is not None:
                vec = solved(sums[: size * size].reshape(size, size), sums[size * size :], reg)
                out.append((owner, vec if biased else np.append(vec, 0.0)))

        for batch in batches:
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != owner:
                    close()
                    owner, sums = who, np.zeros(size * size + size)
                sums += np.frombuffer(data)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["owner", "vec"])

    return run


def _start(ids: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """(owner, shares, vec): small values by hash of (id, place, seed), bias 0."""
    value = lambda d: (F.pmod(F.xxhash64(F.col(key), d, F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1) * (0.5 / rank**0.5)
    places = F.sequence(F.lit(0), F.lit(rank - 1))
    return ids.select(F.col(key).alias("owner"), "shares", F.concat(F.transform(places, value), F.array(F.lit(0.0))).alias("vec"))


def _half(side: Side, own: DataFrame, fixed: DataFrame, size: int, reg: float, biased: bool) -> DataFrame:
    """(block, owner, vec) of one side after a ridge solve against the other."""
    spark = own.sparkSession
    ddl = "block int, owner bigint, vec array<double>, sums binary"
    done = by_block(spark, side_lines(side, own, fixed), _solve(side.want(), reg, biased), ddl, "solved")
    alone = done.select("block", "owner", "vec")
    if not side.n_shared:
        return alone
    sums = done.filter("block = -1").select("owner", "sums").repartition("owner").sortWithinPartitions("owner")
    shared = materialize(sums.mapInArrow(_meet(size, reg, biased), "owner bigint, vec array<double>"), "shared-vectors")
    return alone.filter("block >= 0").unionByName(shared.select(F.lit(-1).alias("block"), "owner", "vec"))


def train_logistic(
    pairs: DataFrame, rank: int = 32, iterations: int = 10, reg: float = 1.0, biased: bool = True, seed: int = 42, per_share: int = ROWS_PER_SHARE,
    blocks: int | None = None,
) -> Factors:
    """Factors of (user_id, item_id, target) rows; ``target`` above 0 is a like.

    ``biased=False`` is the plain model: a logistic loss on the inner product
    alone. ``reg`` is the L2 penalty of vectors and biases. Rows without user,
    item or target are left out; equal rows count as often as they stand.
    Without rows both sides are empty.

    Rows move once a side, when its owners are dealt to ``blocks`` (a number
    that fits the data, if none is given). A half of an iteration shuffles
    nothing but small sums of owners of more than ``per_share`` rows. Every
    half is a written table, so a lost executor repeats its own tasks only.
    """
    key = lambda c: F.col(c).cast("bigint").alias(c)
    label = (F.col("target") > 0).cast("double").alias("label")
    rows = materialize(pairs.select(key("user_id"), key("item_id"), label).dropna(), "labelled-rows")
    size = rank + 1 if biased else rank
    users, items = (deal(rows, *keys, rank + 1, per_share, blocks) for keys in (("user_id", "item_id"), ("item_id", "user_id")))
    # Users start at zero, items at small values: the first solve is the users'.
    own = users.owners.withColumn("vec", F.array_repeat(F.lit(0.0), rank + 1))
    start = _start(items.owners.withColumnsRenamed({"owner": "item_id", "block": "shares"}), "item_id", rank, seed)
    fixed = materialize(start.withColumnRenamed("shares", "block"), "item-start", by="block")
    for _ in range(iterations):
        own = _half(users, own, fixed, size, reg, biased)
        fixed = _half(items, fixed, own, size, reg, biased)
    parts = [F.slice("vec", 1, rank).alias("embedding"), F.element_at("vec", -1).alias("bias")]
    return Factors(own.select(F.col("owner").alias("user_id"), *parts), fixed.select(F.col("owner").alias("item_id"), *parts))


def logits(pairs: DataFrame, model: Factors) -> DataFrame:
    """``pairs`` with their ``logit``; a user or an item the model has not seen adds nothing."""
    u = model.users.select("user_id", F.struct("embedding", "bias").alias("_u"))
    i = model.items.select("item_id", F.struct("embedding", "bias").alias("_i"))
    product = F.coalesce(dot(F.col("_u.embedding"), F.col("_i.embedding")), F.lit(0.0))
    z = product + F.coalesce("_u.bias", F.lit(0.0)) + F.coalesce("_i.bias", F.lit(0.0))
    return pairs.join(u, "user_id", "left").join(i, "item_id", "left").withColumn("logit", z).drop("_u", "_i")


def _loss(z: Column, label: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - label * z


_FIT = "n bigint, labelled bigint, loss double, likes double, right bigint"


def _fit(want: dict[int, int]):
    """The lines of a block: number of rows, sums of loss and likes, rows on the right side of one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(4)

        def visit(block: Block, ids: np.ndarray, vectors: np.ndarray) -> None:
            for _, _, z, label in block.rows(ids, vectors):
                loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - label * z
                found[:] += len(z), loss.sum(), label.sum(), ((z > 0) == (label > 0)).sum()

        met_block(batches, want, visit=visit)
        n, loss, likes, right = found.tolist()
        yield pa.RecordBatch.from_pylist([{"n": int(n), "labelled": int(n), "loss": loss, "likes": likes, "right": int(right)}])

    return run


def _fit_by_rows(pairs: DataFrame, model: Factors) -> DataFrame:
    """The same sums of rows of any kind, by joins."""
    label = (F.col("target") > 0).cast("double")
    return logits(pairs, model).agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"), F.sum(_loss(F.col("logit"), label)).alias("loss"), F.sum(label).alias("likes"),
        F.count_if((F.col("logit") > 0) == (label > 0)).alias("right"),
    )


def fit_report(pairs: DataFrame, model: Factors, per_share: int = ROWS_PER_SHARE, blocks: int | None = None) -> DataFrame:
    """One row over labelled pairs: rows, mean log loss, that of the constant share of likes, accuracy at one half.

    Rows are dealt to blocks of users as in training, so none moves with a
    vector; those without user, item or target are met by joins.
    """
    whole = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("target").isNotNull()
    key = lambda c: F.col(c).cast("bigint").alias(c)
    rank = max(side.agg(F.max(F.size("embedding"))).first()[0] or 0 for side in (model.users, model.items))
    rows = pairs.filter(whole).select(key("user_id"), key("item_id"), (F.col("target") > 0).cast("double").alias("label"))
    users = deal(rows, "user_id", "item_id", rank + 1, per_share, blocks)
    known = lambda side, key: side.select(F.col(key).alias("owner"), F.concat("embedding", F.array("bias")).alias("vec"))
    # An id the model has not seen adds nothing.
    vec = F.coalesce("vec", F.array_repeat(F.lit(0.0), rank + 1)).alias("vec")
    own = users.owners.join(known(model.users, "user_id"), "owner", "left").select("block", "owner", vec)
    own = materialize(own.repartition(users.blocks, "block").sortWithinPartitions("block"), "known-users", by="block")
    items = users.rows.select(F.col("other").alias("owner")).distinct()
    fixed = materialize(items.join(known(model.items, "item_id"), "owner", "left").select("owner", vec), "known-items")
    parts = by_block(pairs.sparkSession, side_lines(users, own, fixed), _fit(users.want()), _FIT, "fit", by=None)
    odd = pairs.filter(~whole)
    if not odd.isEmpty():
        parts = parts.unionByName(_fit_by_rows(odd, model))
    sums = parts.agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "loss", "likes", "right")])
    n, p = F.nullif(F.col("labelled"), F.lit(0)), F.col("_share")
    sums = sums.select(
        F.col("n").alias("n_rows"), (F.col("loss") / n).alias("log_loss"), (F.col("likes") / n).alias("_share"), (F.col("right") / n).alias("accuracy")
    )
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return sums.withColumn("constant_loss", -(part(p) + part(1 - p))).drop("_share")


def penalty(model: Factors, reg: float) -> float:
    """The L2 part of the loss that training lowers."""
    square = lambda side: side.agg(F.sum(dot(F.col("embedding"), F.col("embedding")) + F.col("bias") * F.col("bias"))).first()[0] or 0.0
    return reg / 2 * (square(model.users) + square(model.items))
