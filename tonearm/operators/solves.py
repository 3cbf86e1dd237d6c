"""Sums of normal equations per owner (a user or an item), without a vector per row on the wire.

The owners of a side are dealt to blocks once, and a block's rows are written
together. In a pass over a side one task per block reads the block's rows and
its owners' present vectors, then the other side's written vectors from
beginning to end, and keeps one small sum per owner. No vector is shuffled:
what a pass writes are its results, so it grows with the owners, while the
rows move once, when they are dealt. What a task holds is bounded by
``SUMS_HELD`` and ``ROWS_HELD``; an owner of very many rows is dealt out to
several blocks, whose sums meet in one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, whole_batches

#: Bytes of sums and number of rows that a block holds, rows that are worth a block of their own, rows summed at a time.
SUMS_HELD, ROWS_HELD, ROWS_WORTH, STEP = 2**28, 8_000_000, 500_000, 2**12

#: What a line of a block is: a labelled row, an owner, a vector of the other side, a shared part by name.
ROW, OWNER, VECTOR, PART = range(4)
LINE = {
    "kind": "int", "block": "int", "owner": "bigint", "other": "bigint", "label": "double", "vec": "array<double>",
    "part": "array<double>", "tags": "array<string>", "name": "string",
}


def weights(z: np.ndarray) -> np.ndarray:
    """Curvature of the quadratic that bounds the logistic loss and touches it at ``z``."""
    size = np.maximum(np.abs(z), 1e-6)
    return np.tanh(size / 2) / (2 * size)


# --- blocks -----------------------------------------------------------------------


@dataclass
class Side:
    """Rows (block, owner, other, label) and owners (block, owner) of one side; block -1 holds owners that several blocks share."""

    blocks: int
    rows: DataFrame
    owners: DataFrame
    n_shared: int
    n_rows: dict[int, int]
    n_owners: dict[int, int]

    def of(self, table: DataFrame, block: int) -> DataFrame:
        """The lines of a block, with the owners it shares."""
        return table.filter(F.col("block").isin(block, -1) if self.n_shared else F.col("block") == block)

    def want(self) -> dict[int, int]:
        """Number of rows and owners that the task of each block meets first."""
        return {b: self.n_rows.get(b, 0) + self.n_owners.get(b, 0) + self.n_shared for b in range(self.blocks)}


def deal(rows: DataFrame, key: str, other: str, size: int, per_share: int, blocks: int | None = None) -> Side:
    """(user_id, item_id, label) rows without nulls, dealt to blocks of owners ``key``; vectors have ``size`` numbers."""
    counted = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), f"{key}-counts")
    facts = counted.agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("rows"), F.count_if(F.col("n") > per_share).alias("shared")).first()
    n = facts["rows"] or 0
    if blocks is None:
        held = SUMS_HELD // (8 * (size * (size + 1) // 2 + 3 * size))
        spread = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_WORTH))
        blocks = max(1, math.ceil(facts["owners"] / held), math.ceil(n / ROWS_HELD), spread)
    block = lambda *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    alone = block(key, F.lit(0))
    shared = F.col("n") > per_share
    owners = counted.select(F.when(shared, -1).otherwise(alone).alias("block"), F.col(key).alias("owner"))
    placed = rows.withColumn("block", alone)
    if facts["shared"]:
        shares = counted.filter(shared).select(key, F.ceil(F.col("n") / per_share).alias("_shares"))
        share = F.pmod(F.xxhash64(other), F.col("_shares"))
        placed = rows.join(shares, key, "left").withColumn("block", F.when(F.col("_shares").isNull(), alone).otherwise(block(key, share)))
    placed = placed.select("block", F.col(key).alias("owner"), F.col(other).alias("other"), "label")
    placed = materialize(placed.repartition(blocks, "block").sortWithinPartitions("block", "other"), f"{key}-rows", by="block")
    owners = materialize(owners.repartition(blocks, "block").sortWithinPartitions("block", "owner"), f"{key}-owners", by="block")
    number = lambda df: {r["block"]: r["count"] for r in df.groupBy("block").count().collect()}
    n_owners = number(owners)
    return Side(blocks, placed, owners, n_owners.pop(-1, 0), number(placed), n_owners)


def lines(df: DataFrame, kind: int, **columns: Column | str) -> DataFrame:
    """Lines of one kind. No literal tells one block from another, so that all blocks share their generated code."""
    given = {"kind": F.lit(kind), **columns}
    some = [F.col(c) if isinstance(c, str) else c for c in (given.get(name, F.lit(None)) for name in LINE)]
    return df.select(*[c.cast(kind).alias(name) for c, (name, kind) in zip(some, LINE.items())])


def by_block(spark: SparkSession, branches: list[list[DataFrame]], run: Callable, schema: str, name: str, by: str | None = "block") -> DataFrame:
    """The written table of ``run`` over the lines of each block, one task per block and no shuffle."""
    # Spark merges a union of single partitions into one partition; a first branch of two keeps the blocks apart.
    start = lines(spark.range(0, 2, 1, 2), -1)
    blocks = [reduce(DataFrame.unionByName, some).coalesce(1) for some in branches]
    with whole_batches(spark):
        return materialize(reduce(DataFrame.unionByName, blocks, start).mapInArrow(run, schema), name, by=by)


def side_lines(side: Side, own: DataFrame, fixed: DataFrame, **columns: str) -> list[list[DataFrame]]:
    """Per block its rows, its owners of ``own`` (block, owner, vec) with further ``columns``, and all vectors of ``fixed`` (owner, vec)."""
    whole = (F.col("block") >= 0).cast("double")
    vectors = lines(fixed, VECTOR, other="owner", vec="vec")
    return [
        [
            lines(side.rows.filter(F.col("block") == b), ROW, block="block", owner="owner", other="other", label="label"),
            lines(side.of(own, b), OWNER, block="block", owner="owner", label=whole, vec="vec", **columns),
            vectors,
        ]
        for b in range(side.blocks)
    ]


# --- in the task of a block -------------------------------------------------------


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(list(LINE).index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def by_kind(batches: Iterator[pa.RecordBatch], want: dict[int, int], *first: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(kind, block, lines), the ``want`` lines of the ``first`` kinds before all others, in whatever order a task reads its files.

    Others that come before the last of the first are held until then.
    """
    early, got, block = [], 0, -1
    for batch in batches:
        kinds = numbers(batch, "kind")
        for kind in np.unique(kinds[kinds >= 0]).tolist():
            some = batch.filter(pa.array(kinds == kind))
            if kind in first:
                got, block = got + some.num_rows, max(block, int(np.nanmax(numbers(some, "block"))))
                yield kind, block, some
            else:
                early.append((kind, some))
        if early and got == want.get(block):
            yield from ((kind, block, some) for kind, some in early)
            early = []
    yield from ((kind, block, some) for kind, some in early)


class Block:
    """Owners and rows of a block, which its tasks meet with the other side's vectors."""

    def __init__(self, heads: list[pa.RecordBatch], rows: list[pa.RecordBatch], biased: bool = True):
        ids = np.concatenate([numbers(h, "owner") for h in heads])
        order = np.argsort(ids, kind="stable")
        self.ids, self.biased = ids[order], biased
        self.theta = np.concatenate([matrix(h, "vec") for h in heads])[order]
        self.whole = np.concatenate([numbers(h, "label") for h in heads])[order] > 0
        self.order = order
        every = lambda name, kind: np.concatenate([numbers(r, name).astype(kind) for r in rows] or [np.zeros(0, kind)])
        self.other, self.label = every("other", np.int64), every("label", np.int8)
        owner = every("owner", np.int64)
        at = np.searchsorted(self.ids, owner)
        self.own = at.astype(np.int32)
        if np.any(self.other[1:] < self.other[:-1]):
            order = np.argsort(self.other, kind="stable")
            self.other, self.label, self.own = self.other[order], self.label[order], self.own[order]
        self.size = self.theta.shape[1] - (not biased)
        self.upper = np.triu_indices(self.size)
        self.n_left = len(self.upper[0])
        self.sums = np.zeros((len(self.ids), self.n_left + self.size))
        self.met = np.bincount(self.own, minlength=len(self.ids))

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Add the rows of some vectors of the other side to their owners' sums."""
        for own, f, z, label in self.rows(ids, vectors):
            order = np.argsort(own, kind="stable")
            own, f, z, label = own[order], np.ascontiguousarray(f[order].T), z[order], label[order]
            parts, at = np.empty((self.n_left + self.size, len(own))), 0
            weighted = f * weights(z)
            for i in range(self.size):
                np.multiply(f[i:], weighted[i], out=parts[at : at + self.size - i])
                at += self.size - i
            np.multiply(f, 0.5 * (1 + np.tanh(z / 2)) - label, out=parts[at:])
            parts = np.ascontiguousarray(parts.T)
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n = np.diff(np.append(start, len(own)))
            # The first rows of all owners at once, then the second ones; owners of many by themselves.
            for place in range(min(8, n.max(initial=0))):
                some = start[(n > place) & (n <= 8)] + place
                self.sums[own[some]] += parts[some]
            for lo, many in zip(start[n > 8], n[n > 8]):
                self.sums[own[lo]] += parts[lo : lo + many].sum(0)

    def rows(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(own, features, logit, label) of the rows of these vectors, some at a time."""
        lo = np.searchsorted(self.other, ids, "left")
        n = np.searchsorted(self.other, ids, "right") - lo
        which = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        row = np.arange(len(which)) + np.repeat(lo - (np.cumsum(n) - n), n)
        for at in range(0, len(which), STEP):
            some, own = row[at : at + STEP], self.own[row[at : at + STEP]]
            f = vectors[which[at : at + STEP]]
            offset = f[:, -1].copy()
            f[:, -1] = 1.0
            f = f[:, : self.size]
            z = np.einsum("ij,ij->i", f, self.theta[own, : self.size]) + offset
            yield own, f, z, self.label[some]

    def equations(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, left, slope) of owners that met rows, some thousand at a time; left is the weighted product of features."""
        found = np.flatnonzero(self.met)
        for at in range(0, len(found), 4096):
            some = found[at : at + 4096]
            left = np.zeros((len(some), self.size, self.size))
            left[:, self.upper[0], self.upper[1]] = left[:, self.upper[1], self.upper[0]] = self.sums[some, : self.n_left]
            yield some, left, self.sums[some, self.n_left :]


def met_block(
    batches: Iterator[pa.RecordBatch], want: dict[int, int], biased: bool = True, visit: Callable[[Block, np.ndarray, np.ndarray], None] | None = None
) -> tuple[Block | None, int, list[pa.RecordBatch]]:
    """(block, its number, its owners' lines) after ``visit`` met all vectors of the other side, which adds up sums unless it is given."""
    heads, rows, block, number = [], [], None, -1
    for kind, number, some in by_kind(batches, want, ROW, OWNER):
        if kind == OWNER:
            heads.append(some)
        elif kind == ROW:
            rows.append(some)
        elif heads:
            if block is None:
                block = Block(heads, rows, biased)
                rows = []
            (visit or Block.meet)(block, numbers(some, "other"), matrix(some, "vec"))
    return block, number, heads


def solved(left: np.ndarray, right: np.ndarray, reg: float) -> np.ndarray:
    return np.linalg.solve(left + reg * np.eye(left.shape[-1]), right[..., None])[..., 0]


def nested(values: np.ndarray) -> pa.Array:
    """A list column of equally long rows."""
    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
