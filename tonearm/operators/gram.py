"""Co-occurrence of items as a blocked sparse Gram product.

Items are numbered by descending popularity and cut into blocks.  A user's
items become one short list per block; two lists of a user are a cell of that
pair of blocks.  Cells are dealt by pair of blocks (and by a hash of the user,
so that the popular blocks are not one task), counted cell by cell, and the
partial counts are added up.  No row and no array grows with the number of
users or with one user's number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .ids import running_sum

#: Items of a block; a cell holds two lists of at most so many.
BLOCK_ITEMS = 4096
#: Pairs that a task should count, and list rows of one block that meet in one task.
PAIRS_PER_TASK = 50_000_000
CELLS_PER_TASK = 200_000
#: Shares of pairs of blocks that a task gets on average; many are dealt more evenly than few.
SHARES_PER_TASK = 4
#: Lists of one user that a task pairs with all of the user's lists.
LISTS_PER_TASK = 64
#: Pairs that are unfolded at a time.
STEP = 2**21


class _Counter:
    """Counts of one pair of blocks, as an array once that takes less than a list of codes."""

    def __init__(self, size: int):
        self.size, self.codes, self.held = size, [], 0
        self.sums: np.ndarray | None = None

    def add_codes(self, codes: np.ndarray) -> None:
        if self.sums is not None:
            np.add.at(self.sums, codes, 1)
            return
        self.codes.append(codes)
        self.held += len(codes)
        if 8 * self.held > self.size * self.size:
            self._dense()

    def _dense(self) -> None:
        if self.sums is None:
            self.sums = np.zeros(self.size * self.size, np.int32)
            for codes in self.codes:
                np.add.at(self.sums, codes, 1)
            self.codes, self.held = [], 0

    def add_product(self, rows: np.ndarray, columns: np.ndarray, product: np.ndarray) -> None:
        self._dense()
        self.sums.reshape(self.size, self.size)[np.ix_(rows, columns)] += product

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        if self.sums is not None:
            codes = np.flatnonzero(self.sums)
            return codes, self.sums[codes]
        return np.unique(np.concatenate(self.codes), return_counts=True) if self.codes else (np.zeros(0, np.int64),) * 2


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _add_cells(counter: _Counter, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, diagonal: bool) -> None:
    """Count all pairs of each cell; where lists are long, as a product of 0/1 matrices."""
    rows, columns = np.unique(left), np.unique(right)
    pairs = int((n_left.astype(np.int64) * n_right).sum())
    # A multiplication is some hundred times cheaper than a pair of its own.
    if pairs * 200 > len(n_left) * len(rows) * len(columns):
        for lo in range(0, len(n_left), 1024):
            some = slice(lo, lo + 1024)
            a, b = n_left[some], n_right[some]
            sides = []
            for values, all_, n in ((left, n_left, a), (right, n_right, b)):
                first, names = int(all_[:lo].sum()), rows if values is left else columns
                matrix = np.zeros((len(n), len(names)), np.float32)
                matrix[np.repeat(np.arange(len(n)), n), np.searchsorted(names, values[first : first + n.sum()])] = 1
                sides.append(matrix)
            product = (sides[0].T @ sides[1]).astype(np.int32)
            if diagonal:
                product[rows[:, None] >= columns[None, :]] = 0
            counter.add_product(rows, columns, product)
        return
    width = np.repeat(n_right, n_left).astype(np.int64)  # partners of every left element
    begin = np.repeat(np.cumsum(n_right) - n_right, n_left)
    upto = np.cumsum(width)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP, side="right")))
        some = width[lo:hi]
        shift = np.repeat(begin[lo:hi] - (np.cumsum(some) - some), some)
        a, b = np.repeat(left[lo:hi], some), right[np.arange(some.sum()) + shift]
        if diagonal:
            keep = a < b
            a, b = a[keep], b[keep]
        counter.add_codes(a.astype(np.int64) * counter.size + b)
        lo = hi


def _count(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts (a, b, co) of the cells (ba, bb, la, lb), which come sorted by block pair."""
        pair, counter = None, None

        def flushed():
            codes, co = counter.counts()
            for lo in range(0, len(codes), 100_000):
                some = codes[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[0] * size + some // size), pa.array(pair[1] * size + some % size), pa.array(co[lo : lo + 100_000].astype(np.int64))],
                    ["a", "b", "co"],
                )

        for batch in batches:
            ba, bb = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ba)]):
                if pair != (int(ba[lo]), int(bb[lo])):
                    if counter:
                        yield from flushed()
                    pair, counter = (int(ba[lo]), int(bb[lo])), _Counter(size)
                left, right = (_lists(batch.column(i).slice(lo, hi - lo)) for i in (2, 3))
                _add_cells(counter, *left, *right, pair[0] == pair[1])
        if counter:
            yield from flushed()

    return count


def co_occurrence(pos: DataFrame, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(a, b, co) with a < b for all pairs of items that share a user, and (at, item_id, n), the items' numbers and counts.

    ``pos`` holds distinct (user_id, item_id).  Users may have any number of
    items, items any number of users.
    """
    spark = pos.sparkSession
    cores = spark.sparkContext.defaultParallelism
    counts = pos.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    items = running_sum(counts, [F.desc("n"), F.col("item_id")], "n", "_sum", "_rank")
    items = materialize(items.select((F.col("_rank") - 1).alias("at"), "item_id", "n"), "items")
    placed = pos.select("user_id", "item_id").join(items.select("item_id", "at"), "item_id")
    size = F.lit(block_items)
    lists = placed.groupBy("user_id", F.floor(F.col("at") / size).cast("int").alias("block")).agg(
        F.collect_list((F.col("at") % size).cast("int")).alias("items")
    )
    lists = materialize(lists, "item-lists")
    per_user = lists.groupBy("user_id").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("items")).cast("bigint").alias("width"))
    facts = per_user.agg(F.count(F.lit(1)).alias("users"), F.sum(F.col("width").cast("double") * F.col("width")).alias("pairs"), F.max("lists").alias("lists")).first()
    n_blocks = lists.agg(F.max("block")).first()[0] or 0
    parts = max(cores, math.ceil((facts["pairs"] or 0) / 2 / PAIRS_PER_TASK))
    # Enough shares of every pair of blocks that tasks are even, however many cells one pair has.
    shares = max(math.ceil((facts["users"] or 0) / CELLS_PER_TASK), math.ceil(SHARES_PER_TASK * parts / ((n_blocks + 1) * (n_blocks + 2) // 2)))
    cuts = math.ceil((facts["lists"] or 1) / LISTS_PER_TASK)
    left = lists.select("user_id", F.col("block").alias("ba"), F.col("items").alias("la"))
    right = lists.select("user_id", F.col("block").alias("bb"), F.col("items").alias("lb"))
    keys = ["user_id"]
    if cuts > 1:  # a user of very many lists pairs them in several tasks
        left = left.withColumn("cut", F.pmod("ba", F.lit(cuts)).cast("int"))
        wide = per_user.filter(F.col("lists") > LISTS_PER_TASK).select("user_id", F.lit(True).alias("_wide"))
        left = left.join(wide, "user_id", "left").withColumn("cut", F.when(F.col("_wide"), F.col("cut")).otherwise(0)).drop("_wide")
        all_cuts = F.when(F.col("_wide"), F.sequence(F.lit(0), F.lit(cuts - 1))).otherwise(F.array(F.lit(0)))
        right = right.join(wide, "user_id", "left").withColumn("cut", F.explode(all_cuts)).drop("_wide")
        keys.append("cut")
    cells = left.join(right, keys).filter("ba <= bb").select("ba", "bb", "la", "lb", F.pmod(F.xxhash64("user_id"), F.lit(shares)).alias("share"))
    dealt = cells.repartition(parts, "ba", "bb", "share").sortWithinPartitions("ba", "bb").select("ba", "bb", "la", "lb")
    partial = dealt.mapInArrow(_count(block_items), "a bigint, b bigint, co bigint")
    return partial.groupBy("a", "b").agg(F.sum("co").alias("co")), items
