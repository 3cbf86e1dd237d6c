"""Top-k of a product of two vector tables, without row pairs.

Both sides are written once: the left one, with its hidden pairs, in blocks as
its tasks make them, the right one with its longest vectors first. A task reads a left
block and then the whole right table, in blocks of a few thousand rows; a NumPy
product runs per pair of blocks, and only each left row's best ``k`` leave the
task. No row pair is ever a Spark row, no vector is shuffled, so what is
written grows with the rows of both sides and not with their product, and no
task holds more than two blocks at a time.

Once a left row has ``k`` matches, most products cannot reach them. They are
formed in single precision, whose error is bounded, and only what may reach the
k-th best so far is scored in double precision; right rows too short to reach
it are not multiplied at all. The rows found are those of the whole product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import dot
from ..session import drop_tables, materialize, whole_batches

LEFT_ROWS = 32768
RIGHT_ROWS = 4096
# Right blocks worth a task of their own where left rows are too few for all cores, and tasks planned together.
RIGHT_BLOCKS_PER_TASK = 64
TASKS_AT_ONCE = 128
# Row kinds in their sort order within a right block; a left block sorts before all of them.
LEFT, SKIP, RIGHT = 0, 1, 2
# Kind of the left lines of the first task; those of the next ones count on.
LEFT_LINE = 10
LINE = {"kind": "int", "id": "bigint", "vec": "array<double>", "weight": "double", "hidden": "array<bigint>"}
# Rows of a tile of the single-precision product, and pairs scored at a time.
TILE_LEFT, TILE_RIGHT, PAIRS_AT_ONCE = 512, 1024, 65536
# Right rows met in full before that.
FIRST_RIGHT = 256
# Norms up to which single precision can hold the products.
LARGEST = 1e15

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot_plus_weight(product: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Inner product plus the right row's weight, cut to six decimals so ties are exact."""
    score = product + weight
    score *= 1e6
    score += 0.5
    np.floor(score, out=score)
    score /= 1e6
    return score


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    vectors = rows.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = vectors.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return order, ids[order], matrix[order]


def _at_least(scores: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores that reach its ``cut``, with their ids, filled up with minus infinity to the longest row."""
    rows, columns = np.nonzero(scores >= cut[:, None])
    n = np.bincount(rows, minlength=len(scores))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    kept, names = np.full((len(scores), n.max(initial=0)), -np.inf), np.zeros((len(scores), n.max(initial=0)), np.int64)
    kept[rows, place], names[rows, place] = scores[rows, columns], ids[rows, columns]
    return kept, names


def _best(scores: np.ndarray, ids: np.ndarray, k: int, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise best ``k`` by score, lowest id first on ties; ``ids`` broadcast to the scores. What stays below ``cut`` is left out."""
    ids = np.broadcast_to(ids, scores.shape)
    if cut is not None:
        scores, ids = _at_least(scores, ids, cut)
    if scores.shape[1] > k:
        # Everything at least as good as the k-th best stays until ties are resolved by id.
        scores, ids = _at_least(scores, ids, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    by_id = np.argsort(ids, axis=1, kind="stable")
    scores, ids = np.take_along_axis(scores, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
    by_score = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, by_score, axis=1), np.take_along_axis(ids, by_score, axis=1)


class _Screen:
    """Finds the pairs of a left block and a right block that may reach the left rows' cuts; for ``dot_plus_weight``."""

    def __init__(self, left: np.ndarray):
        self.norms = np.sqrt(np.einsum("ij,ij->i", left, left))
        self.usable = bool((self.norms < LARGEST).all())
        if self.usable:
            self.single = np.hstack([left, np.ones((len(left), 1))]).astype(np.float32)

    def tiles(self, right: np.ndarray, weight: np.ndarray):
        """The right rows, longest first, in tiles of (places, transposed single rows, largest norm, largest weight, rounding error per norm and beside it); None if out of range."""
        norms = np.sqrt(np.einsum("ij,ij->i", right, right))
        if not (self.usable and (norms < LARGEST).all() and (np.abs(weight) < LARGEST).all()):
            return None
        # Rounding of both inputs, of each product and of each sum, with room to spare.
        unit = (right.shape[1] + 6) * 2.0**-23
        order = np.argsort(-norms)
        out = []
        for at in (order[i : i + TILE_RIGHT] for i in range(0, len(order), TILE_RIGHT)):
            single = np.ascontiguousarray(np.hstack([right[at], weight[at, None]]).astype(np.float32).T)
            longest = norms[at[0]] * (1 + 1e-9)
            out.append((at, single, longest, weight[at].max(), unit * longest, unit * np.abs(weight[at]).max() + 1e-30))
        return out

    def reach(self, tiles, lo: int, hi: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows from ``lo``, right places) of all pairs whose score may reach ``cut``."""
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # Scores are cut to six decimals, by which a product may come up to the cut.
        least, norms, single = cut - 1e-6 - np.abs(cut) * 1e-9, self.norms[lo:hi], self.single[lo:hi]
        for at, right, longest, heaviest, per_norm, beside in tiles:
            wanted = least - (norms * per_norm + beside)
            some = np.flatnonzero(norms * longest + heaviest >= wanted)
            if not len(some):
                continue
            wanted = np.nextafter(wanted[some].astype(np.float32), np.float32(-np.inf))
            products = (single if len(some) == len(single) else single[some]) @ right
            found = np.flatnonzero((products >= wanted[:, None]).ravel())
            rows.append(some[found // len(at)])
            places.append(at[found % len(at)])
        return np.concatenate(rows), np.concatenate(places)


def _merge(state: tuple[np.ndarray, np.ndarray], rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Lets (row, score, id) into the rows' best ``k``, in place."""
    order = np.argsort(rows, kind="stable")
    rows, scores, ids = rows[order], scores[order], ids[order]
    met, first, n = np.unique(rows, return_index=True, return_counts=True)
    if not len(met):
        return
    line, place = np.repeat(np.arange(len(met)), n), np.arange(len(rows)) - np.repeat(first, n)
    kept, names = np.full((len(met), n.max()), -np.inf), np.zeros((len(met), n.max()), np.int64)
    kept[line, place], names[line, place] = scores, ids
    best = _best(np.hstack([state[0][met], kept]), np.hstack([state[1][met], names]), k)
    for side, new in zip(state, best):
        side[met] = new


def _kernel(k: int, score: Score, chunk: int = 1024):
    """Consumes rows in the order: left block, then per right block its skip pairs (if any) and the block.

    A left block's number and group come with every row: hashing may leave a
    block empty, and its right blocks must not meet the block before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_ids = left = screen = state = skip = held = None

        def best_so_far():
            scores, ids = state
            users = np.repeat(left_ids, scores.shape[1])
            ok = np.isfinite(scores.ravel())
            columns = [users[ok], ids.ravel()[ok], scores.ravel()[ok]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "match_id", "score"])

        def plain(state, left, right_ids, right, weight, skip_l, skip_r):
            parts = []
            for a in range(0, len(left), chunk):
                scores = score(left[a : a + chunk] @ right.T, weight)
                here = (skip_l >= a) & (skip_l < a + chunk)
                scores[skip_l[here] - a, skip_r[here]] = -np.inf
                # A later block only adds what reaches the k-th best so far.
                full = state is not None and state[0].shape[1] == k
                found = _best(scores, right_ids, k, state[0][a : a + chunk, -1] if full else None)
                if state is not None:
                    both = [np.hstack([old[a : a + chunk], new]) for old, new in zip(state, found)]
                    found = _best(*both, k)
                parts.append(found)
            return tuple(np.vstack([p[side] for p in parts]) for side in (0, 1))

        def screened(state, left, screen, right_ids, right, weight, skip_l, skip_r):
            tiles = screen.tiles(right, weight)
            if tiles is None:
                return plain(state, left, right_ids, right, weight, skip_l, skip_r)
            hidden = np.unique(skip_l * len(right_ids) + skip_r)
            for a in range(0, len(left), TILE_LEFT):
                b = min(a + TILE_LEFT, len(left))
                rows, places = screen.reach(tiles, a, b, state[0][a:b, -1])
                if len(hidden):
                    pair = (rows + a) * len(right_ids) + places
                    shown = hidden[np.minimum(np.searchsorted(hidden, pair), len(hidden) - 1)] != pair
                    rows, places = rows[shown], places[shown]
                for c in range(0, len(rows), PAIRS_AT_ONCE):
                    l, r = rows[c : c + PAIRS_AT_ONCE] + a, places[c : c + PAIRS_AT_ONCE]
                    _merge(state, l, score(np.einsum("ij,ij->i", left[l], right[r]), weight[r]), right_ids[r], k)
            return state

        for batch in batches:
            kinds, blocks, skips, lefts, groups = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "block", "skip", "lblk", "grp"))
            for i, cell in enumerate(zip(lefts.to_pylist(), groups.to_pylist())):
                kind = kinds[i].as_py()
                if cell != held:
                    if state is not None:
                        yield best_so_far()
                    held, left_ids, left, screen, state, skip = cell, None, None, None, None, None
                if kind == LEFT:
                    _, left_ids, left = _matrix(blocks[i].values)
                    screen = _Screen(left) if score is dot_plus_weight else None
                    continue
                if kind == SKIP:
                    skip = skips[i].values
                    continue
                if left is None:
                    continue
                order, right_ids, right = _matrix(blocks[i].values)
                weight = blocks[i].values.field("weight").to_numpy(zero_copy_only=False)[order]
                skip_l = skip_r = np.empty(0, dtype=np.int64)
                if skip is not None:
                    skip_l = np.searchsorted(left_ids, skip.field("id").to_numpy(zero_copy_only=False))
                    skip_r = np.searchsorted(right_ids, skip.field("match_id").to_numpy(zero_copy_only=False))
                    skip = None
                # The screen needs a k-th best: the first right rows are met in full.
                n, start = len(right_ids), 0
                while start < n:
                    full = state is not None and state[0].shape[1] == k
                    end = n if full or screen is None else min(n, start + max(k, FIRST_RIGHT))
                    here = (skip_r >= start) & (skip_r < end)
                    part = right_ids[start:end], right[start:end], weight[start:end], skip_l[here], skip_r[here] - start
                    state = plain(state, left, *part) if screen is None or not full else screened(state, left, screen, *part)
                    start = end
        if state is not None:
            yield best_so_far()

    return run


def _cells(id_, vec, weight) -> pa.Array:
    """Rows as one block."""
    rows = pa.StructArray.from_arrays([id_, vec, weight], ["id", "vec", "weight"])
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _meet(k: int, score: Score, want: dict[int, int], right_rows: int):
    """The lines of a task, its left rows (``want`` of them) and all right rows in whatever order it reads its files: the left rows' best ``k``."""
    pairs = lambda rows, matches: pa.ListArray.from_arrays(
        pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays([pa.array(rows, pa.int64()), pa.array(matches, pa.int64())], ["id", "match_id"])
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, early, got, task = [], [], 0, -1
        rows = matches = np.empty(0, np.int64)
        last = None

        def cell(kind: int, block: pa.Array | None, skip: pa.Array | None) -> pa.RecordBatch:
            columns = [pa.array([kind], pa.int32()), block, skip, pa.array([task]), pa.array([0])]
            return pa.RecordBatch.from_arrays([pa.nulls(1) if c is None else c for c in columns], ["kind", "block", "skip", "lblk", "grp"])

        def head() -> pa.RecordBatch:
            nonlocal rows, matches
            table = pa.Table.from_batches(lefts).combine_chunks()
            id_, vec, hidden = (table.column(c).combine_chunks() for c in ("id", "vec", "hidden"))
            width = np.nan_to_num(pa.compute.list_value_length(hidden).to_numpy(zero_copy_only=False)).astype(np.int64)
            rows, matches = np.repeat(id_.to_numpy(), width), hidden.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(matches, kind="stable")
            rows, matches = rows[order], matches[order]
            lefts.clear()
            return cell(LEFT, _cells(id_, vec, pa.array(np.zeros(len(id_)))), None)

        def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal last
            for lo in range(0, batch.num_rows, right_rows):
                part = batch.slice(lo, right_rows)
                ids = part.column("id").to_numpy()
                # Of rows of one id, which lie side by side, the first is hidden.
                new = np.unique(ids) if last is None else np.setdiff1d(ids, [last])
                last = ids[-1]
                a, n = np.searchsorted(matches, new, "left"), np.searchsorted(matches, new, "right")
                n -= a
                if n.any():
                    some = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
                    yield cell(SKIP, None, pairs(rows[some], matches[some]))
                yield cell(RIGHT, _cells(part.column("id"), part.column("vec"), part.column("weight")), None)

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            here = kinds >= LEFT_LINE
            if here.any():
                some = batch.filter(pa.array(here))
                lefts.append(some)
                got, task = got + some.num_rows, int(some.column("kind")[0].as_py()) - LEFT_LINE
                if got == want[task]:
                    yield head()
            if (kinds == RIGHT).any():
                early.append(batch.filter(pa.array(kinds == RIGHT)))
            if early and got and got == want[task]:
                for some in early:
                    yield from meet(some)
                early.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _kernel(k, score)(packed(batches)):
            ids, matches, scores = (found.column(i).to_numpy() for i in range(3))
            # Rows of one left id are ranked as one.
            order = np.lexsort((matches, -scores, ids))
            ids, matches, scores = ids[order], matches[order], scores[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
            rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) + 1
            kept = rank <= k
            columns = [pa.array(ids[kept]), pa.array(matches[kept]), pa.array(scores[kept]), pa.array(rank[kept], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "match_id", "score", "rank"])

    return run


def _lines(df: DataFrame, kind: Column, **columns: str) -> DataFrame:
    given = {"kind": kind} | {name: F.col(c) for name, c in columns.items()}
    return df.select(*[given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in LINE.items()])


def _bins(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Blocks put together up to ``most`` rows."""
    bins, room = [], 0
    for block, n in sorted(sizes.items(), key=lambda x: -x[1]):
        if not bins or n > room:
            bins.append([])
            room = most
        bins[-1].append(block)
        room -= n
    return bins


def topk_products(
    left: DataFrame,
    right: DataFrame,
    k: int,
    score: Score = dot_plus_weight,
    skip: DataFrame | None = None,
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
) -> DataFrame:
    """(id, match_id, score, rank): the best ``k`` right rows of every left row, a written table.

    ``left`` is (id, vec); ``right`` is (id, vec, weight); ``skip`` is
    (id, match_id) pairs that never match, removed before ranking.
    """
    spark = left.sparkSession
    key = lambda c: F.col(c).cast("bigint").alias(c)
    left = left.select(key("id"), "vec").filter("id is not null")
    if skip is None:
        left = left.withColumn("hidden", F.lit(None).cast("array<bigint>"))
    else:
        hidden = skip.select(key("id"), key("match_id")).groupBy("id").agg(F.collect_set("match_id").alias("hidden"))
        left = left.join(hidden, "id", "left")
    # Number of the task that made a row, and of its block there.
    place = F.monotonically_increasing_id()
    block = F.shiftright(place, 33) * 2**20 + F.floor(place.bitwiseAND(2**33 - 1) / left_rows)
    lefts = materialize(left.withColumn("blk", block.cast("bigint")), "left-vectors", by="blk")
    # The longest come first, so that those behind them need not be met.
    length = dot(F.col("vec"), F.col("vec")).desc()
    rights = right.select(key("id"), "vec", "weight").filter("id is not null").repartitionByRange(length, "id").sortWithinPartitions(length, "id")
    rights = materialize(rights, "right-vectors")
    sizes = {r["blk"]: r["count"] for r in lefts.groupBy("blk").count().collect()}
    bins, n = _bins(sizes, left_rows), sum(sizes.values())
    # Few left rows are dealt to all cores by their ids; where they are too few, so are the right ones.
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, math.ceil(min(cores, n // 256) / len(bins))) if bins else 1
    groups = max(1, min(math.ceil(rights.count() / right_rows / RIGHT_BLOCKS_PER_TASK), cores // max(1, len(bins) * parts)))
    share = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    tasks = [(blocks, part, group) for blocks in bins for part in range(parts) for group in range(groups)]
    n_of = {(r["blk"], r["part"]): r["count"] for r in lefts.groupBy("blk", share("id", parts).alias("part")).count().collect()} if parts > 1 else {(b, 0): c for b, c in sizes.items()}
    want = {i: sum(n_of.get((b, part), 0) for b in blocks) for i, (blocks, part, _) in enumerate(tasks)}

    def branch(i: int) -> DataFrame:
        blocks, part, group = tasks[i]
        own, met = lefts.filter(F.col("blk").isin(blocks)), rights
        if parts > 1:
            own = own.filter(share("id", parts) == part)
        if groups > 1:
            met = met.filter(share("id", groups) == group)
        own = _lines(own, F.lit(LEFT_LINE + i), id="id", vec="vec", hidden="hidden")
        return own.unionByName(_lines(met, F.lit(RIGHT), id="id", vec="vec", weight="weight")).coalesce(1)

    schema, found = "id bigint, match_id bigint, score double, rank int", []
    at_once = max(TASKS_AT_ONCE, 2 * cores)
    for lo in range(0, len(tasks), at_once):
        # Spark merges a union of single partitions into one partition; a first branch of two keeps the tasks apart.
        some = [_lines(spark.range(0, 2, 1, 2), F.lit(-1)), *[branch(i) for i in range(lo, min(lo + at_once, len(tasks)))]]
        with whole_batches(spark):
            found.append(materialize(reduce(DataFrame.unionByName, some).mapInArrow(_meet(k, score, want, right_rows), schema), "top-products"))
    drop_tables(lefts, rights)
    if not found:
        return spark.createDataFrame([], schema)
    out = reduce(DataFrame.unionByName, found)
    if groups == 1:
        return out
    order = Window.partitionBy("id").orderBy(F.desc("score"), "match_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
