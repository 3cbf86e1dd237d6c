"""Counts and sums over short lists, where all rows of an owner (an item or a user) meet in one task.

An owner's lists travel packed, one row per list, so no pair is a Spark row.
Tasks get rows sorted by owner, and hold some million list elements at a time.
Owners with more than that are the callers' to count by plain aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: List elements that are unfolded at a time.
STEP = 2**21


def narrow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Array columns of whole numbers in the narrowest type that holds them; ``df`` must be written."""
    ends = df.agg(*[f(g(c)) for c in columns for f, g in ((F.min, F.array_min), (F.max, F.array_max))]).first()
    kinds = {}
    for i, c in enumerate(columns):
        lo, hi = (int(v or 0) for v in ends[2 * i : 2 * i + 2])
        kinds[c] = F.col(c).cast(f"array<{whole_type(lo, hi)}>")
    return df.withColumns(kinds)


def whole_type(lo: int, hi: int) -> str:
    return next((name for name, bits in (("smallint", 15), ("int", 31)) if -(2**bits) <= lo and hi < 2**bits), "bigint")


def _whole_owners(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.Table]:
    """Rows sorted by the first column, cut where the owner changes; ``lists`` is a list column that says how much a row holds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        upto = np.cumsum(np.diff(batch.column(lists).offsets.to_numpy()))
        cuts = np.flatnonzero(np.diff(upto // STEP)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            some = batch.slice(lo, hi - lo)
            owners = some.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() != owners[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = int(np.flatnonzero(owners[1:] != owners[:-1])[-1]) + 1 if owners[0] != owners[-1] else 0
            if last:
                yield pa.Table.from_batches([*held, some.slice(0, last)]).combine_chunks()
                held = []
            held.append(some.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Lists:
    """Elements of a table of whole owners, grouped by (owner, id) in ascending order."""

    def __init__(self, table: pa.Table, ids: int, others: np.ndarray | None = None):
        owners = table.column(0).to_numpy()
        self.first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        self.names = owners[self.first]
        self.rows = np.diff(np.append(self.first, len(owners)))
        self.row_owner = np.repeat(np.arange(len(self.names)), self.rows)
        column = table.column(ids).chunk(0)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(self.row_owner, np.diff(column.offsets.to_numpy()))
        # One number per (owner, id), also of the ids beside the lists.
        every = flat if others is None else np.concatenate([flat, others])
        values = None
        low, high = (int(every.min()), int(every.max())) if len(every) else (0, 0)
        if (high - low + 1) * len(self.names) < 2**62:
            self.span, every = high - low + 1, every - low
        else:
            values, every = np.unique(every, return_inverse=True)
            self.span = len(values)
        self.beside = every[len(flat) :]
        code = owner * self.span + every[: len(flat)]
        self.order = np.argsort(code)
        code = code[self.order]
        self.starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        self.code = code[self.starts]
        self.counts = np.diff(np.append(self.starts, len(code)))
        self.owner = self.code // self.span
        found = self.code % self.span
        self.id = found + low if values is None else values[found]

    def sorted(self, table: pa.Table, column: int) -> np.ndarray:
        """Elements of another list column in the order of the groups."""
        return table.column(column).chunk(0).flatten().to_numpy(zero_copy_only=False)[self.order]

    def holds(self, row_owner: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """Whether each group is among the given (owner, id beside the lists)."""
        return np.isin(self.code, row_owner * self.span + beside)


def _best(owner: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each owner's ``k`` largest values, earlier ones first on ties, and their ranks from 1."""
    order = np.lexsort((-value, owner))
    of = owner[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) + 1
    keep = rank <= k
    return order[keep], rank[keep]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _packed(width: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    """A list column of rows with ``width`` values each."""
    flat = pa.array(values.astype({"smallint": np.int16, "int": np.int32, "bigint": np.int64}[kind]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), flat)


def met_schema(ids: str, ns: str) -> str:
    return f"i bigint, n bigint, ids array<{ids}>, cos array<{ns}>, ns array<{ns}>"


def best_met(k: int, ids_kind: str, ns_kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (i, ids, ns), the lists that hold item ``i`` with the counts of their items: the ``k`` items of largest co^2 / n, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_owners(batches, 1):
            met = _Lists(table, 1)
            n = met.sorted(table, 2).astype(np.int64)[met.starts]
            own = met.names[met.owner] == met.id
            n_item = np.zeros(len(met.names), np.int64)
            n_item[met.owner[own]] = n[own]
            owner, ids, co, n = (x[~own] for x in (met.owner, met.id, met.counts, n))
            at, _ = _best(owner, co * co / n, k)
            width = np.bincount(owner[at], minlength=len(met.names))
            lists = [_packed(width, ids[at], ids_kind), _packed(width, co[at], ns_kind), _packed(width, n[at], ns_kind)]
            yield pa.RecordBatch.from_arrays([pa.array(met.names), pa.array(n_item), *lists], ["i", "n", "ids", "cos", "ns"])

    return run


SUMMED = "user_id bigint, item_id bigint, total bigint, n_seeds bigint, rank int"


def add_up(top_n: int | None, per_seed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (user_id, seed, ids, adds): each user's sums per id that is no seed, above 0; the ``top_n`` best by score, all if None.

    ``per_seed`` divides a score by the user's number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_owners(batches, 2):
            known = table.column(1).chunk(0).is_valid().to_numpy(zero_copy_only=False)
            offered = _Lists(table, 2, table.column(1).chunk(0).fill_null(0).to_numpy())
            if not len(offered.code):
                continue
            total = np.add.reduceat(offered.sorted(table, 3).astype(np.int64), offered.starts)
            fresh = (total > 0) & ~offered.holds(offered.row_owner[known], offered.beside[known])
            owner, ids, total = offered.owner[fresh], offered.id[fresh], total[fresh]
            n_seeds = offered.rows[owner].astype(np.int64)
            rank = np.zeros(len(owner), np.int64)
            if top_n is not None:
                unit = 1000.0 * n_seeds if per_seed else 1000.0
                at, rank = _best(owner, np.floor(total / unit + 0.5), top_n)
                owner, ids, total, n_seeds = owner[at], ids[at], total[at], n_seeds[at]
            yield _batch(user_id=offered.names[owner], item_id=ids, total=total, n_seeds=n_seeds, rank=rank.astype(np.int32))

    return run


RANKED = "cell int, agg string, rank bigint"


def cell_ranks(cells: Sequence[tuple[int, float]], modes: Sequence[str], alpha: float, deepest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (user_id, seed, t_item, ids, adds, pops), lists best first: the rank of ``t_item`` per user, (item_k, threshold) cell and mode, as far as ``deepest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_owners(batches, 3):
            known = table.column(1).chunk(0).is_valid().to_numpy(zero_copy_only=False)
            offered = _Lists(table, 3, table.column(1).chunk(0).fill_null(0).to_numpy())
            if not len(offered.code):
                continue
            add = offered.sorted(table, 4).astype(np.int64)
            upto = table.column(3).chunk(0).offsets.to_numpy()
            place = (np.arange(len(add)) - np.repeat(upto[:-1] - upto[0], np.diff(upto)) + 1)[offered.order]
            sim = add / 1e9
            add2 = np.floor(sim * sim * 1e9 + 0.5).astype(np.int64)
            pop = np.maximum(offered.sorted(table, 5)[offered.starts], 1).astype(np.float64)
            aim = table.column(2).to_numpy()[offered.first]
            is_aim = offered.id == aim[offered.owner]
            hidden = offered.holds(offered.row_owner[known], offered.beside[known])
            for cell, (k, threshold) in enumerate(cells):
                used = (place <= k) & (sim > threshold)
                meant = np.add.reduceat(used.astype(np.int64), offered.starts) > 0
                aimed = np.zeros(len(aim), bool)
                aimed[offered.owner[meant & is_aim]] = True
                if not aimed.any():
                    continue
                s = np.add.reduceat(np.where(used, add, 0), offered.starts)
                q = np.add.reduceat(np.where(used, add2, 0), offered.starts) if "sim2" in modes else s
                # The aim itself is a candidate that nothing of its own can pass.
                some = np.flatnonzero(meant & aimed[offered.owner] & (is_aim | ~hidden))
                owner, ids = offered.owner[some], offered.id[some]
                at = np.flatnonzero(is_aim[some])
                for mode in modes:
                    unit = {
                        "baseline": lambda: 1000.0, "sim2": lambda: 1000.0, "normalize_seed": lambda: 1000.0 * offered.rows[owner],
                        "pop_pow": lambda: 1000.0 * np.power(pop[some], alpha), "pop_log": lambda: 1000.0 * np.power(np.log1p(pop[some]), alpha),
                    }[mode]()
                    score = np.floor((q if mode == "sim2" else s)[some] / unit + 0.5)
                    aim_score = np.zeros(len(aim))
                    aim_score[owner[at]] = score[at]
                    ahead = (score > aim_score[owner]) | ((score == aim_score[owner]) & (ids < aim[owner]))
                    rank = np.bincount(owner[ahead], minlength=len(aim))[aimed] + 1
                    rank = rank[rank <= deepest].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rank), cell, np.int32)), pa.array([mode] * len(rank), pa.string()), pa.array(rank)], ["cell", "agg", "rank"]
                    )

    return run


def empty(column: str) -> Column:
    """The list column, empty instead of null."""
    return F.coalesce(F.col(column), F.array().cast("array<smallint>")).alias(column)
