"""Seeded, engine-independent pseudo-random order.

Every random choice of the library (hold-outs, samples, draws) is an order by
``md5`` of the row's own key, so a result does not depend on partitioning, on
the number of executors, or on a retried task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F


def order_key(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


def uniform_int(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**32)."""
    return F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("bigint")


def in_fraction(fraction: float, *parts: Column | str | int) -> Column:
    return uniform_int(*parts) < F.lit(int(fraction * 2**32))


class Permutation:
    """Keyed permutations of the whole numbers below ``size``, which is ``n`` or a little more.

    A number is a place in a grid of ``a`` rows and ``b`` columns.  Row and
    column are shifted in turn by a universal hash of the other one, so every
    step, and the whole, is one-to-one: no list, sort or memory is needed to
    draw without repetition.  Draws of ``n`` or more are to be skipped.
    """

    PRIME = 2**31 - 1
    STEPS = 4

    def __init__(self, n: int):
        self.n, low = max(1, n), max(1, math.isqrt(max(1, n)))
        self.size, self.a = min((a * -(-self.n // a), a) for a in range(low, low + 64))
        self.b = self.size // self.a

    def keys(self, *parts: Column | str | int) -> Column:
        """The key of a permutation: array<struct<c, k>>, a factor and a shift per step."""
        def step(i: int) -> Column:
            h = order_key(*parts, f"p{i}")
            c, k = (F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") for at in (1, 9))
            return F.struct((c % (self.PRIME - 1) + 1).alias("c"), (k % self.PRIME).alias("k"))

        return F.array(*[step(i) for i in range(self.STEPS)])

    def at(self, x: Column, keys: Column) -> Column:
        """Where the permutation takes ``x``."""
        row, column = F.floor(x / F.lit(self.b)).cast("bigint"), x % self.b
        for i in range(self.STEPS):
            key = F.get(keys, F.lit(i))
            shift = lambda v: (v * key["c"] + key["k"]) % self.PRIME  # noqa: B023, E731
            if i % 2:
                column = (column + shift(row)) % self.b
            else:
                row = (row + shift(column)) % self.a
        return row * self.b + column

    def values(self, x: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The same for arrays, with a line of factors and of shifts per number."""
        row, column = x // self.b, x % self.b
        for i in range(self.STEPS):
            if i % 2:
                column = (column + (row * c[:, i] + k[:, i]) % self.PRIME) % self.b
            else:
                row = (row + (column * c[:, i] + k[:, i]) % self.PRIME) % self.a
        return row * self.b + column
