"""Logistic factors of users and items that are sums of tag vectors and an own part.

``vector(user) = sum of its tags' vectors + its own vector``, the same for
items and for the biases, so a user or an item without any rows still has the
vector of its tags.

All parts of one side move together. With ``m`` parts in a vector, the
quadratic that bounds a row's logistic loss is bounded once more by ``m`` times
its curvature in each part alone; that bound falls apart into one ridge solve
per tag or id, and its minimum never raises the regularised loss. Owners are
dealt to blocks once (``solves``): a block's task reads the other side's written
vectors and solves its owners' own parts. A tag that a third of all rows carry
costs one small sum per block, the sum of its owners' sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors
from ..session import drop_tables, materialize
from .factors import ROWS_PER_SHARE, Factors
from .solves import OWNER, PART, Side, by_block, column, deal, lines, matrix, met_block, nested, numbers, side_lines, solved

#: Tags whose sums a task holds before it passes them on.
OWNERS_HELD = 2_048


@dataclass
class Hybrid(Factors):
    """(id, embedding, bias) of both sides, and (tag, embedding, bias) of their tags."""

    user_tags: DataFrame
    item_tags: DataFrame


_SOLVED = "block int, owner bigint, part array<double>, tags array<string>, name string, sums binary"
_WHOLE = "block int, owner bigint, vec array<double>, part array<double>, tags array<string>"


def _solve(want: dict[int, int], reg: float, most: int):
    """The lines of a block: the new own parts of its owners, sums of owners that several blocks share (block -1) and of tags (block -2)."""

    def out(block: int, owner, part, tags, name, sums, n: int) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.binary()]
        given = [np.full(n, block), owner, part, tags, name, sums]
        columns = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(given, types)]
        return pa.RecordBatch.from_arrays(columns, ["block", "owner", "part", "tags", "name", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, heads = met_block(batches, want)
        if not block:
            return
        order = pa.array(block.order)
        tags = pa.concat_arrays([column(h, "tags") for h in heads]).take(order)
        part = np.concatenate([matrix(h, "part") for h in heads])[block.order]
        held: dict[str, np.ndarray] = {}
        send = lambda: out(-2, None, None, None, list(held), [x.tobytes() for x in held.values()], len(held))
        for at, left, slope in block.equations():
            own = tags.take(pa.array(at))
            n_tags = np.diff(own.offsets.to_numpy())
            left *= (n_tags + 1)[:, None, None]
            sums = np.hstack([left.reshape(len(at), -1), slope])
            whole = block.whole[at]
            vec = solved(left[whole], np.einsum("nij,nj->ni", left[whole], part[at[whole]]) - slope[whole], reg)
            yield out(number, block.ids[at[whole]], nested(vec), own.filter(pa.array(whole)), None, None, len(vec))
            shared = block.ids[at[~whole]]
            yield out(-1, shared, None, None, [f"#{i}" for i in shared.tolist()], [x.tobytes() for x in sums[~whole]], len(shared))
            coded = own.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            by = np.argsort(code, kind="stable")
            carrier = np.repeat(np.arange(len(at)), n_tags)[by]
            ends = np.searchsorted(code[by], np.arange(len(coded.dictionary) + 1))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                some = sums[carrier[ends[i] : ends[i + 1]]].sum(0)
                held[name] = held[name] + some if name in held else some
                if len(held) >= most:
                    yield send()
                    held.clear()
        if held:
            yield send()

    return run


def _meet(size: int, reg: float):
    """(owner, vec): rows ordered by owner, the owner's present vector first, then its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = theta = left = right = None
        out: list[tuple[str, np.ndarray]] = []

        def close():
            if owner is not None:
                out.append((owner, np.linalg.solve(left + reg * np.eye(size), left @ theta - right)))

        for batch in batches:
            for who, vec, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if data is None:
                    close()
                    owner, theta, left, right = who, np.array(vec), np.zeros((size, size)), np.zeros(size)
                else:
                    flat = np.frombuffer(data)
                    left += flat[: size * size].reshape(size, size)
                    right += flat[size * size :]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.string()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["owner", "vec"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.string()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["owner", "vec"])

    return run


def _side(rows: DataFrame, key: str, tagged: DataFrame | None) -> DataFrame:
    """(id, parts): each id of the rows with its distinct tags and its own part; tags start with 't', ids with '#'."""
    own = F.array(F.concat(F.lit("#"), F.col(key).cast("string")))
    ids = rows.select(key).distinct()
    if tagged is None:
        return ids.select(F.col(key).alias("id"), own.alias("parts"))
    tags = tagged.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.explode("tags").alias("tag")).filter("tag is not null")
    named = tags.groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit("t"), "tag"))).alias("tags"))
    return ids.join(named, key, "left").select(F.col(key).alias("id"), F.concat(F.coalesce("tags", F.array().cast("array<string>")), own).alias("parts"))


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a block, its owners and all tags, to its owners with the sum of their parts."""
    owners, names, vecs = [], [], []
    for batch in batches:
        kinds = numbers(batch, "kind")
        some = batch.filter(pa.array(kinds == OWNER))
        if some.num_rows:
            owners.append(some)
        some = batch.filter(pa.array(kinds == PART))
        if some.num_rows:
            names.append(column(some, "name"))
            vecs.append(matrix(some, "part"))
    for some in owners:
        tags, part = column(some, "tags"), matrix(some, "part")
        whole = part.copy()
        flat = tags.flatten()
        if len(flat):
            owner = np.repeat(np.arange(len(part)), np.diff(tags.offsets.to_numpy()))
            code = pa.compute.index_in(flat, pa.concat_arrays(names)).to_numpy(zero_copy_only=False)
            np.add.at(whole, owner, np.concatenate(vecs)[code])
        yield pa.RecordBatch.from_arrays([column(some, "block"), column(some, "owner"), nested(whole), column(some, "part"), tags], ["block", "owner", "vec", "part", "tags"])


def _whole(side: Side, own: DataFrame, tags: DataFrame) -> DataFrame:
    """(block, owner, vec, part, tags) of (block, owner, part, tags): an owner's vector is the sum of its part and its tags' (owner, vec)."""
    parts = lines(tags, PART, name="owner", part="vec")
    of = lambda b: lines(own.filter(F.col("block") == b), OWNER, block="block", owner="owner", part="part", tags="tags")
    blocks = [*range(side.blocks), *([-1] if side.n_shared else [])]
    return by_block(own.sparkSession, [[of(b), parts] for b in blocks], _sum_parts, _WHOLE, "whole-vectors")


def _start(side: DataFrame, rank: int, seed: int | None) -> DataFrame:
    """(owner, vec): own parts small by hash when a ``seed`` is given, everything else zero."""
    owners = side.select(F.explode("parts").alias("owner")).distinct()
    zero = F.array_repeat(F.lit(0.0), rank + 1)
    if seed is None:
        return materialize(owners.select("owner", zero.alias("vec")), "parts")
    value = lambda d: (F.pmod(F.xxhash64("owner", d, F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1) * (0.5 / rank**0.5)
    drawn = F.concat(F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), value), F.array(F.lit(0.0)))
    return materialize(owners.select("owner", F.when(F.col("owner").startswith("#"), drawn).otherwise(zero).alias("vec")), "parts")


def _step(side: Side, mine: DataFrame, theirs: DataFrame, tags: DataFrame, size: int, reg: float) -> tuple[DataFrame, DataFrame]:
    """One side's owners (block, owner, vec, part, tags) and tags (owner, vec) after the solves of their parts against the other side's whole vectors."""
    branches = side_lines(side, mine, theirs, part="part", tags="tags")
    done = by_block(mine.sparkSession, branches, _solve(side.want(), reg, OWNERS_HELD), _SOLVED, "solved")
    shared = mine.filter("block = -1").withColumn("name", F.concat(F.lit("#"), F.col("owner").cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = tags.unionByName(shared.select(F.col("name").alias("owner"), F.col("part").alias("vec"))).select("owner", "vec", none("binary").alias("sums"))
    body = done.filter("block < 0").select(F.col("name").alias("owner"), none("array<double>").alias("vec"), "sums")
    lined = heads.unionByName(body).repartition("owner").sortWithinPartitions("owner", F.col("sums").isNotNull())
    met = materialize(lined.mapInArrow(_meet(size, reg), "owner string, vec array<double>"), "parts")
    own = done.filter("block >= 0").select("block", "owner", "part", "tags")
    if side.n_shared:
        parts = met.select(F.col("owner").alias("name"), F.col("vec").alias("part"))
        own = own.unionByName(shared.drop("part").join(parts, "name").select("block", "owner", "part", "tags"))
    tags = met.filter(F.col("owner").startswith("t"))
    whole = _whole(side, own, tags)
    drop_tables(done, mine)
    return whole, tags


def train_hybrid(
    pairs: DataFrame, user_tags: DataFrame | None, item_tags: DataFrame | None, rank: int = 32, iterations: int = 10, reg: float = 1.0, seed: int = 42,
    per_share: int = ROWS_PER_SHARE, blocks: int | None = None,
) -> Hybrid:
    """Tag-aware factors of (user_id, item_id, target) rows, with (user_id, tags) and (item_id, tags).

    ``None`` for a tag table leaves that side to its own parts. Rows without
    user, item or target are left out, null and repeated tags are ignored,
    tags of ids without rows teach nothing. Without rows all tables are empty.
    ``per_share`` and ``blocks`` change how the work is dealt only.
    """
    key = lambda c: F.col(c).cast("bigint").alias(c)
    rows = pairs.select(key("user_id"), key("item_id"), (F.col("target") > 0).cast("double").alias("label")).dropna()
    rows, size = materialize(rows, "labelled-rows"), rank + 1
    dealt, tags, whole = {}, {}, {}
    for k, other, tagged, own_seed in (("user_id", "item_id", user_tags, None), ("item_id", "user_id", item_tags, seed)):
        dealt[k] = deal(rows, k, other, size, per_share, blocks)
        side = materialize(_side(rows, k, tagged), "parts-of")
        start = _start(side, rank, own_seed)
        tags[k] = start.filter(F.col("owner").startswith("t"))
        name = F.concat(F.lit("#"), F.col("owner").cast("string"))
        named = dealt[k].owners.withColumn("name", name).join(start.select(F.col("owner").alias("name"), F.col("vec").alias("part")), "name")
        own = named.join(side.select(F.col("id").alias("owner"), F.filter("parts", lambda x: x.startswith("t")).alias("tags")), "owner")
        own = own.select("block", "owner", "part", "tags").repartition(dealt[k].blocks, "block")
        whole[k] = _whole(dealt[k], materialize(own, "own-parts", by="block"), tags[k])
    for _ in range(iterations):
        for mine, other in (("user_id", "item_id"), ("item_id", "user_id")):
            whole[mine], tags[mine] = _step(dealt[mine], whole[mine], whole[other], tags[mine], size, reg)
    split = [F.slice("vec", 1, rank).alias("embedding"), F.element_at("vec", -1).alias("bias")]
    named = {k: t.select(F.substring("owner", 2, 1 << 30).alias("tag"), *split) for k, t in tags.items()}
    ids = {k: w.select(F.col("owner").alias(k), *split) for k, w in whole.items()}
    return Hybrid(ids["user_id"], ids["item_id"], named["user_id"], named["item_id"])


def from_tags(tagged: DataFrame, key: str, tags: DataFrame, rank: int) -> DataFrame:
    """(key, embedding, bias) of ids known by their tags alone; an id without a known tag is left out."""
    named = tagged.select(key, F.explode("tags").alias("tag")).distinct().join(tags, "tag")
    return named.groupBy(key).agg(vectors.sum_of("embedding", rank).alias("embedding"), F.sum("bias").alias("bias"))

