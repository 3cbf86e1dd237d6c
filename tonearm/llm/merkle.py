"""Merkle manifest of a dataset, stored as blocks in van Emde Boas order.

1. A row's leaf is the hash of its fields; per source the leaves stand in the
   order of their ids and get positions.
2. A block is an aligned subtree of up to ``HEIGHT`` levels.  Its nodes lie in
   one array: the upper half of the levels first, then each subtree that hangs
   below it, both laid out by the same rule.  ``address`` computes a place from
   depth and index alone, for building as well as for looking up siblings.
3. The roots of a source's blocks are the leaves of its next layer, until one
   block is left.  The roots of the sources are the leaves of a last tree that
   is made the same way.
4. A proof gathers the siblings block by block, from the top layer down to the
   row; a block's path is shared by all rows below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .segments import running

ARITY = 3
#: Levels of edges in a block: 3**8 leaves, 315 kB of digests.
HEIGHT = 8
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = "tree string, block bigint, blocks bigint, n bigint, height int, nodes binary, root binary"


def _size(levels: int) -> int:
    """Nodes of a full subtree with that many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray | int) -> np.ndarray | int:
    """Places of the nodes ``index`` at ``depth`` (root: 0) in the array of a subtree with ``levels`` levels."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = ARITY ** (depth - top)
    return _size(top) + (index // below) * _size(levels - top) + address(levels - top, depth - top, index % below)


@lru_cache(None)
def _places(height: int) -> list[np.ndarray]:
    """Places of all nodes, by depth."""
    return [address(height + 1, d, np.arange(ARITY**d)) for d in range(height + 1)]


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def lay_out(leaves: list[bytes], height: int) -> bytearray:
    """The block above ``leaves``; places without a node stay zero."""
    nodes, places, now = bytearray(_size(height + 1) * DIGEST), _places(height), leaves
    for depth in range(height, -1, -1):
        for i, digest in zip(places[depth][: len(now)].tolist(), now):
            nodes[i * DIGEST : (i + 1) * DIGEST] = digest
        now = [_hash(now[i : i + ARITY]) for i in range(0, len(now), ARITY)] if depth else now
    return nodes


def siblings(nodes: bytes, height: int, n: int, leaf: int) -> list[tuple[int, list[bytes]]]:
    """From the leaf up: its place in its run and the others of the run."""
    path, places, i = [], _places(height), leaf
    for depth in range(height, 0, -1):
        first = i - i % ARITY
        run = places[depth][first : min(first + ARITY, n)]
        path.append((i - first, [bytes(nodes[p * DIGEST : (p + 1) * DIGEST]) for k, p in enumerate(run.tolist()) if first + k != i]))
        i, n = i // ARITY, -(-n // ARITY)
    return path


def _packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes((at, len(others))) + b"".join(others) for at, others in path)


def _unpacked(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(path):
        at, k = path[i], path[i + 1]
        yield at, [path[j : j + DIGEST] for j in range(i + 2, i + 2 + k * DIGEST, DIGEST)]
        i += 2 + k * DIGEST


def proof(path: bytes) -> str:
    """Hash of all siblings, level by level."""
    return _hash([d for _, others in _unpacked(path) for d in others]).hex()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to with the siblings of a path."""
    for at, others in _unpacked(path):
        leaf = _hash([*others[:at], leaf, *others[at:]])
    return leaf


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 4096).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from leaves (tree, block, at, n, digest) that come sorted; one block is held at a time."""
    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("n", pa.int64()), ("height", pa.int32())]
        + [(c, pa.binary()) for c in ("nodes", "root")]
    )
    full = ARITY**HEIGHT

    def made():
        key, total, held = None, 0, []
        for tree, block, _, n, digest in _rows(batches):
            if key != (tree, block):
                if held:
                    yield block_row(key, total, held)
                key, total, held = (tree, block), n, []
            held.append(digest)
        if held:
            yield block_row(key, total, held)

    def block_row(key, total, held):
        height = HEIGHT
        if total <= full:  # the only block of its tree ends where one node is left
            height = 0
            while ARITY**height < total:
                height += 1
        nodes = lay_out(held, height)
        return (*key, -(-total // full), len(held), height, bytes(nodes), bytes(nodes[:DIGEST]))

    return _batches(made(), schema, 64)


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """Written blocks (tree, block, blocks, n, height, nodes, root), layer by layer, above ``leaves`` (tree, at, n, digest).

    ``at`` counts from 0, ``n`` is the tree's number of leaves.
    """
    out, full = [], ARITY**HEIGHT
    while True:
        dealt = leaves.select("tree", F.floor(F.col("at") / full).alias("block"), "at", "n", "digest")
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
        blocks = materialize(dealt.mapInArrow(_build, _BLOCK), "merkle-blocks")
        out.append(blocks)
        rest = blocks.filter("blocks > 1")
        if rest.isEmpty():
            return out
        leaves = rest.select("tree", F.col("block").alias("at"), F.col("blocks").alias("n"), F.col("root").alias("digest"))


def _met(batches: Iterator[pa.RecordBatch], visit) -> Iterator[tuple]:
    """Call ``visit(block row, row)`` for every row behind its block's row."""
    block = None
    for row in _rows(batches):
        if row[2] is None:
            block = row
        else:
            yield visit(block, row)


def _with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (tree, at, …) dealt to their blocks (tree, block, n, height, nodes, path), each block in front of its rows."""
    full, own = ARITY**HEIGHT, [c for c in rows.columns if c not in ("tree", "at")]
    left = rows.select("tree", F.floor(F.col("at") / full).alias("block"), "at", *own, *[F.lit(None).cast(t).alias(c) for c, t in _OF_BLOCK])
    right = blocks.select(
        "tree", "block", F.lit(None).cast("bigint").alias("at"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own],
        *[c for c, _ in _OF_BLOCK],
    )
    return left.unionByName(right).repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("at").asc_nulls_first())


_OF_BLOCK = (("n", "bigint"), ("height", "int"), ("nodes", "binary"), ("path", "binary"))


def _path(block: tuple, row: tuple) -> bytes:
    n, height, nodes, above = block[-4:]
    return _packed(siblings(nodes, height, n, row[2] % ARITY**HEIGHT)) + above


def _child_paths(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tree, at, path) of the leaves (tree, at) of ``blocks``."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", pa.binary())])
    one = lambda block, row: (row[0], row[2], _path(block, row))
    return _with_block(rows, blocks).mapInArrow(lambda batches: _batches(_met(batches, one), schema, 1024), "tree string, at bigint, path binary")


def _paths(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest layer's blocks with the path from each block's root to the very top.

    ``above`` (tree, path) leads on from the root of each tree.
    """
    paths = None
    for k in reversed(range(len(layers))):
        blocks = layers[k].alias("b")
        with_path = blocks.filter("blocks = 1").join(above.alias("a"), F.col("b.tree").eqNullSafe(F.col("a.tree"))).select("b.*", "a.path")
        if paths is not None:
            same = F.col("b.tree").eqNullSafe(F.col("p.tree")) & (F.col("b.block") == F.col("p.at"))
            with_path = with_path.unionByName(blocks.filter("blocks > 1").join(paths.alias("p"), same).select("b.*", "p.path"))
        with_path = materialize(with_path, "merkle-paths")
        if k:
            below = layers[k - 1].filter("blocks > 1").select("tree", F.col("block").alias("at"))
            paths = materialize(_child_paths(below, with_path), "merkle-paths")
    return with_path


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """SHA-256 (hex) of a row's fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    own = F.lit("-") if text is None else F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[_field(c) for c in FIELDS[:-1]], own), 256)


class Manifest(NamedTuple):
    """A dataset's written manifest.

    ``leaves``: (tree, at, n, doc_id, digest and what else was carried), tree
    being the source.  ``layers`` and ``top``: the blocks below and above the
    roots of the sources.  ``subroots``: (tree, digest).  ``root``: hex.
    """

    leaves: DataFrame
    layers: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str


def build(documents: DataFrame, carry: dict[str, Column] | None = None) -> Manifest | None:
    """The manifest of ``documents`` (doc_id, source, lang, n_chars, text); None for an empty table.

    Per source, rows stand in the order of doc_id (null first), rows of one
    doc_id in the order of their leaves; repeated rows are leaves of their own.
    Null fields count as ``-``, a null source is a source and stands first.
    Further columns are ignored; ``carry`` adds columns to the leaves.
    """
    columns = [f"`{c}`" for c in FIELDS]
    rows = documents.select(*columns).select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(leaf(F.col("text").cast("string"))).alias("digest"), *[c.alias(k) for k, c in (carry or {}).items()],
    )
    placed = running(rows, ["tree"], [F.col("doc_id"), F.col("digest")], {"_at": F.lit(1).cast("bigint")})
    placed = materialize(placed.select("*", (F.col("_at") - 1).alias("at")).drop("_at"), "merkle-leaves")
    sizes = materialize(placed.groupBy("tree").agg((F.max("at") + 1).alias("n")), "merkle-sizes")
    if sizes.isEmpty():
        return None
    named = sizes.select(F.col("tree").alias("_tree"), "n")
    leaves = placed.join(named, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    layers = _layers(leaves.select("tree", "at", "n", "digest"))
    subroots = reduce(DataFrame.unionByName, [x.filter("blocks = 1").select("tree", F.col("root").alias("digest")) for x in layers])
    forest = running(subroots.withColumn("forest", F.lit(0)), ["forest"], [F.col("tree")], {"at": F.lit(1).cast("bigint")})
    forest = materialize(forest.select("tree", "digest", (F.col("at") - 1).alias("at")), "merkle-subroots")
    top = _layers(forest.select(F.lit("").alias("tree"), "at", F.lit(forest.count()).cast("bigint").alias("n"), "digest"))
    root = top[-1].first()["root"].hex()
    return Manifest(leaves, layers, top, forest, root)


def _top_paths(manifest: Manifest) -> DataFrame:
    """(tree, path) of every source: from its root to the dataset's."""
    above = manifest.subroots.sparkSession.createDataFrame([("", bytearray())], "tree string, path binary")
    paths = _child_paths(manifest.subroots.select(F.lit("").alias("tree"), "at"), _paths(manifest.top, above))
    return manifest.subroots.join(paths.select(F.col("at").alias("_at"), "path"), F.col("at") == F.col("_at")).select("tree", "path")


def proofs(manifest: Manifest, changed: str) -> DataFrame:
    """Per leaf: tree, doc_id, digest, proof (hex), and ``folded``, the root that the column ``changed`` leads to.

    ``changed`` is a carried binary column; where it is null, the leaf itself is folded.
    """
    blocks = _paths(manifest.layers, _top_paths(manifest))
    rows = manifest.leaves.select("tree", "at", "doc_id", "digest", F.col(changed).alias("changed"))
    made = "tree string, doc_id bigint, digest binary, proof string, folded binary"
    schema = pa.schema([("tree", pa.string()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("proof", pa.string()), ("folded", pa.binary())])

    def one(block, row):
        path = _path(block, row)
        return row[0], row[3], row[4], proof(path), fold(row[5] or row[4], path)

    return _with_block(rows, blocks).mapInArrow(lambda batches: _batches(_met(batches, one), schema, 4096), made)


def audit(documents: DataFrame) -> DataFrame:
    """Manifest, proofs, and a check of rows some of which were tampered with.

    Returns per row: doc_id, leaf, subroot, root, proof_sha256 of the rows as
    they are; folded_root from the tampered leaf and the untampered siblings;
    verified (folded_root equals root).  A null doc_id is never tampered with;
    an empty table gives an empty result; for all else see ``build``.
    """
    even = F.crc32(F.encode(F.col("doc_id").cast("bigint").cast("string"), "UTF-8")) % 2 == 0
    changed = F.when(even, F.unhex(leaf(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))))
    spark = documents.sparkSession
    manifest = build(documents, {"changed": changed})
    if manifest is None:
        return spark.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    low = lambda c: F.lower(F.hex(c))
    subroots = manifest.subroots.select(F.col("tree").alias("_tree"), low(F.col("digest")).alias("subroot"))
    rows = proofs(manifest, "changed").join(subroots, F.col("tree").eqNullSafe(F.col("_tree")))
    folded = low(F.col("folded"))
    return rows.select(
        "doc_id", low(F.col("digest")).alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), F.col("proof").alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.lit(manifest.root)).alias("verified"),
    )
