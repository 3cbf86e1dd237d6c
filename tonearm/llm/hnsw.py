"""Approximate nearest neighbours: a navigable small-world graph per shard, kept as flat arrays.

Vectors are dealt out to shards of bounded size.  A shard's graph indexes its
distinct directions, told apart in single precision; scaled copies and vectors
that differ by less hang on one node.  Queries go to every shard in blocks, each
shard scores all vectors of the nodes it finds by the exact cosine of the
original doubles, and the answers are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

K = 5
SHARD_ROWS, BLOCK_ROWS = 4096, 512
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 96
_GRAPH = "shard int, ids binary, places binary, vectors binary, nodes binary, starts binary, links binary, levels binary, dims int, entry int"


def _even(a: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components below one: no square overflows or vanishes, and no digit changes."""
    _, exponent = np.frexp(np.abs(a).max(axis=-1, keepdims=True))
    return np.ldexp(a, -exponent)


def units(a: np.ndarray) -> np.ndarray:
    """Directions of the rows, in single precision."""
    a = _even(a)
    return (a / np.sqrt((a**2).sum(axis=-1, keepdims=True)) + 0.0).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with ``b`` in double precision; a row's value doesn't depend on the other rows."""
    a, b = _even(np.atleast_2d(a).astype(np.float64)), _even(b.astype(np.float64))
    dot = np.einsum("ij,j->i", a, b, optimize=False)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a, optimize=False)) * np.sqrt(np.einsum("j,j->", b, b, optimize=False)))


class Graph:
    """Levels of neighbour lists; level l of node v is a row of ``links[l]`` with ``size[l][v]`` entries."""

    def __init__(self, directions: np.ndarray, seed: int):
        self.x = directions
        n = len(directions)
        draw = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - draw.random(n)) / np.log(LINKS)).astype(int), 8) if n else np.zeros(0, int)
        top = int(self.levels.max(initial=0))
        self.wide = [2 * LINKS] + [LINKS] * top
        self.links = [np.full((n, w), -1, np.int32) for w in self.wide]
        self.size = [np.zeros(n, np.int32) for _ in self.wide]
        self.entry = 0
        self.stamp, self.turn = np.zeros(n, np.int32), 0

    def nearest(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes reached from ``starts``, as sorted (distance, node)."""
        self.turn += 1
        stamp, turn, links, size, x = self.stamp, self.turn, self.links[level], self.size[level], self.x
        for _, v in starts:
            stamp[v] = turn
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, v) for d, v in starts]
        heapq.heapify(best)
        while open_:
            d, v = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[v, : size[v]]
            near = near[stamp[near] != turn]
            if not len(near):
                continue
            stamp[near] = turn
            far = 1.0 - x[near] @ q
            limit = -best[0][0] if len(best) >= width else np.inf
            for dist, u in zip(far.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-dist, u))
                    heapq.heappush(open_, (dist, u))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, u))
                    heapq.heappush(open_, (dist, u))
        return sorted((-d, v) for d, v in best)

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes sorted by distance, those nearer to the centre than to any taken before; then the nearest others."""
        nodes = np.array([v for _, v in found])
        far = 1.0 - self.x[nodes] @ self.x[nodes].T
        taken, left = [], []
        for i, (d, _) in enumerate(found):
            if len(taken) >= most:
                break
            (left if taken and far[i, taken].min() < d else taken).append(i)
        return [int(nodes[i]) for i in (taken + left)[:most]]

    def add(self, v: int) -> None:
        if v == 0:
            return
        q, level = self.x[v], int(self.levels[v])
        top = int(self.levels[self.entry])
        at = [(float(1.0 - self.x[self.entry] @ q), self.entry)]
        for l in range(top, level, -1):
            at = self.nearest(q, at, 1, l)
        for l in range(min(level, top), -1, -1):
            at = self.nearest(q, at, BUILD_WIDTH, l)
            chosen = self.spread(at, LINKS)
            self.links[l][v, : len(chosen)] = chosen
            self.size[l][v] = len(chosen)
            for u in chosen:
                n = self.size[l][u]
                if n < self.wide[l]:
                    self.links[l][u, n] = v
                    self.size[l][u] = n + 1
                else:
                    own = np.append(self.links[l][u, :n], v)
                    far = 1.0 - self.x[own] @ self.x[u]
                    order = np.argsort(far, kind="stable")
                    kept = self.spread([(float(far[i]), int(own[i])) for i in order], self.wide[l] - self.wide[l] // 4)
                    self.links[l][u, : len(kept)] = kept
                    self.size[l][u] = len(kept)
        if level > top:
            self.entry = v

    def flat(self) -> tuple[bytes, bytes]:
        """All neighbour lists end to end, and where each begins, level after level."""
        starts, lists = [0], []
        for links, size in zip(self.links, self.size):
            lists.append(links[np.arange(links.shape[1]) < size[:, None]])
            starts.extend((starts[-1] + np.cumsum(size)).tolist())
        return np.array(starts, np.int64).tobytes(), np.concatenate(lists).astype(np.int32).tobytes()


def build(directions: np.ndarray, seed: int) -> Graph:
    graph = Graph(directions, seed)
    for v in range(len(directions)):
        graph.add(v)
    return graph


class Shard:
    """A stored shard: its graph, the distinct vectors of each node, and the ids of each vector."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
        node = np.frombuffer(row["nodes"], np.int32)
        # Vectors are stored in the order of their nodes, ids in that of their vectors.
        n = int(node[-1]) + 1
        self.of_node = np.searchsorted(node, np.arange(n + 1))
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.of_vector = np.searchsorted(np.frombuffer(row["places"], np.int32), np.arange(len(self.vectors) + 1))
        graph = self.graph = Graph.__new__(Graph)
        graph.x = units(self.vectors[self.of_node[:-1]])
        graph.levels = np.frombuffer(row["levels"], np.int32)
        starts, links = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["links"], np.int32)
        graph.links, graph.size, graph.entry = [], [], row["entry"]
        for l in range(int(graph.levels.max(initial=0)) + 1):
            begin = starts[l * n : (l + 1) * n + 1]
            size = np.diff(begin).astype(np.int32)
            table = np.full((n, max(1, int(size.max(initial=0)))), -1, np.int32)
            table[np.arange(table.shape[1]) < size[:, None]] = links[begin[0] : begin[-1]]
            graph.links.append(table)
            graph.size.append(size)
        graph.stamp, graph.turn = np.zeros(n, np.int32), 0

    def found(self, unit: np.ndarray, width: int) -> list[int]:
        """Places of all vectors of the ``width`` nearest nodes found."""
        g = self.graph
        at = [(float(1.0 - g.x[g.entry] @ unit), g.entry)]
        for l in range(int(g.levels[g.entry]), 0, -1):
            at = g.nearest(unit, at, 1, l)
        return [p for _, v in g.nearest(unit, at, width, 0) for p in range(self.of_node[v], self.of_node[v + 1])]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number) of the distinct rows by their bytes: numbers follow the order of the bytes."""
    _, first, number = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_index=True, return_inverse=True)
    return first, number


def _index(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    ids, dims = rows.column("vec_id").to_numpy(), rows.column("dims")[0].as_py()
    vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(-1, dims)
    first, place = _distinct(vectors)
    distinct = vectors[first]
    directions = units(distinct)
    _, node = _distinct(directions)
    order = np.argsort(node, kind="stable")
    distinct, directions, node = distinct[order], directions[order], node[order]
    place = np.argsort(order, kind="stable")[place]
    by_place = np.lexsort((ids, place))
    graph = build(directions[np.searchsorted(node, np.arange(int(node[-1]) + 1))], key[0].as_py() + 1)
    starts, links = graph.flat()
    made = [
        key[0].as_py(), ids[by_place].tobytes(), place[by_place].astype(np.int32).tobytes(), distinct.tobytes(), node.astype(np.int32).tobytes(),
        starts, links, graph.levels.astype(np.int32).tobytes(), dims, graph.entry,
    ]
    names = [c.split()[0] for c in _GRAPH.split(", ")]
    types = [pa.binary() if c.endswith("binary") else pa.int32() for c in _GRAPH.split(", ")]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(names, made, types)})


def _answer(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["shard"]:
                    held, shard = row["shard"], Shard(row)
                queries = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dims"])
                out = []
                for query, q, unit in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), queries, units(queries)):
                    places = shard.found(unit, width)
                    pairs = []
                    for p, s in zip(places, cosines(shard.vectors[places], q).tolist()):
                        own = shard.ids[shard.of_vector[p] : shard.of_vector[p + 1]]  # ascending
                        pairs += [(-s, i) for i in own[own != query][:k].tolist()]
                    out += [(query, i, -s) for s, i in sorted(pairs)[:k]]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dims, vector as packed doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(~bad).filter(F.exists("embedding", lambda v: v != 0))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(v, np.float64) + 0.0).tobytes() for v in vectors])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dims"), packed("embedding").alias("vector"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ids, vectors, and the graph as flat arrays.  ``vectors`` is written already.

    Vectors of different lengths are never compared: a shard holds one length.
    """
    counts = {r["dims"]: r["count"] for r in vectors.groupBy("dims").count().collect()}
    first, shard = 0, F.lit(0)
    for dims, n in sorted(counts.items()):
        shards = max(1, -(-n // shard_rows))
        shard = F.when(F.col("dims") == dims, F.lit(first) + F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).otherwise(shard)
        first += shards
    dealt = vectors.withColumn("shard", shard).repartition(max(1, first), "shard")
    return materialize(dealt.groupBy("shard").applyInArrow(_index, _GRAPH), "hnsw-graphs")


def search(embeddings: DataFrame, every: int = 50, k: int = K, shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; a query isn't its
    own neighbour.  Rows without id, and vectors that are null, empty, all zero
    or hold a null or non-finite component, take no part.  A repeated id with
    the same vector is one row; with different vectors, each is a candidate and
    a query of its own under that id.  Further columns are ignored; an empty
    table gives an empty result.
    """
    vectors = materialize(usable(embeddings).distinct(), "hnsw-vectors")
    graphs = index(vectors, shard_rows)
    shards = graphs.select("shard", F.col("dims").alias("_dims"))
    blocks = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(max(1, -(-vectors.count() // (every * BLOCK_ROWS)))))
    )
    blocks = blocks.groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("q"))

    @F.pandas_udf("q_ids binary, q_vectors binary")
    def joined(q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "q_ids": [np.array([r["vec_id"] for r in rows], np.int64).tobytes() for rows in q],
            "q_vectors": [b"".join(r["vector"] for r in rows) for rows in q],
        })

    queries = blocks.select(F.col("dims").alias("_dims"), "block", joined("q").alias("j")).select("_dims", "block", "j.*")
    # The stated query set meets every shard, a block at a time.
    tasks = queries.join(shards, "_dims").select("shard", "q_ids", "q_vectors").join(graphs, "shard")
    answers = tasks.mapInArrow(_answer(k, width), "query_id bigint, vec_id bigint, score double").distinct()
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
