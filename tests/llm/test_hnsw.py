"""Neighbour search over several shards, in double precision, against brute force."""

from __future__ import annotations

import numpy as np

from tonearm.llm import hnsw


def _table(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)], "vec_id bigint, embedding array<double>")


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def _brute(vectors, q, k):
    score = hnsw.cosines(vectors, vectors[q])
    return sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:k]


def test_recall_over_several_shards_of_64_dimensions(spark):
    vectors = np.random.default_rng(8).normal(size=(3000, 64))
    found, hits = _found(hnsw.search(_table(spark, vectors), every=50, shard_rows=800)), 0
    for q in range(0, 3000, 50):
        hits += len({i for _, i in _brute(vectors, q, 5)} & {i for i, _ in found[q]})
    assert hits / (60 * 5) >= 0.95


def test_doubles_keep_their_digits(spark):
    """Neighbours that differ by less than a float can tell, and components that no float holds."""
    base = np.random.default_rng(9).normal(size=8)
    close = np.array([base + 1e-9 * i * np.eye(8)[i % 8] for i in range(60)])
    for vectors in (close, close * 1e200, close * 1e-200):
        found = _found(hnsw.search(_table(spark, vectors), every=20))
        for q in (0, 20, 40):
            assert found[q] == [(i, -s) for s, i in _brute(vectors, q, 5)]


def test_scaled_copies_are_one_node_and_ties_go_to_the_smaller_id(spark):
    draw = np.random.default_rng(10)
    one = draw.normal(size=8)
    vectors = [one * 2.0 ** (i % 7) for i in range(400)] + list(draw.normal(size=(300, 8)))
    found = _found(hnsw.search(_table(spark, vectors), every=50, shard_rows=250))
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[50]] == [0, 1, 2, 3, 4]
    assert len(found[650]) == 5
