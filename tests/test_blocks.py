"""The kernel of products of blocks, without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tonearm.operators import blocks

ROW = pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("weight", pa.float64())])
PAIR = pa.struct([("id", pa.int64()), ("match_id", pa.int64())])


def rows_of(left, right, weight, hidden, per_block):
    """A left block, then per right block its hidden pairs and the block, as the kernel gets them."""
    block = lambda ids, v, w: [{"id": int(i), "vec": list(map(float, v[i])), "weight": float(w[i])} for i in ids]
    rows = [(blocks.LEFT, block(range(len(left)), left, np.zeros(len(left))), None)]
    for a in range(0, len(right), per_block):
        ids = range(a, min(len(right), a + per_block))
        rows += [(blocks.SKIP, None, [{"id": u, "match_id": i} for u, i in hidden if i in ids]), (blocks.RIGHT, block(ids, right, weight), None)]
    for kind, members, skip in rows:
        columns = [pa.array([kind], pa.int32()), pa.array([members], pa.list_(ROW)), pa.array([skip], pa.list_(PAIR)), pa.array([0]), pa.array([0])]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "block", "skip", "lblk", "grp"])


@pytest.mark.parametrize("scale,decimals", [(1.0, 12), (1.0, 1), (1e-5, 12), (1e9, 12)])
def test_few_products_are_scored_and_none_is_lost(monkeypatch, scale, decimals):
    """Rounded vectors tie, small ones differ in the last decimal only, and products of large ones are no single-precision numbers' job."""
    rng = np.random.default_rng(3)
    left = rng.normal(size=(60, 8)).round(decimals) * scale
    right = rng.normal(size=(3000, 8)).round(decimals) * rng.choice([0.2, 0.5, 1.0], size=(3000, 1)) * scale
    right[1500:1520] = right[0]
    weight = rng.normal(size=3000).round(decimals) * scale
    hidden = {(u, int(i)) for u in range(60) for i in rng.integers(0, 3000, 40)} | {(7, i) for i in range(2995)}
    scored, plain = [], blocks.dot_plus_weight
    monkeypatch.setattr(blocks, "dot_plus_weight", lambda p, w: scored.append(np.size(p)) or plain(p, w))
    out = pa.Table.from_batches(list(blocks._kernel(7, blocks.dot_plus_weight)(rows_of(left, right, weight, sorted(hidden), 500))))
    got = {u: [] for u in range(60)}
    for u, i, s in zip(*(out.column(c).to_pylist() for c in ("id", "match_id", "score"))):
        got[u].append((i, s))
    want = plain(np.einsum("ij,kj->ik", left, right), weight)
    for u in range(60):
        order = sorted((i for i in range(3000) if (u, i) not in hidden), key=lambda i: (-want[u, i], i))[:7]
        found = sorted(got[u], key=lambda x: (-x[1], x[0]))
        assert [s for _, s in found] == pytest.approx([want[u, i] for i in order], rel=1e-12, abs=1e-12)
        if scale < 1e6:
            assert [i for i, _ in found] == order
    assert sum(scored) < 0.3 * left.shape[0] * right.shape[0]


def test_vectors_beyond_single_precision_are_met_in_full():
    left, right = np.array([[1e30, 0.0], [0.0, 1e30]]), np.array([[float(i), float(-i)] for i in range(600)])
    out = pa.Table.from_batches(list(blocks._kernel(2, blocks.dot_plus_weight)(rows_of(left, right, np.zeros(600), [], 300))))
    found = sorted(zip(*(out.column(c).to_pylist() for c in ("id", "match_id"))))
    assert found == [(0, 598), (0, 599), (1, 0), (1, 1)]
