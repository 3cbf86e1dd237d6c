"""Merkle manifest and prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import merkle, segments, trie

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, at bigint, digest string, `_part` int, changed int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 7, "d", 3, 1) for r in rows], DOCS)


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    doc_id, _, lang, source, n = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n, text)]
    return _h("-" if v is None else f"{len(v.encode())}:{v}" for v in values)


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    path = []
    for nodes in levels[:-1]:
        first = i - i % 3
        run = nodes[first : first + 3]
        path.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= 3
    return path


def merkle_by_hand(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[1]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = _levels([x[2] for x in by[s]])
    forest = _levels([trees[s][-1][0] for s in names])
    root, out = forest[-1][0], []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(by[s]):
            path = _path(trees[s], i) + _path(forest, k)
            now, text = leaf, row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                now = _leaf(row, None if text is None else text.replace("\n", ""))
            for at, others in path:
                now = _h([*others[:at], now, *others[at:]])
            out.append((row[0], leaf, trees[s][-1][0], root, _h(x for _, o in path for x in o), now, now == root))
    return out


def _same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


ODD = [
    (1, None, "en", "a", 1), (1, None, "en", "a", 1), (2, "", None, "a", None), (None, "x\ny", "en", "a", 2), (None, "x\ny", "en", None, 2),
    (3, "line\n" * 20_000, "ü", "ä", 5), (4, "a\n\nb", "en", "z", 1), (-5, "a\nb", "en", None, -1), (9, "tab\tnone", "en", "", 0),
]


def test_merkle_on_odd_rows(spark):
    _same(merkle.audit(_docs(spark, ODD)).collect(), merkle_by_hand(ODD))
    assert merkle.audit(_docs(spark, [])).count() == 0
    _same(merkle.audit(_docs(spark, ODD[:1])).collect(), merkle_by_hand(ODD[:1]))


@pytest.mark.parametrize("height", [1, 2])
def test_merkle_of_many_layers(spark, monkeypatch, height):
    """Small blocks, so that several layers are needed; one source and one row hold a third of all rows."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rng = random.Random(height)
    rows = [(i, f"t{i}\n" * rng.randrange(3), "en", f"s{rng.randrange(12)}", i) for i in range(130)]
    rows += [(1000 + i, "x\ny", "en", "hot", 1) for i in range(60)] + [(7, "same\n", "en", "hot", 1)] * 70
    _same(merkle.audit(_docs(spark, rows)).collect(), merkle_by_hand(rows))


@pytest.mark.parametrize("height", range(6))
def test_van_emde_boas_places(height):
    places = merkle._places(height)
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle._size(height + 1)))
    assert places[0][0] == 0
    if height >= 3:  # a subtree of the lower half lies in one piece
        low = merkle._size(height + 1 - (height + 1) // 2)
        first = [merkle.address(height + 1, d, 0) for d in range((height + 1) // 2, height + 1)]
        assert max(first) - min(first) < low


def test_running_sums_in_hot_groups(spark):
    rows = [("hot", 5, 2)] * 400 + [(None, i % 7, 1) for i in range(50)] + [(f"k{i % 9}", i, 3) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, o int, v int")
    made = segments.running(df, ["key"], [F.col("o")], {"total": "v", "place": F.lit(1)})
    got = sorted(((r["key"] or "", r["o"], r["place"], r["total"]) for r in made.collect()))
    want = []
    for key in {r[0] for r in rows}:
        total = 0
        for place, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            total += v
            want.append((key or "", o, place, total))
    assert [(a, c, d) for a, _, c, d in got] == [(a, c, d) for a, _, c, d in sorted(want)]


CONVS = "conv_id bigint, turn bigint, role string, text string, node string, at int, `_part` int, shard int"


def _convs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], CONVS)


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    kids = {}
    for seq in nodes:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    total = {}
    for seq in sorted(nodes, key=len, reverse=True):
        words = len(seq[-1][1].split()) if seq else 0  # test texts hold plain blanks only
        below = [total[k] for k in kids.get(seq, [])]
        total[seq] = (sum(b[0] for b in below) or 1, (len(nodes[seq]) - 1) * words + sum(b[1] for b in below))
    for seq, members in nodes.items():
        told = ",".join(map(str, sorted(ends.get(seq, []))))
        parent = min(nodes[seq[:-1]]) if seq else None
        out.append((min(members), len(seq), parent, len(members), len(kids.get(seq, [])), *total[seq], hashlib.sha256(told.encode()).hexdigest()))
    return out


def _talk(seed, n):
    rng = random.Random(seed)
    starts = [[("user", f"hello {i}"), ("assistant", "yes no maybe")] for i in range(3)]
    rows = []
    for c in range(n):
        turns = list(starts[0] if rng.random() < 0.5 else rng.choice(starts))
        turns += [(rng.choice(("user", "assistant")), f"word {rng.randrange(3)} more") for _ in range(rng.randrange(6))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    return rows


TALKS = {
    "mixed": _talk(1, 150),
    "copies": [(c, t, "user", f"a b {t}") for c in range(0, 4000, 20) for t in range(4)] + _talk(2, 40),
    "long": [(40, t, "user", "again") for t in range(600)] + [(41, t, "user", "again") for t in range(300)] + _talk(3, 30),
    "odd": [
        (None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, "assistant", "x " * 40_000), (7, 0, "user", "only"),
        (-3, 1, "user", "below zero"), (-3, 2, None, "next"), (61, 0, "a", "b"), (61, 1, "a", "b"), (61, 2, "a", "b"), (61, 3, "a", "b"), (61, 4, "a", "b"),
        (80, 0, "", "ab"), (81, 0, "a", "b"), (82, 0, "ab", ""), (83, 1, "user", "x"),
    ],
}


@pytest.mark.parametrize("name", TALKS)
@pytest.mark.parametrize("shard_rows", [None, 5])
def test_trie_against_brute_force(spark, name, shard_rows):
    _same(trie.prefix_trie(_convs(spark, TALKS[name]), shard_rows).collect(), trie_by_hand(TALKS[name]))


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(_convs(spark, [])).count() == 0
    assert trie.prefix_trie(_convs(spark, [(None, 1, "user", "x")])).count() == 0


def test_double_array_holds_each_child_once():
    rng = np.random.default_rng(4)
    array, parents = trie.DoubleArray(4), np.zeros(1, np.int64)
    seen = {}
    for _ in range(4):
        pairs = sorted({(int(p), int(t)) for p in parents for t in rng.integers(0, 300, rng.integers(1, 9))})
        a, b = np.array(pairs).T
        slots = array.add_level(a, b)
        assert len(set(slots.tolist())) == len(slots) and not set(slots.tolist()) & set(seen)
        seen |= dict(zip(slots.tolist(), pairs))
        parents = slots
    for slot, (parent, label) in seen.items():
        assert array.base[parent] + label == slot and array.check[slot] == parent
