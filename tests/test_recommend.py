"""Neighbours, products and recommendations against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.operators import blocks, embeddings, gram, itemknn, metrics, rerank
from tonearm.operators.blocks import topk_products


def brute_neighbors(pairs, k):
    users, n = defaultdict(set), Counter()
    for u, i in pairs:
        users[u].add(i)
        n[i] += 1
    co = Counter((a, b) for items in users.values() for a in items for b in items if a != b)
    out = {}
    for item in n:
        found = sorted(((c * c / n[b], b, c) for (a, b), c in co.items() if a == item), key=lambda x: (-x[0], x[1]))
        out[item] = [(b, round(c / math.sqrt(n[item] * n[b]), 6)) for _, b, c in found[:k]]
    return {i: v for i, v in out.items() if v}


def skewed_pairs(seed, wide):
    """Narrow users with a few items; ``wide`` users holding most items, so a third of all rows and more."""
    rng = random.Random(seed)
    pairs = {(u, rng.randrange(60)) for u in range(40) for _ in range(rng.randrange(1, 7))}
    for w in range(wide):
        share = [0.95, 0.6, 0.8][w % 3]
        pairs |= {(1000 + w, i) for i in range(60) if rng.random() < share}
    return sorted(pairs)


@pytest.mark.parametrize("seed,wide,k", [(1, 0, 5), (2, 1, 5), (3, 1, 1), (4, 3, 4), (5, 6, 8)])
def test_neighbors_exact_with_wide_users(spark, seed, wide, k):
    pairs = skewed_pairs(seed, wide)
    pos = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    got = defaultdict(list)
    for r in itemknn.neighbors(pos, k, block_items=7).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["neighbor_id"], r["sim"]))
    assert dict(got) == brute_neighbors(pairs, k)


def test_neighbors_of_hundreds_of_wide_users(spark):
    """300 users with 3,000 of 3,600 items each, beside 200 narrow ones."""
    rng = np.random.default_rng(5)
    held = np.zeros((500, 3600), bool)
    for u in range(300):
        held[u, rng.permutation(3600)[:3000]] = True
    held[300:] = rng.random((200, 3600)) < 0.002
    users, items = np.nonzero(held)
    pos = spark.createDataFrame(pd.DataFrame({"user_id": users, "item_id": items}))
    got = defaultdict(list)
    for r in itemknn.neighbors(pos, 4, block_items=1000).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append(r["neighbor_id"])
    co = held.T.astype(np.float32) @ held.astype(np.float32)
    strength = co.astype(float) ** 2 / held.sum(0)
    np.fill_diagonal(strength, -1)
    want = np.lexsort((np.broadcast_to(np.arange(3600), strength.shape), -strength))[:, :4]
    assert [got[i] for i in range(3600)] == want.tolist()


def test_lists_of_a_user_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(gram, "LISTS_PER_TASK", 3)
    monkeypatch.setattr(gram, "CELLS_PER_TASK", 5)
    pairs = skewed_pairs(5, 4)
    half, items = gram.co_occurrence(spark.createDataFrame(pairs, "user_id bigint, item_id bigint"), 4)
    at = {r["at"]: r["item_id"] for r in items.collect()}
    users = defaultdict(set)
    for u, i in pairs:
        users[i].add(u)
    got = {(at[r["a"]], at[r["b"]]): r["co"] for r in half.collect()}
    assert all(len(users[a] & users[b]) == n for (a, b), n in got.items())
    ids = sorted(users)
    assert len(got) == sum(bool(users[a] & users[b]) for k, a in enumerate(ids) for b in ids[:k])
    assert spark.createDataFrame([], "user_id bigint, item_id bigint").transform(lambda d: itemknn.neighbors(d, 3)).count() == 0


@pytest.mark.parametrize("ids,wide_items,pairs_per_item", [(1, 1000, 10**9), (10**14, 1000, 60), (1_000, 20, 60), (1, 0, 0)])
def test_neighbors_are_the_same_by_lists_and_by_products(spark, wide_items, pairs_per_item, ids):
    """Users by lists and by the blocked product, items whole in a task and summed over pairs; ids of any width."""
    pairs = [(u, i * ids - 7) for u, i in skewed_pairs(6, 3)]
    pos = spark.createDataFrame([*pairs, (None, pairs[0][1]), (5, None)], "user_id bigint, item_id bigint")
    # A row without user counts for its item, but meets nothing.
    n = Counter(i for _, i in pairs) + Counter([pairs[0][1]])
    users = defaultdict(set)
    for u, i in pairs:
        users[u].add(i)
    co = Counter((a, b) for items in users.values() for a in items for b in items if a != b)
    got = defaultdict(list)
    for r in itemknn.neighbors(pos, 5, 7, wide_items, pairs_per_item).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["neighbor_id"], r["sim"]))
    for item in n:
        best = sorted(((-c * c / n[b], b, c) for (a, b), c in co.items() if a == item))[:5]
        assert got[item] == [(b, round(c / math.sqrt(n[item] * n[b]), 6)) for _, b, c in best]


def test_co_occurring_pairs_stay_in_their_task(spark):
    """What the neighbour job moves grows with the users' lists, not with the pairs of items."""
    rng = random.Random(3)
    pairs = sorted({(u, rng.randrange(3000)) for u in range(300) for _ in range(60)})
    text = itemknn.neighbors(spark.createDataFrame(pairs, "user_id bigint, item_id bigint"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Window" not in text and "Join" not in text


@pytest.mark.parametrize("mode", ["baseline", "normalize_seed"])
def test_scores_are_the_same_by_lists_and_by_rows(spark, mode):
    pairs = [(u, i * 10**11) for u, i in skewed_pairs(8, 2)]
    pos = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    table = itemknn.neighbors(pos, 6)
    seeds = spark.createDataFrame([*pairs, (None, pairs[3][1]), (77, None), (78, 5)], "user_id bigint, item_id bigint")
    rows = lambda df: Counter(map(tuple, df.collect()))
    plain = rows(itemknn.scores(seeds, table, mode, seen=seeds))
    assert plain and all(rows(itemknn.scores(seeds, table, mode, wide_seeds=w)) == plain for w in (5, 1000))
    best = rows(itemknn.recommend(seeds, table, 4, mode, seen=seeds))
    assert all(rows(itemknn.recommend(seeds, table, 4, mode, wide_seeds=w)) == best for w in (5, 1000))


@pytest.mark.parametrize("mode", ["baseline", "sim2", "normalize_seed", "pop_pow", "pop_log"])
def test_recommend_modes(spark, mode):
    pairs = skewed_pairs(7, 0)
    neigh = brute_neighbors(pairs, 6)
    pop, seen = Counter(i for _, i in pairs), defaultdict(set)
    for u, i in pairs:
        seen[u].add(i)
    add = {
        "baseline": lambda s, b, u: s,
        "sim2": lambda s, b, u: s * s,
        "normalize_seed": lambda s, b, u: s / len(seen[u]),
        "pop_pow": lambda s, b, u: s / pop[b] ** 0.5,
        "pop_log": lambda s, b, u: s / math.log1p(pop[b]) ** 0.5,
    }[mode]
    want = defaultdict(Counter)
    for u, items in seen.items():
        for i in items:
            for b, s in neigh.get(i, []):
                if b not in items and s > 0.1:
                    want[u][b] += add(s, b, u)
    pos = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    recs = itemknn.recommend(pos, itemknn.neighbors(pos, 6), 5, mode, 0.1, itemknn.item_popularity(pos)).collect()
    by_user = defaultdict(list)
    for r in recs:
        assert r["item_id"] not in seen[r["user_id"]]
        assert r["score"] == pytest.approx(want[r["user_id"]][r["item_id"]], abs=2e-6)
        by_user[r["user_id"]].append((r["rank"], r["score"]))
    for u, scores in want.items():
        assert len(by_user[u]) == min(5, len(scores))
        best = sorted(scores.values(), reverse=True)[:5]
        assert [s for _, s in sorted(by_user[u])] == pytest.approx(best, abs=2e-6)


@pytest.mark.parametrize("left_rows,right_rows", [(1000, 1000), (16, 8), (7, 64)])
def test_products_match_numpy(spark, left_rows, right_rows):
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(50, 6)), rng.normal(size=(70, 6))
    items[10:20] = items[0]  # exact ties
    weight = np.zeros(70)
    skip = {(u, int(i)) for u in range(50) for i in rng.integers(0, 70, 12)}
    skip |= {(3, i) for i in range(66)}  # one user has nearly everything
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "id bigint, vec array<double>")
    right = spark.createDataFrame(
        [(i, v.tolist(), float(weight[i])) for i, v in enumerate(items)], "id bigint, vec array<double>, weight double"
    )
    pairs = spark.createDataFrame(sorted(skip) + [(999, 1), (1, 999)], "id bigint, match_id bigint")
    got = defaultdict(list)
    for r in topk_products(left, right, 7, skip=pairs, left_rows=left_rows, right_rows=right_rows).orderBy("id", "rank").collect():
        got[r["id"]].append((r["match_id"], r["score"]))
    scores = np.floor(users @ items.T * 1e6 + 0.5) / 1e6
    for u in range(50):
        order = sorted((i for i in range(70) if (u, i) not in skip), key=lambda i: (-scores[u, i], i))[:7]
        assert [i for i, _ in got[u]] == order
    assert len(got[3]) == 4


def test_warm_vectors_rules(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [0.0, 1.0], 0.0), (3, [1.0, 1.0], 0.0)], "item_id bigint, embedding array<double>, bias double")
    history = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1)], "user_id bigint, item_id bigint")
    aff = spark.createDataFrame([(1, 1, 1.0), (1, 2, -0.6), (2, 1, -0.5), (2, 2, -0.5), (3, 1, -0.9)], "user_id bigint, item_id bigint, score double")
    got = {r["user_id"]: r["embedding"] for r in embeddings.warm_vectors(history, aff, items).collect()}
    assert got[1] == pytest.approx([1.0, 0.8 / 2.3])  # weights 1.5 and 0.8 (default), item 2 left out
    assert got[2] == pytest.approx([0.5, 0.5])  # all weights zero: plain mean
    assert 3 not in got


def test_cold_vectors_fall_back(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 0.0)], "item_id bigint, embedding array<double>, bias double")
    tags = spark.createDataFrame([("a", [0.0, 2.0], 1.0), ("b", [0.0, 4.0], 3.0)], "tag string, embedding array<double>, bias double")
    tagged = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["zzz"])], "user_id bigint, tags array<string>")
    picks = spark.createDataFrame([(1, 1), (3, 1), (4, 77)], "user_id bigint, item_id bigint")
    got = {r["user_id"]: (r["embedding"], r["bias"]) for r in embeddings.cold_vectors(tagged, tags, picks, items).collect()}
    assert got == {1: ([0.5, 1.5], 2.0), 2: ([0.0, 2.0], 1.0), 3: ([1.0, 0.0], 0.0)}


def test_affinity_rerank_examples(spark):
    recs = spark.createDataFrame([(1, 1, 0.8475), (1, 2, 0.7841), (1, 3, 0.5477), (1, 4, 0.8292), (1, 5, 0.9)], "user_id bigint, item_id bigint, score double")
    aff = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.7), (1, 3, 1.0), (1, 5, -0.6)], "user_id bigint, item_id bigint, score double")
    got = {r["item_id"]: r["score"] for r in rerank.affinity_rerank(recs, aff).collect()}
    assert got == pytest.approx({1: 1.1018, 2: 1.3330, 3: 1.0954, 4: 0.8292}, abs=1e-4)


def test_language_rerank_shift(spark):
    recs = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.5), (2, 1, -2.0), (2, 2, 3.0), (3, 1, 0.1)], "user_id bigint, item_id bigint, score double")
    users = spark.createDataFrame([(1, "Chinese"), (2, "English"), (3, None)], "user_id bigint, preferred_languages string")
    songs = spark.createDataFrame([(1, 24), (2, 52)], "item_id bigint, language int")
    got = {(r["user_id"], r["item_id"]): (r["score"], r["rank"]) for r in rerank.language_rerank(recs, users, songs).collect()}
    assert got[(1, 1)] == (1.0, 1) and got[(1, 2)] == (pytest.approx(0.22), 2)
    assert got[(2, 2)] == (6.0, 1) and got[(2, 1)] == (pytest.approx(0.2), 2)
    assert got[(3, 1)] == (0.1, 1)


def test_normalize_seed_keeps_the_order(spark):
    pos = spark.createDataFrame(skewed_pairs(11, 0), "user_id bigint, item_id bigint")
    table = itemknn.neighbors(pos, 6)
    order = lambda mode: {
        r["user_id"]: r["l"]
        for r in itemknn.recommend(pos, table, 3, mode).filter("rank = 1").groupBy("user_id").agg(F.first("score").alias("l")).collect()
    }
    seeds = {r["user_id"]: r["count"] for r in pos.groupBy("user_id").count().collect()}
    base, norm = order("baseline"), order("normalize_seed")
    assert {u: s / seeds[u] for u, s in base.items()} == pytest.approx(norm, abs=1e-6)


@pytest.mark.parametrize("n_left,left_rows", [(12, 1), (40, 2), (7, 100)])
def test_empty_blocks_meet_nothing(spark, n_left, left_rows):
    """Blocks of one or two rows: hashing leaves several of them empty."""
    rng = np.random.default_rng(n_left)
    a, b = rng.normal(size=(n_left, 4)), rng.normal(size=(30, 4))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id bigint, vec array<double>")
    right = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(b)], "id bigint, vec array<double>, weight double")
    hidden = {(i, j) for i in range(n_left) for j in range(30) if (i * 7 + j) % 4 == 0}
    skip = spark.createDataFrame(sorted(hidden), "id bigint, match_id bigint")
    got = defaultdict(list)
    for r in topk_products(left, right, 3, skip=skip, left_rows=left_rows, right_rows=4).orderBy("id", "rank").collect():
        got[r["id"]].append(r["match_id"])
    product = a @ b.T
    want = {i: sorted((j for j in range(30) if (i, j) not in hidden), key=lambda j: -product[i, j])[:3] for i in range(n_left)}
    assert dict(got) == want


@pytest.mark.parametrize("wide_seeds", [0, 7, 1000])
def test_grid_ranks_against_brute_force(spark, wide_seeds):
    """Every cell and mode: the held-out item's rank among the user's unseen candidates, by lists and by rows."""
    rng = random.Random(12)
    pairs = sorted({(u, u % 3 * 10 + rng.randrange(12)) for u in range(40) for _ in range(7)} | {(99, i) for i in range(0, 32, 2)})
    held = {u: rng.choice([i for v, i in pairs if v == u]) for u in sorted({u for u, _ in pairs})}
    train = [(u, i) for u, i in pairs if held.get(u) != i]
    neigh, pop, seen = brute_neighbors(train, 6), Counter(i for _, i in train), defaultdict(set)
    for u, i in train:
        seen[u].add(i)
    tested = {u: i for u, i in held.items() if i in pop}
    cells, modes = [(k, t) for k in (2, 6) for t in (0.0, 0.3)], metrics.GRID_MODE
    want = {}
    for k, t in cells:
        ranks = {m: [] for m in modes}
        for u, aim in tested.items():
            s, q = Counter(), Counter()
            for i in seen[u]:
                for b, sim in neigh.get(i, [])[:k]:
                    if sim > t:
                        s[b] += math.floor(sim * 1e9 + 0.5)
                        q[b] += math.floor(sim * sim * 1e9 + 0.5)
            if aim not in s:
                continue
            for m in modes:
                unit = {"normalize_seed": lambda b: len(seen[u]), "pop_pow": lambda b: pop[b] ** 0.5, "pop_log": lambda b: math.log1p(pop[b]) ** 0.5}.get(m, lambda b: 1.0)
                score = {b: math.floor((q if m == "sim2" else s)[b] / (1000.0 * unit(b)) + 0.5) for b in s if b not in seen[u]}
                ranks[m].append(1 + sum((-v, b) < (-score[aim], aim) for b, v in score.items()))
        for m in modes:
            hits = [r for r in ranks[m] if r <= 3]
            want |= {(m, k, t, "recall"): len(hits) / len(tested), (m, k, t, "ndcg"): sum(1 / math.log2(r + 1) for r in hits) / len(tested)}
    frame = lambda rows: spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    got = metrics.knn_grid(frame(list(held.items())), frame(train), itemknn.neighbor_lists(frame(train), 6), (2, 6), (0.0, 0.3), ks=(3,), wide_seeds=wide_seeds)
    got = {(r["agg"], r["item_k"], r["sim_threshold"], name): r[f"{name}_3"] for r in got.collect() for name in ("recall", "ndcg")}
    assert got == pytest.approx(want, abs=6e-6) and len(set(want.values())) > 10


def test_later_blocks_only_add_what_reaches_the_best_so_far():
    """Pruning by the k-th best keeps ties and skipped places right, whatever the order of blocks."""
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 12, (30, 200)) / 4
    scores[rng.random((30, 200)) < 0.2] = -np.inf
    scores[5, 3:] = -np.inf
    ids = rng.permutation(200)
    state = blocks._best(scores[:, :40], ids[:40], 6)
    for lo in range(40, 200, 40):
        found = blocks._best(scores[:, lo : lo + 40], ids[lo : lo + 40], 6, state[0][:, -1])
        state = blocks._best(*[np.hstack(x) for x in zip(state, found)], 6)
    for row in range(30):
        order = sorted((i for i in range(200) if np.isfinite(scores[row, i])), key=lambda i: (-scores[row, i], ids[i]))[:6]
        n = np.isfinite(state[0][row]).sum()
        assert state[1][row][:n].tolist() == ids[order].tolist() and state[0][row][:n].tolist() == scores[row, order].tolist()


def test_sums_of_tags_are_dealt_out_by_item(spark, monkeypatch):
    """Items without a vector get none of the tags' vectors, and the others are dealt to several tasks before they do."""
    monkeypatch.setattr(embeddings, "ITEMS_PER_TASK", 2)
    items = spark.createDataFrame([(i, [float(i), 1.0], 0.5) for i in range(30)], "item_id bigint, embedding array<double>, bias double")
    tags = spark.createDataFrame([("a", [1.0, 2.0], 0.1), ("b", [10.0, 20.0], 0.2)], "tag string, embedding array<double>, bias double")
    tagged = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a", "z"]) for i in range(5, 500)], "item_id bigint, tags array<string>")
    out = embeddings.full_item_vectors(items, tagged, tags)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(tag" not in plan
    got = {r["item_id"]: (r["embedding"], round(r["bias"], 6)) for r in out.collect()}
    want = {i: ([i + (0 if i < 5 else 11 if i % 2 else 1), 1 + (0 if i < 5 else 22 if i % 2 else 2)], round(0.5 + (0 if i < 5 else 0.3 if i % 2 else 0.1), 6)) for i in range(30)}
    assert got == want
