"""Hybrid factors against a plain NumPy solver, and for users and items without rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonearm.operators import factors, hybrid


def _world(n_users: int, n_items: int, seed: int):
    """Tastes belong to tags: four kinds of users, five kinds of items, and one tag that all carry."""
    draw = np.random.default_rng(seed)
    kinds, sorts = draw.normal(size=(4, 3)), draw.normal(size=(5, 3))
    user_tags = {u: [f"kind{u % 4}", "all"] for u in range(n_users)}
    item_tags = {i: [f"sort{i % 5}"] for i in range(n_items)}
    who, what = np.nonzero(draw.random((n_users, n_items)) < 0.5)
    z = 2 * (kinds[who % 4] * sorts[what % 5]).sum(1)
    return pd.DataFrame({"user_id": who, "item_id": what, "target": (draw.random(len(z)) < 1 / (1 + np.exp(-z))).astype(int)}), user_tags, item_tags


def _tables(spark, user_tags, item_tags):
    tags = lambda t, k: spark.createDataFrame([(i, v) for i, v in t.items()], f"{k} bigint, tags array<string>")
    return tags(user_tags, "user_id"), tags(item_tags, "item_id")


def _plain(rows, user_tags, item_tags, start, rank, iterations, reg):
    parts_of = {
        "user_id": {u: [*(f"t{t}" for t in user_tags.get(u, [])), f"#{u}"] for u in rows.user_id.unique()},
        "item_id": {i: [*(f"t{t}" for t in item_tags.get(i, [])), f"#{i}"] for i in rows.item_id.unique()},
    }
    theta = {k: {p: np.zeros(rank + 1) for own in v.values() for p in own} for k, v in parts_of.items()}
    theta["item_id"].update(start)
    vec = lambda k, i: sum(theta[k][p] for p in parts_of[k][i])
    for _ in range(iterations):
        for mine, other in (("user_id", "item_id"), ("item_id", "user_id")):
            sums = {p: [np.zeros((rank + 1, rank + 1)), np.zeros(rank + 1)] for p in theta[mine]}
            for r in rows.itertuples():
                u, v = vec(mine, getattr(r, mine)), vec(other, getattr(r, other))
                z = u[:-1] @ v[:-1] + u[-1] + v[-1]
                f, own = np.append(v[:-1], 1.0), parts_of[mine][getattr(r, mine)]
                w = len(own) * (0.25 if abs(z) < 1e-6 else np.tanh(z / 2) / (2 * z))
                for p in own:
                    sums[p][0] += w * np.outer(f, f)
                    sums[p][1] += (1 / (1 + np.exp(-z)) - r.target) * f
            theta[mine] = {p: np.linalg.solve(h + reg * np.eye(rank + 1), h @ theta[mine][p] - g) for p, (h, g) in sums.items()}
    return theta, {k: {i: vec(k, i) for i in parts_of[k]} for k in parts_of}


def test_same_as_plain_solver(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "OWNERS_HELD", 5)
    rows, user_tags, item_tags = _world(30, 14, 1)
    del user_tags[3], item_tags[2]  # known by their own parts alone
    users, items = _tables(spark, user_tags, item_tags)
    side = hybrid._side(spark.createDataFrame(rows), "item_id", items)
    start = {r["owner"]: np.array(r["vec"]) for r in hybrid._start(side, 2, 42).collect()}
    theta, whole = _plain(rows, user_tags, item_tags, start, 2, 2, 0.7)
    model = hybrid.train_hybrid(spark.createDataFrame(rows), users, items, rank=2, iterations=2, reg=0.7)
    for table, key, want in (
        (model.users, "user_id", whole["user_id"]), (model.items, "item_id", whole["item_id"]),
        (model.user_tags, "tag", {p[1:]: v for p, v in theta["user_id"].items() if p[0] == "t"}),
        (model.item_tags, "tag", {p[1:]: v for p, v in theta["item_id"].items() if p[0] == "t"}),
    ):
        got = {r[key]: [*r["embedding"], r["bias"]] for r in table.collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_loss_falls_and_unseen_users_and_items_are_told_apart(spark):
    rows, user_tags, item_tags = _world(160, 60, 5)
    users, items = _tables(spark, user_tags, item_tags)
    pairs = spark.createDataFrame(rows)
    train = pairs.filter("user_id < 120 and item_id < 45").cache()
    last = np.inf
    for iterations in (1, 3, 6):
        model = hybrid.train_hybrid(train, users, items, rank=3, iterations=iterations, reg=0.5)
        report = factors.fit_report(train, model).first()
        assert report["log_loss"] < last
        last = report["log_loss"]
    unseen = pairs.filter("user_id >= 120 and item_id >= 45")
    cold = factors.Factors(hybrid.from_tags(users, "user_id", model.user_tags, 3), hybrid.from_tags(items, "item_id", model.item_tags, 3))
    report = factors.fit_report(unseen, cold).first()
    assert report["log_loss"] < 0.9 * report["constant_loss"]
    assert any(abs(r["bias"]) > 0.01 for r in model.item_tags.collect())


def test_odd_rows(spark):
    pairs = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (2, 1, None), (None, 1, 1), (1, 1, 1)], "user_id bigint, item_id bigint, target int")
    tags = spark.createDataFrame([(1, ["a", None, "a"]), (1, ["b"]), (9, ["c"]), (None, ["d"])], "user_id bigint, tags array<string>")
    model = hybrid.train_hybrid(pairs, tags, None, rank=2, iterations=1)
    assert {r["tag"] for r in model.user_tags.collect()} == {"a", "b"} and model.item_tags.count() == 0
    assert {r["user_id"] for r in model.users.collect()} == {1} and model.items.count() == 2
    empty = hybrid.train_hybrid(pairs.limit(0), tags, None, rank=2, iterations=1)
    assert empty.users.count() == 0 and empty.user_tags.count() == 0
