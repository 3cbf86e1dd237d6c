"""Logistic factors against one plain NumPy solver and on planted likes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.operators import factors


def _rows(n_users: int, n_items: int, seed: int = 0) -> pd.DataFrame:
    """Likes by planted tastes; item 0 is met by everyone and user 0 meets everything."""
    draw = np.random.default_rng(seed)
    u, v, b = draw.normal(size=(n_users, 3)), draw.normal(size=(n_items, 3)), draw.normal(size=n_items)
    met = draw.random((n_users, n_items)) < 0.4
    met[0, :] = met[:, 0] = True
    who, what = np.nonzero(met)
    z = 1.5 * (u[who] * v[what]).sum(1) + b[what]
    return pd.DataFrame({"user_id": who, "item_id": what, "target": (draw.random(len(z)) < 1 / (1 + np.exp(-z))).astype(int)})


def _plain(rows: pd.DataFrame, start: dict, rank: int, iterations: int, reg: float, biased: bool):
    """The same alternating solves, one owner after the other."""
    items, users = dict(start), {u: np.zeros(rank + 1) for u in rows.user_id}
    sides = [("user_id", "item_id", users, items), ("item_id", "user_id", items, users)]
    for _ in range(iterations):
        for own, other, mine, theirs in sides:
            for owner, part in rows.groupby(own):
                f = np.array([theirs[o] for o in part[other]])
                offset = f[:, -1].copy()
                f = np.c_[f[:, :-1], np.ones(len(f))] if biased else f[:, :-1]
                z = f @ mine[owner][: f.shape[1]] + offset
                w = np.where(np.abs(z) < 1e-6, 0.25, np.tanh(z / 2) / (2 * np.where(z == 0, 1, z)))
                theta = np.linalg.solve((f * w[:, None]).T @ f + reg * np.eye(f.shape[1]), f.T @ (part.target.to_numpy() - 0.5 - w * offset))
                mine[owner] = theta if biased else np.append(theta, 0.0)
    return users, items


@pytest.mark.parametrize("biased", [True, False])
def test_same_as_plain_solver_with_hot_owners_in_shares(spark, biased):
    rows = _rows(60, 25)
    pairs = spark.createDataFrame(rows)
    ids = pairs.select(F.col("item_id").cast("bigint").alias("item_id")).distinct().withColumn("shares", F.lit(1))
    start = {r["owner"]: np.array(r["vec"]) for r in factors._start(ids, "item_id", 3, 42).collect()}
    users, items = _plain(rows, start, 3, 3, 0.5, biased)
    # 7 rows a share: most owners are dealt out to several tasks.
    model = factors.train_logistic(pairs, rank=3, iterations=3, reg=0.5, biased=biased, per_share=7)
    for side, key, want in ((model.users, "user_id", users), (model.items, "item_id", items)):
        got = {r[key]: [*r["embedding"], r["bias"]] for r in side.collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
        assert biased == any(abs(g[-1]) > 0.01 for g in got.values())


def test_loss_never_rises_and_beats_a_constant_on_held_out_rows(spark):
    pairs = spark.createDataFrame(_rows(250, 60, seed=3))
    held = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(10)) == 0
    train, test = pairs.filter(~held).cache(), pairs.filter(held).cache()
    last = np.inf
    for iterations in (1, 2, 4):
        model = factors.train_logistic(train, rank=3, iterations=iterations, reg=1.0)
        report = factors.fit_report(train, model).first()
        whole = report["log_loss"] * report["n_rows"] + factors.penalty(model, 1.0)
        assert whole <= last + 1e-6
        last = whole
    unseen = factors.fit_report(test, model).first()
    assert unseen["log_loss"] < 0.95 * unseen["constant_loss"] and unseen["accuracy"] > 0.65
    plain = factors.train_logistic(train, rank=3, iterations=4, reg=1.0, biased=False)
    assert unseen["log_loss"] < factors.fit_report(test, plain).first()["log_loss"]


def test_odd_rows(spark):
    schema = "user_id bigint, item_id bigint, target int, vec string"
    rows = [(1, 1, 1, "x"), (1, 1, 1, "x"), (1, 2, 0, "x"), (2, 1, None, "x"), (None, 1, 1, "x"), (3, None, 0, "x"), (4, 2, 0, "x")]
    model = factors.train_logistic(spark.createDataFrame(rows, schema), rank=2, iterations=2)
    assert {r["user_id"] for r in model.users.collect()} == {1, 4}
    assert {r["item_id"] for r in model.items.collect()} == {1, 2}
    unknown = factors.logits(spark.createDataFrame([(99, 98)], "user_id bigint, item_id bigint"), model).first()
    assert unknown["logit"] == 0.0
    empty = factors.train_logistic(spark.createDataFrame([], schema), rank=2, iterations=1)
    assert empty.users.count() == 0 and empty.items.count() == 0


def test_several_blocks_with_shared_owners_and_the_report(spark):
    rows = _rows(40, 15, seed=2)
    pairs = spark.createDataFrame(rows)
    one = factors.train_logistic(pairs, rank=2, iterations=1, reg=0.5, blocks=1)
    some = factors.train_logistic(pairs, rank=2, iterations=1, reg=0.5, per_share=9, blocks=3)
    for a, b, key in ((one.users, some.users, "user_id"), (one.items, some.items, "item_id")):
        want, got = ({r[key]: [*r["embedding"], r["bias"]] for r in side.collect()} for side in (a, b))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    odd = spark.createDataFrame([(99, 1, 1), (1, 98, 0), (None, 1, 1), (2, 1, None)], "user_id bigint, item_id bigint, target bigint")
    asked = pairs.select(*odd.columns).unionByName(odd)
    report = factors.fit_report(asked, some, per_share=9, blocks=3).first()
    plain = factors._fit_by_rows(asked, some).first()
    assert report["n_rows"] == plain["n"] == len(rows) + 4
    assert np.isclose(report["log_loss"], plain["loss"] / plain["labelled"]) and np.isclose(report["accuracy"], plain["right"] / plain["labelled"])
    # Rows move when they are dealt, never with a vector.
    assert "Exchange" not in some.users._jdf.queryExecution().executedPlan().toString()
