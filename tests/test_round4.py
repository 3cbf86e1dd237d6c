"""What the findings of the fourth round asked for."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm import session
from tonearm.functions.hashing import Permutation
from tonearm.operators import blocks, hybrid, negatives
from tonearm.session import BROADCAST, materialize, tune


def test_relations_stay_small_beside_the_drivers_heap(spark):
    """100,000 ids are below Spark's own limit of 10 MB, and some of them at once are too much for a small driver."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        tune(spark)
        rows, ids = (materialize(spark.range(n).select((F.col("id") * 3).alias("id"))) for n in (3_000_000, 100_000))
        assert "BroadcastHashJoin" not in rows.join(ids, "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tune(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST) if before == str(BROADCAST) else before)


@pytest.mark.parametrize("at_once", [50, 1_000_000])
def test_draws_are_lists_made_in_the_users_tasks(spark, monkeypatch, at_once):
    """Draw by draw the same items as by the permutation in plain Python; no draw is a row of a shuffle."""
    monkeypatch.setattr(negatives, "DRAWS_AT_ONCE", at_once)
    monkeypatch.setattr(negatives, "ITEMS_PER_BLOCK", 64)
    n, users = 300, 12
    held = {u: set(range(u, 300, 7 + u)) for u in range(users)}
    truth = spark.createDataFrame([(u, i * 5) for u, own in held.items() for i in own], "user_id bigint, item_id bigint")
    items = spark.range(n).select((F.col("id") * 5).alias("item_id"))
    asked = spark.createDataFrame([(u, u * 5) for u in range(users)] + [(99, 0)], "user_id bigint, item_id bigint")
    lists, _ = negatives.sampled_lists(asked, truth, items, 40, 42)
    assert "Window" not in lists._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in lists.collect():
        assert all(s // 64 == r["block"] for s in r["slots"])
        got.setdefault(r["user_id"], []).extend(r["slots"])
    order = Permutation(n)
    keys = {r["user_id"]: r["k"] for r in asked.select("user_id", order.keys(F.col("user_id"), 42).alias("k")).collect()}
    for u in [*range(users), 99]:
        c, k = (np.array([[s[name] for s in keys[u]]] * order.size) for name in ("c", "k"))
        drawn = [s for s in order.values(np.arange(order.size), c, k).tolist() if s < n and s not in held.get(u, ())]
        assert sorted(got[u]) == sorted(drawn[:40])


def test_products_shuffle_no_vectors(spark, tmp_path):
    """What is left in the plan is a read of the best ``k``; both sides are written once and deleted; equal rows hide one by one, ids need not be known to the other side."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(90, 5)), rng.normal(size=(400, 5))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(None, [0.0] * 5)], "id bigint, vec array<double>")
    right = spark.createDataFrame([(i % 399, b[i % 399].tolist(), 0.0) for i in range(400)], "id bigint, vec array<double>, weight double")
    hidden = {(u, i) for u in range(90) for i in rng.integers(1, 399, 60).tolist()} | {(u, 0) for u in range(45)}
    skip = spark.createDataFrame(sorted(hidden) + [(u, i) for u, i in sorted(hidden)[:50]] + [(500, 1), (1, 900)], "id bigint, match_id bigint")
    before = set(session._run_tables)
    out = blocks.topk_products(left, right, 6, skip=skip, left_rows=20, right_rows=32)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in set(session._run_tables) - before] == ["top-products"]
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["match_id"])
    product = a @ b.T
    for u in range(90):
        once = [i for i in range(399) if (u, i) not in hidden] + [0]  # item 0 stands twice
        assert got[u] == sorted(once, key=lambda i: (-product[u, i], i))[:6]


def test_few_left_rows_are_dealt_to_all_cores(spark):
    """600 left rows of one partition are two tasks, 30 left rows meet the right rows in shares; the lists are those of one task."""
    rng = np.random.default_rng(9)
    b = rng.normal(size=(1000, 4))
    right = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(b)], "id bigint, vec array<double>, weight double")
    for n in (600, 30):
        a = rng.normal(size=(n, 4))
        left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id bigint, vec array<double>").coalesce(1)
        got = {}
        for r in blocks.topk_products(left, right, 3, right_rows=4).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["match_id"], r["rank"]))
        scores = a @ b.T + np.arange(1000) % 3
        assert got == {u: [(int(i), r + 1) for r, i in enumerate(np.argsort(-scores[u])[:3])] for u in range(n)}


def test_shuffle_files_go_with_their_job(spark):
    tune(spark)
    files = lambda: sum(f.endswith(".data") for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names)
    before = files()
    written = materialize(spark.range(100_000).withColumn("k", F.col("id") % 1000).groupBy("k").count())
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before
    assert written.count() == 1000
    twice = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(twice.collect()) == len(twice.collect()) == 7


def test_hybrid_factors_do_not_depend_on_how_the_work_is_dealt(spark):
    """Several blocks, and owners that several blocks share; no row meets a vector by a join."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(u), int(i), int(rng.integers(0, 2))) for u, i in zip(rng.integers(0, 25, 300), rng.integers(0, 12, 300))})
    pairs = spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int")
    tagged = lambda n, k: spark.createDataFrame([(i, [f"x{i % 3}", "all"]) for i in range(n) if i % 5], f"{k} bigint, tags array<string>")
    made = []
    for per_share, number in ((50_000, 1), (4, 3)):
        model = hybrid.train_hybrid(pairs, tagged(25, "user_id"), tagged(12, "item_id"), rank=2, iterations=2, reg=0.7, per_share=per_share, blocks=number)
        tables = (model.users, model.items, model.user_tags, model.item_tags)
        made.append([{r[0]: [*r["embedding"], r["bias"]] for r in t.collect()} for t in tables])
    assert [len(t) for t in made[0]] == [25, 12, 4, 4]
    for a, b in zip(*made):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
