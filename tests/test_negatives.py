"""Permutations, drawn negatives and their ranks against plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.functions.hashing import Permutation
from tonearm.operators import negatives


@pytest.mark.parametrize("n", [1, 2, 7, 100, 997, 5000])
def test_permutations_are_one_to_one(spark, n):
    order = Permutation(n)
    assert n <= order.size <= n + 70
    keyed = spark.range(3).select(F.col("id").alias("u"), order.keys(F.col("id"), 5).alias("keys"))
    drawn = keyed.select("u", F.explode(F.sequence(F.lit(0), F.lit(order.size - 1))).alias("x"), "keys").select("u", order.at(F.col("x"), F.col("keys")).alias("y"))
    by = defaultdict(list)
    for r in drawn.collect():
        by[r["u"]].append(r["y"])
    assert all(sorted(ys) == list(range(order.size)) for ys in by.values())
    assert n < 100 or by[0] != by[1] != by[2]


def test_draws_are_even(spark):
    """Each item is among a user's first tenth about equally often."""
    order = Permutation(200)
    keyed = spark.range(3000).select(order.keys(F.col("id"), 42).alias("keys"))
    first = keyed.select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("x"), "keys").select(order.at(F.col("x"), F.col("keys")).alias("y"))
    counts = np.array([r["n"] for r in first.filter("y < 200").groupBy("y").agg(F.count("*").alias("n")).collect()])
    assert len(counts) == 200 and abs(counts - 300).max() < 100


@pytest.mark.parametrize("n_items,wanted", [(1500, 999), (300, 999), (300, 50)])
def test_every_user_has_exactly_as_many_negatives(spark, monkeypatch, n_items, wanted):
    monkeypatch.setattr(negatives, "ITEMS_PER_BLOCK", 128)
    monkeypatch.setattr(negatives, "LISTS_PER_TASK", 7)
    rng = np.random.default_rng(1)
    users = list(range(20))
    held = {u: sorted(rng.choice(n_items, [0, 3, n_items // 2, n_items - 2][u % 4] + 1, replace=False).tolist()) for u in users}
    truth = spark.createDataFrame([(u, i * 10) for u in users for i in held[u]] + [(u, -5) for u in users], "user_id bigint, item_id bigint")
    vectors = rng.normal(size=(n_items, 8))
    items = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(n_items) * 10, "embedding": list(vectors)}))
    taste = rng.normal(size=(20, 8))
    of_users = spark.createDataFrame(pd.DataFrame({"user_id": users, "embedding": list(taste)}))
    positives = spark.createDataFrame([(u, held[u][0] * 10) for u in users], "user_id bigint, item_id bigint")
    drawn, slots = negatives.sampled_negatives(positives, truth, items, wanted, 42)
    got = defaultdict(set)
    for r in drawn.collect():
        assert r["slot"] not in got[r["user_id"]]
        got[r["user_id"]].add(r["slot"])
    for u in users:
        assert not got[u] & set(held[u])
        assert len(got[u]) == min(wanted, n_items - len(held[u]))
    ranks = negatives.candidate_ranks(drawn, slots, positives, items, of_users)
    for r in ranks.collect():
        u, score = r["user_id"], vectors @ taste[r["user_id"]]
        assert r["listed"] == len(got[u])
        assert r["rank"] == 1 + sum(score[i] > score[held[u][0]] for i in got[u])


def test_compressed_id_tables_are_not_broadcast_by_file_size(spark):
    """900,000 ids are some MB as a file and far more as a broadcast: they are joined by a shuffle, a small table still is broadcast."""
    from tonearm.session import materialize, tune

    tune(spark)
    plan = lambda n: rows.join(materialize(spark.range(n)), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    rows = materialize(spark.range(3_000_000).select((F.col("id") * 3).alias("id")))
    assert "BroadcastHashJoin" not in plan(900_000)
    assert "BroadcastHashJoin" in plan(1_000)
