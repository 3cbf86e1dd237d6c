"""Split invariants and metrics on small fixtures."""

from __future__ import annotations

import hashlib
import math
import threading

import pytest

from tonearm.operators import ids, metrics, splits


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(u, i, int((u * 7 + i * 3) % 4 != 0)) for u in range(30) for i in range(u % 9 + 1)]
    # One user holds a third of all rows.
    rows += [(500, i, 1) for i in range(70)] + [(500, i, 0) for i in range(70, 80)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int")


def pairs(df):
    return {(r["user_id"], r["item_id"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_seed_split(labelled, n):
    train, test = splits.seed_n(labelled, n)
    pos, neg = pairs(labelled.filter("target = 1")), pairs(labelled.filter("target = 0"))
    count = lambda rows, u: sum(1 for x, _ in rows if x == u)
    users = {u for u, _ in pos if count(pos, u) > n}
    seeds, held = pairs(train.filter("target = 1")), pairs(test)
    assert all(count(seeds, u) == n for u in users) and {u for u, _ in seeds} == users
    assert not seeds & held and seeds | held == {p for p in pos if p[0] in users}
    assert pairs(train.filter("target = 0")) == {p for p in neg if p[0] in users}


def test_leave_one_out(labelled):
    pos = labelled.filter("target = 1").select("user_id", "item_id")
    test = pairs(splits.leave_one_out(pos))
    everyone = pairs(pos)
    assert test <= everyone
    assert len({u for u, _ in test}) == len(test) == sum(1 for u in {u for u, _ in everyone} if sum(x == u for x, _ in everyone) >= 2)
    train, test_rows = splits.leave_one_out_rows(labelled)
    assert not pairs(train) & pairs(test_rows)


def test_held_out_users(labelled):
    train, test = splits.held_out_users(labelled, 5)
    train_users, test_users = {u for u, _ in pairs(train)}, {u for u, _ in pairs(test)}
    assert not train_users & test_users
    assert {i for _, i in pairs(test)} <= {i for _, i in pairs(train)}
    with pytest.raises(ValueError):
        splits.held_out_users(labelled, 10**6)


def test_dense_ids_and_running_sum(spark):
    words = [(f"w{i % 97:03d}",) for i in range(500)]
    got = {r["w"]: r["id"] for r in ids.dense_ids(spark.createDataFrame(words, "w string"), "w", "id", start=1).collect()}
    assert got == {w: n + 1 for n, w in enumerate(sorted({w for (w,) in words}))}
    values = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(values, "i bigint, v bigint")
    from pyspark.sql import functions as F

    rows = ids.running_sum(df, [F.desc("v"), F.col("i")], "v", "cum", "rk").orderBy("rk").collect()
    total = 0
    for n, (i, v) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])), start=1):
        total += v
        assert (rows[n - 1]["i"], rows[n - 1]["cum"], rows[n - 1]["rk"]) == (i, total, n)


def test_multi_truth_metrics(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "user_id bigint, item_id bigint, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 13), (2, 99), (3, 10)], "user_id bigint, item_id bigint")
    row = metrics.multi_truth_metrics(recs, truth, ks=(2,)).first()
    ideal = 1 + 1 / math.log2(3)
    assert row["users_evaluated"] == 2
    assert (row["recall"], row["precision"]) == (0.25, 0.25)
    assert row["ndcg"] == round((1 / math.log2(3)) / ideal / 2, 5)
    everyone = metrics.multi_truth_metrics(recs, truth, ks=(2,), users=truth).first()
    assert everyone["users_evaluated"] == 3 and everyone["recall"] == round(0.5 / 3, 5)


def test_loo_metrics_skip_unknown_items(spark):
    test = spark.createDataFrame([(1, 10), (2, 11), (3, 77)], "user_id bigint, item_id bigint")
    recs = spark.createDataFrame([(1, 9, 1), (1, 10, 2)], "user_id bigint, item_id bigint, rank int")
    known = spark.createDataFrame([(10,), (11,)], "item_id bigint")
    row = metrics.loo_metrics(test, recs, known, ks=(10,)).first()
    assert (row["users_evaluated"], row["recall"], row["precision"]) == (2, 0.5, 0.05)
    assert row["ndcg"] == round(1 / math.log2(3) / 2, 5)


def test_splits_are_written_once_for_all_reports(spark, sf_dir):
    """Models and reports read one written split; it is not worked out again by each of them."""
    from tonearm.plans import evaluate, recommend
    from tonearm.sources.fixtures import Tables

    t = Tables(spark, sf_dir)
    files = lambda df: sorted(df.inputFiles())
    for build in (lambda: evaluate.seed_pairs(t, 3)[0], lambda: evaluate.seed_pairs(t, 3)[1], lambda: evaluate.loo(t)[0], lambda: evaluate.loo(t)[1], lambda: recommend.picks(t)):
        first = files(build())
        assert first == files(build()) and not any(f.startswith(f"file://{sf_dir}") for f in first)
    train, test = evaluate.seed_split(t, 3)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "item_id").collect()))
    assert [rows(x) for x in evaluate.seed_pairs(t, 3)] == [rows(train.filter("target = 1")), rows(test)]


def test_seed_splits_are_read_from_one_order(spark):
    """Seeds and test pairs of every size come from one written order; null and repeated rows as in a split of its own."""
    rows = [(u, i, 1) for u in range(12) for i in range(u)] + [(3, 90, 0), (500, 1, 0), (None, 4, 1), (None, 5, 1), (11, None, 1), (7, 2, 1)]
    rows += [(500, i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int")
    first = splits.first_positives(df, 5)
    placed = splits.placed_positives(df, first)
    key = lambda u, i: (hashlib.md5("-".join(str(x) for x in (u, i, 42) if x is not None).encode()).hexdigest(), -1 if i is None else i)
    for n in (1, 3, 5):
        seeds, test = [], []
        for u in sorted({u for u, _, x in rows if u is not None and x == 1}):
            held = sorted((i for v, i, x in rows if v == u and x == 1), key=lambda i: key(u, i))
            if len(held) > n:
                seeds += [(u, i) for i in held[:n]]
                test += [(u, i) for i in held if i is None or i not in held[:n]]
        got = splits.seeds_and_test(first, placed, n)
        order = lambda found: sorted(found, key=str)
        assert [order((r["user_id"], r["item_id"]) for r in x.collect()) for x in got] == [order(seeds), order(test)]


def test_all_seed_splits_share_their_tables(spark, sf_dir):
    """The hash order of all positives is worked out once, not once for every split and side."""
    from tonearm.plans import evaluate
    from tonearm.sources.fixtures import Tables

    t = Tables(spark, sf_dir)
    one, five = evaluate.seed_pairs(t, 1), evaluate.seed_pairs(t, 5)
    assert [sorted(a.inputFiles()) for a in one] == [sorted(b.inputFiles()) for b in five]
    assert [sorted(x.inputFiles()) for x in evaluate.held_out(t)] == [sorted(x.inputFiles()) for x in evaluate.held_out(t)]


def test_metrics_of_a_list_for_all_users(spark):
    """A list that all users share meets only the truths among its items; the figures are those of the whole join."""
    truth = spark.createDataFrame([(u, i) for u in range(20) for i in range(u % 4, 9 + u % 3)], "user_id bigint, item_id bigint")
    top = metrics.popular(truth.filter("user_id % 2 = 0"), 4)
    users = truth.select("user_id").distinct()
    recs = metrics.popularity_recs(users, truth.filter("user_id % 2 = 0"), 4)
    assert sorted(recs.collect()) == sorted(metrics.repeated(users, top).collect())
    whole = metrics.multi_truth_metrics(recs, truth, ks=(2, 4))
    few = metrics.multi_truth_metrics(recs, truth, ks=(2, 4), users=recs.filter("rank = 1"), listed=top)
    assert sorted(whole.collect()) == sorted(few.collect()) and whole.first()["recall"] > 0


def test_independent_runs_are_made_side_by_side(spark):
    """Two builds wait for each other, which only ends when both are under way; results keep the order of the builds, a failure is raised."""
    from tonearm.session import side_by_side

    both = threading.Barrier(2, timeout=60)

    def build(n):
        both.wait()
        return spark.range(n)

    assert [x.count() for x in side_by_side(spark, [lambda: build(3), lambda: build(5)])] == [3, 5]
    with pytest.raises(ValueError):
        side_by_side(spark, [lambda: spark.range(1), lambda: int("x")])
