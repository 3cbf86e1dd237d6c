"""Stored runs: marked runs only, repeated runs replace themselves, newest batch per user."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonearm.operators import history, rerank
from tonearm.sources import runs

ONE, TWO = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _recs(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, score double, rank int")


def _rows(df):
    return sorted((r["user_id"], r["rank"], r["item_id"]) for r in df.collect())


def test_runs(spark, tmp_path):
    path = str(tmp_path)
    assert runs.published(spark, path).count() == 0 and runs.read(spark, path, "items").count() == 0
    runs.publish(_recs(spark, [(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.5, 1)]), path, "a", ONE, "ItemKNN", "v1")
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 10), (1, 2, 11), (2, 1, 10)]
    # A repeated run replaces itself, rows that it no longer has included.
    runs.publish(_recs(spark, [(1, 12, 0.9, 1)]), path, "a", ONE, "ItemKNN", "v1", spark.createDataFrame([(1,), (2,)], "user_id bigint"))
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 12)]
    mark = runs.published(spark, path).first()
    assert (mark["n_batches"], mark["n_items"], mark["algorithm"]) == (2, 1, "ItemKNN")
    # A later run is the newest of its users only.
    runs.publish(_recs(spark, [(2, 20, 0.5, 1), (2, 21, 0.4, 2)]), path, "b", TWO, "ItemKNN", "v2")
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 12), (2, 1, 20), (2, 2, 21)]
    assert _rows(runs.newest_items(spark, path, top=1)) == [(1, 1, 12), (2, 1, 20)]
    assert runs.drop_replaced(spark, path, "2000-01-01") == 0
    assert runs.drop_replaced(spark, path, "2999-01-01") == 2
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 12), (2, 1, 20), (2, 2, 21)]


def test_a_run_that_dies_before_its_mark_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    runs.publish(_recs(spark, [(1, 10, 0.9, 1)]), path, "a", ONE, "ItemKNN", "v1")

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "mark", lost)
        for run_id in ("a", "b"):
            with pytest.raises(RuntimeError):
                runs.publish(_recs(spark, [(1, 99, 0.9, 1)]), path, run_id, TWO, "ItemKNN", "v1")
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 10)]
    runs.publish(_recs(spark, [(1, 99, 0.9, 1)]), path, "b", TWO, "ItemKNN", "v1")
    assert _rows(runs.newest_items(spark, path)) == [(1, 1, 99)]


def test_pages_read_published_batches(spark, tmp_path):
    path = str(tmp_path)
    runs.publish(_recs(spark, [(1, 10, 0.9, 1)]), path, "a", ONE, "ItemKNN", "v1")
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    played = spark.createDataFrame([(1, i) for i in range(12)], "user_id bigint, item_id bigint")
    due = lambda: {r["user_id"]: r["is_due"] for r in rerank.recalc_due(users, played, runs.read(spark, path, "batches")).collect()}
    assert due() == {1: 1, 2: 1}
    runs.publish(_recs(spark, [(1, 10, 0.9, 1)]), path, "b", TWO, "ItemKNN", "v1")
    assert due() == {1: 0, 2: 1}
    batches = runs.read(spark, path, "batches").withColumn("batch_id", F.concat("run_id", F.lit("-"), "user_id"))
    items = runs.read(spark, path, "items").withColumn("batch_id", F.concat("run_id", F.lit("-"), "user_id")).drop("user_id")
    titles = spark.createDataFrame([(10, "song")], "item_id bigint, title string")
    assert [r["batch_id"] for r in history.latest_batch_items(batches, items, titles).collect()] == ["b-1"]


def test_stored_runs_pick_seeds_once(spark, sf_dir, monkeypatch):
    """All published runs read one written table of seeds; picking them orders all positives."""
    from tonearm.plans import activity
    from tonearm.sources.fixtures import Tables

    read, publish = [], activity.runs.publish
    monkeypatch.setattr(activity.runs, "publish", lambda recs, *rest: read.append(sorted(rest[-1].inputFiles())) or publish(recs, *rest))
    activity._stored_runs(Tables(spark, sf_dir))
    assert len(read) == 3 and read[0] == read[1] == read[2] and all("/stored-picks-" in f for f in read[0])
