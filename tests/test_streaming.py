"""Streams over several files, with late and repeated rows, against sequential results."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonearm.operators import challenges
from tonearm.schemas import EVENTS
from tonearm.streaming import jobs

from .test_golden import toggle


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Five files of events; one pair takes a third of the like requests."""
    folder = tmp_path_factory.mktemp("events")
    rng, start, files, number = random.Random(3), datetime(2024, 1, 1), [], 0
    for part in range(5):
        rows = []
        for _ in range(60):
            hot = rng.random() < 0.33
            user, item = (1, 4) if hot else (rng.randrange(6), rng.randrange(8))
            kind = rng.choice(["purchase", "error"]) if hot else rng.choice(["view", "click", "purchase", "error", "signup"])
            rows.append((number, start + timedelta(minutes=number * 13), user, kind, float(rng.randrange(300)), f'{{"k": {item}}}'))
            number += 1
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in{part}")
        files.append(rows)
    return folder, files


def run(spark, sf_dir, event_files, tmp_path, build, mode, shape=None):
    t = jobs.StreamTables(spark, sf_dir, f"{event_files[0]}/in*", "*.parquet", files_per_batch=1)
    query = jobs.start(build(t), str(tmp_path), mode, shape)
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_like_state_over_batches(spark, sf_dir, event_files, tmp_path):
    run(spark, sf_dir, event_files, tmp_path, lambda t: t.like_log, "append", jobs.like_runs)
    batches = jobs.written(spark, str(tmp_path)).select("batch_id").distinct().count()
    assert batches == 5
    requests = defaultdict(list)
    for row in sum(event_files[1], []):
        if row[3] in ("purchase", "error"):
            requests[(row[2], int(row[5][6:-1]))].append(row[3] == "purchase")
    got = {(r["user_id"], r["item_id"]): r["state"] for r in jobs.like_state(spark, str(tmp_path)).collect()}
    assert got == {pair: toggle(wanted) for pair, wanted in requests.items()}


def test_counted_likes_over_batches(spark, sf_dir, event_files, tmp_path):
    run(spark, sf_dir, event_files, tmp_path, lambda t: jobs.once_each(t.like_log, "90 days"), "append", jobs.like_days)
    state, want = {}, defaultdict(int)
    for row in sum(event_files[1], []):
        if row[3] in ("purchase", "error"):
            pair, wanted = (row[2], int(row[5][6:-1])), row[3] == "purchase"
            if state.get(pair) is wanted:
                state[pair] = None
            else:
                state[pair] = wanted
                want[row[2], (row[1] + timedelta(hours=8)).date()] += 1
    got = {(r["user_id"], r["day"]): r["n"] for r in jobs.like_counts(jobs.written(spark, str(tmp_path))).collect()}
    assert got == dict(want)


def test_play_length_never_shrinks(spark, sf_dir, event_files, tmp_path):
    build = lambda t: jobs.final_play_length(t.events.select(F.col("item_id").alias("history_id"), F.col("seconds").alias("watch_seconds")))
    run(spark, sf_dir, event_files, tmp_path, build, "update")
    want = defaultdict(int)
    for row in sum(event_files[1], []):
        item = int(row[5][6:-1])
        want[item] = max(want[item], int(row[4]))
    got = {r["history_id"]: r["watch_seconds"] for r in jobs.current(spark, str(tmp_path), ["history_id"]).collect()}
    assert got == dict(want)


def test_now_playing(spark, sf_dir, event_files, tmp_path):
    run(spark, sf_dir, event_files, tmp_path, jobs.now_playing, "update")
    want = {}
    for row in sum(event_files[1], []):
        if not (row[3] == "error" and row[4] < 20):
            want[row[2]] = int(row[5][6:-1])
    got = {r["friend_id"]: r["item_id"] for r in jobs.current(spark, str(tmp_path), ["friend_id"]).collect()}
    assert got == want


def test_repeated_and_late_events(spark, sf_dir, tmp_path):
    base = datetime(2024, 3, 1)
    event = lambda n, ts: (n, ts, 1, "click", 130.0, '{"k": 1}')
    # A batch drops by the watermark of the batch before it, so the late row comes third.
    parts = [
        [event(1, base), event(1, base), event(2, base + timedelta(days=9))],
        [event(4, base + timedelta(days=9))],
        [event(3, base - timedelta(days=1)), event(5, base + timedelta(days=8))],
    ]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    t = jobs.StreamTables(spark, sf_dir, f"{tmp_path}/in*", "*.parquet", files_per_batch=1)
    query = jobs.start(jobs.challenge_counts(t), f"{tmp_path}/out", "update")
    query.awaitTermination()
    got = {str(r["day"]): r["n"] for r in jobs.current(spark, f"{tmp_path}/out", ["user_id", "day", "type"]).collect()}
    assert got == {"2024-03-01": 1, "2024-03-09": 1, "2024-03-10": 2}
    assert sum(x["dropped"] for x in jobs.lateness_report(query)) >= 1


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    batch = spark.sql("SELECT 1L AS k, 2 AS v")
    for _ in range(2):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/data/batch_id=0")
    assert jobs.written(spark, str(tmp_path)).count() == 1


def chain_by_hand(rows):
    """Plain fold over (user, day, offers, counts)."""
    out, state = [], {}
    for user, day, offers, ns in sorted(rows, key=lambda r: (r[0], r[1])):
        last, kept = state.get(user, (None, []))
        kept = kept if last == day - 1 else []
        today = [(t, n, 1) for t, n in kept]
        for t, n in offers:
            if len(today) < 3 and t not in [x[0] for x in kept]:
                today.append((t, n, 0))
        state[user] = (day, [(t, n) for t, n, _ in today if ns[t - 1] < n])
        out += [(user, day, t, n, c, min(n, ns[t - 1]), int(ns[t - 1] >= n)) for t, n, c in today]
    return sorted(out)


def test_challenges_go_on_from_day_to_day(spark, tmp_path):
    """Batch, and a stream of one file a day whose state passes on; gaps, repetitions and finished days."""
    rng = random.Random(6)
    rows = []
    for user in range(40):
        for day in range(19_700, 19_712):
            if rng.random() < 0.8:
                offers = [(t, rng.randint(1, 4)) for t in rng.sample(range(1, 7), 6)]
                rows.append((user, day, offers, [rng.randrange(4) for _ in range(6)]))
    schema = "user_id bigint, number int, offers array<struct<type:int,target:int>>, ns array<bigint>"
    table = lambda some: spark.createDataFrame(some, schema).select("user_id", F.date_from_unix_date("number").alias("day"), "offers", "ns")
    want = chain_by_hand(rows)
    number = F.unix_date("day")
    as_rows = lambda df: sorted(tuple(r) for r in df.select("user_id", number, "type", "target", "carried", "current_count", "is_completed").collect())
    packed = table(rows).select("user_id", number.alias("day"), "offers", "ns").repartition(3).repartition("user_id").sortWithinPartitions("user_id", "day")
    folded = packed.mapInArrow(challenges._fold, challenges.CHAIN.replace("day date", "day int"))
    assert as_rows(folded.withColumn("day", F.date_from_unix_date("day"))) == want

    folder = tmp_path / "in"
    stream = spark.readStream.schema(table(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    for day in range(19_700, 19_712):
        table([r for r in rows if r[1] == day] + [r for r in rows if r[1] == day - 1 and r[0] < 3]).coalesce(1).write.parquet(f"{folder}/{day}")
        if day in (19_704, 19_711):  # stopped and started again in between
            jobs.start(jobs.challenge_chain(stream), f"{tmp_path}/out", "update").awaitTermination()
    assert as_rows(jobs.written(spark, f"{tmp_path}/out")) == want
