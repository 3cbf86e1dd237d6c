"""The streaming jobs run over the event file to its end, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import challenges
from ..session import run_dir
from ..sources.fixtures import Tables
from ..streaming import jobs
from .activity import CHAIN_SQL, COUNTS, challenge_counts, challenge_days
from .registry import SQL, query


def _run(t: Tables, name: str, stream: DataFrame, mode: str = "update", shape=None) -> str:
    path = run_dir(t.spark, name)
    jobs.start(stream, path, mode, shape).awaitTermination()
    return path


def _run_all(t: Tables, **runs: tuple) -> list[str]:
    """Several streams side by side: one's driver work and short stages leave room for the others' tasks. (stream, mode, shape) by name, paths in that order."""
    paths, started = [run_dir(t.spark, name) for name in runs], []
    try:
        for path, run in zip(paths, runs.values()):
            started.append(jobs.start(run[0], path, *run[1:]))
        for stream in started:
            stream.awaitTermination()
    finally:
        for stream in started:
            stream.stop()
    return paths


def _source(t: Tables) -> jobs.StreamTables:
    return jobs.StreamTables(t.spark, t.sf_dir)


@query("stream_play_quality", SQL["event_quality"])
def _(t):
    path = _run(t, "quality", jobs.play_quality(_source(t)), "append")
    accepted, rejected = jobs.split_quality(t.spark, path)
    return accepted.unionByName(rejected).select("event_id", "error_code")


@query("stream_play_length", SQL["play_length_final"])
def _(t):
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    updates = _source(t).events.select(key.alias("history_id"), F.col("seconds").alias("watch_seconds"))
    return jobs.current(t.spark, _run(t, "length", jobs.final_play_length(updates)), ["history_id"])


def _like_state(t: Tables) -> DataFrame:
    path = _run(t, "likes", _source(t).like_log, "append", jobs.like_runs)
    return jobs.like_state(t.spark, path)


@query("stream_like_state", SQL["like_state"])
def _(t):
    return _like_state(t)


@query("stream_affinity", SQL["affinity_scores"])
def _(t):
    signals = jobs.current(t.spark, _run(t, "signals", jobs.play_signals(_source(t))), ["user_id", "item_id"])
    return jobs.affinity_view(signals, _like_state(t))


@query("stream_challenge_counts", f"WITH {COUNTS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, type, n FROM cn")
def _(t):
    paths = _run_all(
        t, counts=(jobs.challenge_counts(_source(t)), "update"), firsts=(jobs.first_plays(_source(t)), "update"),
        adds=(jobs.first_adds(_source(t)), "update"), like_days=(jobs.once_each(_source(t).like_log), "append", jobs.like_days),
    )
    keys = (["user_id", "day", "type"], ["user_id", "item_id"], ["playlist_id", "user_id", "item_id"])
    counts, firsts, adds = (jobs.current(t.spark, path, key) for path, key in zip(paths, keys))
    likes = jobs.written(t.spark, paths[3])
    return jobs.challenge_view(counts, firsts, adds, jobs.like_counts(likes))


@query("stream_challenge_progress", CHAIN_SQL)
def _(t):
    """The days are written once they are closed and read as a stream of files."""
    closed = run_dir(t.spark, "closed-days")
    challenges.day_rows(challenge_days(t), challenge_counts(t)).write.parquet(closed)
    days = t.spark.readStream.schema(t.spark.read.parquet(closed).schema).parquet(closed)
    return jobs.written(t.spark, _run(t, "chain", jobs.challenge_chain(days))).drop("batch_id")


@query(
    "stream_now_playing",
    """WITH l AS (SELECT user_id AS friend_id, item_id, played_at FROM vis QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, id DESC) = 1)
       SELECT e.user_id, friend_id, item_id, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at FROM edges e JOIN l USING (friend_id)""",
)
def _(t):
    playing = jobs.current(t.spark, _run(t, "playing", jobs.now_playing(_source(t))), ["friend_id"])
    return jobs.friends_view(playing, t.friendships)
