"""Structured Streaming jobs over the site's event log.

Every job writes what a micro-batch changed into its own folder of a table
(``batch_id=N``); a repeated batch replaces its folder, so a restart after a
lost executor or driver leaves the same table. ``current`` reads the newest
row of each key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import affinity, challenges, cleaning, history, ids
from ..schemas import EVENTS
from ..sources.fixtures import SOURCES, Tables

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class StreamTables(Tables):
    """The site's event views, fed by a stream of event files; everything else stays static."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None, glob: str = "events.parquet", files_per_batch: int | None = None):
        super().__init__(spark, sf_dir)
        self.folder, self.glob, self.files_per_batch = folder or sf_dir, glob, files_per_batch

    def raw(self, name: str) -> DataFrame:
        if name == "events":
            return read_events(self.spark, self.folder, self.glob, self.files_per_batch)
        return super().raw(name)


def start(stream: DataFrame, path: str, mode: str = "append", shape: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Run ``stream`` into the batch folders of ``path``; ``shape`` is applied to each batch first."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row of every key."""
    rows = written(spark, path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*rest), "batch_id").alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, "v.*")


# --- play requests ------------------------------------------------------------


def play_quality(t: Tables) -> DataFrame:
    """Requests with their error code; join the static catalogue, keep no state."""
    return cleaning.play_quality(t.play_requests, t.catalogue, list(SOURCES.values()))


def split_quality(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests of the written table."""
    rows = written(spark, path)
    return rows.filter("error_code is null"), rows.filter("error_code is not null")


# --- play length -----------------------------------------------------------------


def final_play_length(updates: DataFrame) -> DataFrame:
    """Running maximum per play; late or smaller reports change nothing. Update mode."""
    return history.final_play_length(updates)


# --- likes --------------------------------------------------------------------------


def like_runs(batch: DataFrame) -> DataFrame:
    """What a batch's like requests do to each pair: the last run, and whether it starts within the batch.

    One small row per pair, from aggregates: a pair with a third of the
    events is never gathered in one task.
    """
    order = F.struct("ts", "event_id")
    last = batch.groupBy("user_id", "item_id").agg(
        F.max(F.when(F.col("intent"), order)).alias("like"), F.max(F.when(~F.col("intent"), order)).alias("dislike")
    )
    final = F.col("dislike").isNull() | F.coalesce(F.col("like") > F.col("dislike"), F.lit(False))
    bounds = last.select(
        "user_id", "item_id", final.alias("final"), F.when(final, F.col("dislike")).otherwise(F.col("like")).alias("after")
    )
    run = batch.join(bounds, ["user_id", "item_id"]).filter(F.col("after").isNull() | (order > F.col("after")))
    return run.groupBy("user_id", "item_id", "final").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("after").isNotNull()).alias("cut")
    )


def like_state(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, state) from the written runs.

    A pair's last run reaches back over its batches until the request changes,
    so its length is the sum of the runs after the last break.
    """
    runs = written(spark, path)
    last = runs.groupBy("user_id", "item_id").agg(F.max_by("final", "batch_id").alias("last_final"))
    joined = runs.join(last, ["user_id", "item_id"])
    other = F.col("final") != F.col("last_final")
    # Batches up to the last opposite run do not count; a run cut inside its batch starts there.
    stop = joined.groupBy("user_id", "item_id").agg(
        F.max(F.when(other, F.col("batch_id") + 1).when(F.col("cut"), F.col("batch_id"))).alias("from_batch")
    )
    tail = joined.join(stop, ["user_id", "item_id"]).filter(
        F.col("from_batch").isNull() | (F.col("batch_id") >= F.col("from_batch"))
    )
    return tail.groupBy("user_id", "item_id", "last_final").agg(F.sum("n").alias("n")).select(
        "user_id", "item_id", F.when(F.col("n") % 2 == 1, F.col("last_final")).alias("state")
    )


# --- affinity -------------------------------------------------------------------------


def play_signals(t: Tables, archive: str = "archive") -> DataFrame:
    """Running seconds, skips and favourite flag per pair, in one streaming aggregate. Update mode."""
    skip = F.col("seconds") < affinity.SKIP_SECONDS
    saved = (F.col("event_type") == "signup") & (F.col("playlist_name") == archive)
    return t.events.groupBy("user_id", "item_id").agg(
        F.sum(F.when(skip, 0).otherwise(F.col("seconds"))).alias("total_watch_seconds"),
        F.count_if(skip).alias("skip_count"),
        F.bool_or(saved).alias("is_favorited"),
    )


def affinity_view(signals: DataFrame, likes: DataFrame) -> DataFrame:
    """Scores of the running signals together with the current like states."""
    state = F.when(F.col("state").isNull(), 0).when(F.col("state"), 1).otherwise(-1)
    joined = signals.join(likes, ["user_id", "item_id"], "left").withColumn("like_state", state)
    score = affinity.score(F.col("total_watch_seconds"), F.col("skip_count"), F.col("is_favorited"), F.col("like_state"))
    return joined.drop("state").withColumn("score", F.round(score, 6))


# --- challenges -----------------------------------------------------------------------


def challenge_counts(t: Tables, lateness: str = "2 days") -> DataFrame:
    """Daily counts of long plays (1) and recommended plays (6). Update mode.

    The day window starts at 16:00 UTC, which is midnight at UTC+8; an event
    delivered twice within the watermark counts once.
    """
    visible_long = ~F.col("is_hidden") & (F.col("seconds") >= challenges.LONG_PLAY)
    types = F.array_compact(
        F.array(
            F.when(visible_long, 1),
            F.when(visible_long & (F.col("event_type") == "view"), 6),
        )
    )
    day = F.window("ts", "1 day", startTime="16 hours")
    return (
        t.events.withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
        .select("user_id", "ts", F.explode(types).alias("type"))
        .groupBy("user_id", "type", day.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", "type", F.to_date(F.col("w.end")).alias("day"), "n")
    )


def first_plays(t: Tables) -> DataFrame:
    """First visible play of each (user, song), and its length; earlier late arrivals replace it. Update mode."""
    row = F.struct("played_at", "watch_seconds")
    return t.visible.groupBy("user_id", "item_id").agg(F.min_by(row, F.struct("played_at", "id")).alias("first"))


def first_adds(t: Tables) -> DataFrame:
    """First addition of each song to each list; repeated ones change nothing. Update mode."""
    return t.playlist_songs.groupBy("playlist_id", "user_id", "item_id").agg(F.min("added_at").alias("ts"))


def once_each(log: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The requests of a log; one delivered twice within the watermark counts once."""
    return log.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def like_days(batch: DataFrame) -> DataFrame:
    """What a batch's like requests may add to the count of each (pair, day).

    A request counts at an odd place of its run. Places in the pair's first
    run of the batch depend on what came before, so odd and even ones are kept
    apart; ``n_rest`` are the odd ones of later runs.
    """
    keys, order = ["user_id", "item_id"], F.struct("ts", "event_id")
    placed = ids.run_places(batch, keys, ["ts", "event_id"], "intent", "place")
    pairs = placed.groupBy(*keys).agg(
        F.min_by("intent", order).alias("first"), F.max_by("intent", order).alias("last"), F.max_by("place", order).alias("length"),
        F.min(F.when(F.col("intent"), order)).alias("like"), F.min(F.when(~F.col("intent"), order)).alias("dislike"),
    )
    cut = F.when(F.col("like").isNotNull() & F.col("dislike").isNotNull(), F.greatest("like", "dislike"))
    pairs = pairs.select(*keys, "first", "last", "length", cut.alias("cut"))
    leads, odd = F.col("cut").isNull() | (order < F.col("cut")), F.col("place") % 2 == 1
    per_day = [*keys, challenges.local_day(F.col("ts")).alias("day"), "first", "last", "length", F.col("cut").isNull().alias("single")]
    return placed.join(pairs, keys).groupBy(*per_day).agg(
        F.count_if(leads & odd).alias("n_odd"), F.count_if(leads & ~odd).alias("n_even"), F.count_if(~leads & odd).alias("n_rest")
    )


def like_counts(days: DataFrame) -> DataFrame:
    """(user_id, day, n) of likes that count, from the written rows of ``like_days``.

    Per pair and batch there is one small row; the run that a batch continues
    is as long as the batches' last runs since it began.
    """
    keys = ["user_id", "item_id"]
    by_batch = Window.partitionBy(*keys).orderBy("batch_id")
    pairs = days.select(*keys, "batch_id", "first", "last", "length", "single").distinct()
    goes_on = F.coalesce(F.lag("last").over(by_batch) == F.col("first"), F.lit(False))
    pairs = pairs.withColumn("goes_on", goes_on)
    run = F.count_if(~F.col("single") | ~F.col("goes_on")).over(by_batch.rowsBetween(Window.unboundedPreceding, 0))
    in_run = Window.partitionBy(*keys, "run").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = pairs.withColumn("run", run).withColumn("end", F.sum("length").over(in_run))
    before = F.when(F.col("goes_on"), F.lag("end").over(by_batch)).otherwise(0)
    carried = ends.withColumn("before", before).select(*keys, "batch_id", "before")
    n = F.col("n_rest") + F.when(F.col("before") % 2 == 1, F.col("n_even")).otherwise(F.col("n_odd"))
    return days.join(carried, [*keys, "batch_id"]).groupBy("user_id", "day").agg(F.sum(n).alias("n")).filter("n > 0")


def challenge_view(counts: DataFrame, firsts: DataFrame, adds: DataFrame, likes: DataFrame) -> DataFrame:
    """All six counts: likes (3) from ``like_counts``, additions (2) and new lists (5) from first additions, replays (4) are long plays that are not first plays."""
    lists = adds.groupBy("playlist_id", "user_id").agg(F.min("ts").alias("ts"))
    daily = lambda rows: rows.groupBy("user_id", challenges.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    new_songs, new_lists = daily(adds), daily(lists)
    long_first = (
        firsts.filter(F.col("first.watch_seconds") >= challenges.LONG_PLAY)
        .groupBy("user_id", challenges.local_day(F.col("first.played_at")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n_first"))
    )
    long_plays = counts.filter("type = 1").select("user_id", "day", "n")
    replays = long_plays.join(long_first, ["user_id", "day"], "left").select(
        "user_id", "day", F.lit(4).alias("type"), (F.col("n") - F.coalesce("n_first", F.lit(0))).alias("n")
    )
    return (
        counts.select("user_id", "day", "type", "n")
        .unionByName(replays.filter("n > 0"))
        .unionByName(new_songs.select("user_id", "day", F.lit(2).alias("type"), "n"))
        .unionByName(new_lists.select("user_id", "day", F.lit(5).alias("type"), "n"))
        .unionByName(likes.select("user_id", "day", F.lit(3).alias("type"), "n"))
    )


def fold_days(key, batches, state):
    """The new days of a user, from lists of a day's numbers (``packed``), and what stays open in the state."""
    if state.hasTimedOut:
        state.remove()
        return
    n_types = len(challenges.CHALLENGES)
    last, types, targets = state.get if state.exists else (None, [], [])
    open_, out = list(zip(types, targets)), []
    rows = sorted((r.tolist() for b in batches for r in b["packed"]), key=lambda r: r[0])
    for number, *told in rows:
        if last is not None and number <= last:
            continue
        offers = list(zip(told[n_types::2], told[n_types + 1 :: 2]))
        made = challenges.step(number, offers, told[:n_types], last, open_)
        last, open_ = number, [(r[0], r[1]) for r in made if not r[4]]
        out += [(key[0], last, *r) for r in made]
    state.update((last, [t for t, _ in open_], [n for _, n in open_]))
    state.setTimeoutTimestamp(max((last + 2) * 86_400_000, state.getCurrentWatermarkMs() + 1))
    names = ["user_id", "day", "type", "target", "carried", "current_count", "is_completed"]
    # A user is a group of a few rows: columns from one array, as casts of a frame cost more than the fold.
    values = np.array(out, np.int64).reshape(-1, len(names))
    yield pd.DataFrame({c: values[:, i].astype(np.int64 if c == "user_id" else np.int32) for i, c in enumerate(names)})


def challenge_chain(days: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Challenges day by day from a stream of closed days, as ``challenges.day_rows`` makes them. Update mode.

    The state of a user is the last day and what stayed open on it.  Days of a
    user come in order; one that is not after the last is a repetition and
    changes nothing.  The state ends ``keep_days`` days after the last one by the
    watermark, when nothing can be carried over any more.
    """
    # A day's numbers travel as one list: its number, the counts, then types and targets in turn.
    long = lambda a: a.cast("array<bigint>")
    drawn = F.flatten(F.transform("offers", lambda o: F.array(o["type"], o["target"])))
    packed = F.concat(F.array(F.unix_date("day").cast("bigint")), long(F.col("ns")), long(drawn))
    rows = days.withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", lateness).select(
        F.col("user_id").cast("bigint").alias("user_id"), "at", packed.alias("packed")
    )
    schema = challenges.CHAIN.replace("day date", "day int")
    made = rows.groupBy("user_id").applyInPandasWithState(
        fold_days, schema, "last int, types array<int>, targets array<int>", "update", GroupStateTimeout.EventTimeTimeout
    )
    return made.withColumn("day", F.date_from_unix_date("day"))


# --- now playing -----------------------------------------------------------------------


def now_playing(t: Tables) -> DataFrame:
    """Latest visible play of each user. Update mode."""
    last = F.max_by(F.struct("item_id", "played_at"), F.struct("played_at", "id")).alias("last")
    return t.visible.groupBy(F.col("user_id").alias("friend_id")).agg(last).select("friend_id", "last.*")


def friends_view(playing: DataFrame, friendships: DataFrame) -> DataFrame:
    return friendships.join(playing, "friend_id")


def lateness_report(query: StreamingQuery) -> list[dict]:
    """Rows each batch dropped as too late, from the query's progress."""
    return [
        {"batch_id": p["batchId"], "dropped": sum(o.get("numRowsDroppedByWatermark", 0) for o in p["stateOperators"])}
        for p in query.recentProgress
    ]
