"""Daily challenges, experience and levels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import buckets, hashing
from . import ids
from .history import replay_flags

# Challenge types with their target ranges, and the play length
# and experience that count.
CHALLENGES = ((1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 1, 3), (5, 1, 3), (6, 1, 5))
PER_DAY = 3
LONG_PLAY = 120
XP_PER_CHALLENGE = 5
XP_TOP = buckets.LEVEL_XP[-1]


def local_day(ts: Column, zone: str = "Asia/Taipei") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def play_events(visible: DataFrame) -> DataFrame:
    """(user_id, ts, type) of plays that reach 120 seconds: listening, from a recommendation, again."""
    long_plays = replay_flags(visible).filter(F.col("watch_seconds") >= LONG_PLAY)
    types = F.array_compact(
        F.array(F.lit(1), F.when(F.col("source") == "RECOMMENDATION", 6), F.when(F.col("is_replay"), 4))
    )
    return long_plays.select("user_id", F.col("played_at").alias("ts"), F.explode(types).alias("type"))


def other_events(like_log: DataFrame, playlist_songs: DataFrame) -> DataFrame:
    """Likes (3), songs added to lists (2), and lists created (5: the first song of a list).

    A request that clears the current state doesn't count: of a pair's run of
    equal requests, every second one. A song that a list already holds is
    refused, so only its first addition counts.
    """
    placed = ids.run_places(like_log, ["user_id", "item_id"], ["ts", "event_id"], "intent", "place")
    likes = placed.filter("place % 2 = 1").select("user_id", "ts", F.lit(3).alias("type"))
    firsts = playlist_songs.groupBy("playlist_id", "user_id", "item_id").agg(F.min("added_at").alias("ts"))
    adds = firsts.select("user_id", "ts", F.lit(2).alias("type"))
    lists = firsts.groupBy("playlist_id", "user_id").agg(F.min("ts").alias("ts")).select("user_id", "ts", F.lit(5).alias("type"))
    return likes.unionByName(adds).unionByName(lists)


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", local_day(F.col("ts")).alias("day"), "type").agg(F.count(F.lit(1)).alias("n"))


def _offers(days: DataFrame, seed: int) -> DataFrame:
    """Every challenge type for every (user_id, day), with its draw order and target."""
    types = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for t, lo, hi in CHALLENGES])
    each = days.select("user_id", "day", F.explode(types).alias("c")).select("user_id", "day", "c.*")
    parts = (F.col("user_id"), F.date_format("day", "yyyyMMdd"), F.col("type"))
    target = F.col("lo") + F.pmod(hashing.uniform_int(*parts, f"n{seed}"), F.col("hi") - F.col("lo") + 1)
    return each.withColumns({"h": hashing.order_key(*parts, seed), "target": target.cast("int")}).drop("lo", "hi")


def day_rows(days: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """(user_id, day, offers, ns): per day of a user all types in draw order with their targets, and the counts of types 1 to 6."""
    offer = F.struct("h", "type", "target")
    drawn = F.transform(F.sort_array(F.collect_list(offer)), lambda o: F.struct(o["type"].alias("type"), o["target"].alias("target")))
    offers = _offers(days, seed).groupBy("user_id", "day").agg(drawn.alias("offers"))
    per_type = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).cast("bigint") for t, _, _ in CHALLENGES]
    told = counts.groupBy("user_id", "day").agg(F.array(*per_type).alias("ns"))
    none = F.array(*[F.lit(0).cast("bigint") for _ in CHALLENGES])
    return offers.join(told, ["user_id", "day"], "left").select("user_id", "day", "offers", F.coalesce("ns", none).alias("ns"))


def step(day: int, offers: list[tuple[int, int]], ns: list[int], last: int | None, open_: list[tuple[int, int]]) -> list[tuple]:
    """One day of a user: (type, target, carried, current_count, is_completed) of its three challenges.

    ``last`` and ``open_`` are the day before and what stayed unfinished on it.
    The calendar day after it goes on with these, from zero, and draws the rest
    among the other types; after a gap all three are drawn.
    """
    kept = open_ if last is not None and last == day - 1 else []
    held = {t for t, _ in kept}
    drawn = [o for o in offers if o[0] not in held][: PER_DAY - len(kept)]
    rows = []
    for carried, some in ((1, kept), (0, drawn)):
        for type_, target in some:
            n = min(ns[type_ - 1], target)
            rows.append((type_, target, carried, n, int(n >= target)))
    return rows


CHAIN = "user_id bigint, day date, type int, target int, carried int, current_count int, is_completed int"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Days come sorted by user and day; what is open passes from row to row."""
    user = last = None
    open_: list[tuple[int, int]] = []
    for batch in batches:
        out = []
        users, days, offers, ns = (batch.column(i).to_pylist() for i in range(4))
        for u, day, offer, n in zip(users, days, offers, ns):
            if u != user:
                user, last, open_ = u, None, []
            rows = step(day, [(o["type"], o["target"]) for o in offer], n, last, open_)
            last, open_ = day, [(r[0], r[1]) for r in rows if not r[4]]
            out += [(u, day, *r) for r in rows]
        types = [pa.int64(), *[pa.int32()] * 6]
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["user_id", "day", "type", "target", "carried", "current_count", "is_completed"])


def chain(days: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """Challenges of every (user_id, day) with their progress: a chain of days, each going on from the day before.

    ``days`` are the days on which a user asked, ``counts`` is (user_id, day,
    type, n).  A user has at most one row a day; a task folds its users one
    row at a time and holds the three open challenges only.
    """
    rows = day_rows(days, counts, seed).select(F.col("user_id").cast("bigint").alias("user_id"), F.unix_date("day").alias("day"), "offers", "ns")
    folded = rows.repartition("user_id").sortWithinPartitions("user_id", "day").mapInArrow(_fold, CHAIN.replace("day date", "day int"))
    return folded.withColumn("day", F.date_from_unix_date("day"))


def next_day(done: DataFrame, seed: int = 42) -> DataFrame:
    """Assignment of the following day: unfinished ones stay, finished ones are redrawn."""
    following = done.withColumn("day", F.date_add("day", 1))
    carried = following.filter("is_completed = 0").select("user_id", "day", "type", "target")
    need = following.groupBy("user_id", "day").agg(F.sum("is_completed").alias("need")).filter("need > 0")
    pool = _offers(need.select("user_id", "day"), seed).join(carried, ["user_id", "day", "type"], "left_anti")
    order = Window.partitionBy("user_id", "day").orderBy("h", "type")
    drawn = (
        pool.withColumn("rn", F.row_number().over(order))
        .join(need, ["user_id", "day"])
        .filter(F.col("rn") <= F.col("need"))
        .select("user_id", "day", "type", "target")
    )
    return carried.withColumn("carried", F.lit(1)).unionByName(drawn.withColumn("carried", F.lit(0)))


def xp_levels(done: DataFrame) -> DataFrame:
    """(user_id, xp, lv, xp_in_level, xp_for_level); experience stops at the top level."""
    per_user = done.groupBy("user_id").agg(F.sum("is_completed").alias("n_completed"))
    xp = F.least(F.col("n_completed") * XP_PER_CHALLENGE, F.lit(XP_TOP)).cast("int")
    leveled = per_user.withColumn("xp", xp)
    return leveled.select(
        "user_id",
        "xp",
        buckets.level(F.col("xp")).alias("lv"),
        (F.col("xp") - buckets.level_floor(F.col("xp"))).alias("xp_in_level"),
        buckets.level_span(F.col("xp")).alias("xp_for_level"),
    )
