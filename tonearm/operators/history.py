"""Play history, likes, favourites and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_plays(visible: DataFrame) -> DataFrame:
    """The last play of every (user, song)."""
    last = F.max_by(F.struct("id", "played_at", "watch_seconds", "source"), F.struct("played_at", "id")).alias("last")
    return visible.groupBy("user_id", "item_id").agg(last).select("user_id", "item_id", "last.*")


def recent_history(
    visible: DataFrame, song: int | None = None, source: str | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    """Newest-first page of latest plays with the total of the whole list; at most 50 rows."""
    rows = visible
    if song is not None:
        rows = rows.filter(F.col("item_id") == song)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    plays = latest_plays(rows)
    page = plays.orderBy(F.desc("played_at"), F.desc("id")).offset(offset).limit(min(limit, 50))
    return page.withColumn("total", plays.agg(F.count(F.lit(1))).scalar())


def replay_flags(visible: DataFrame) -> DataFrame:
    """Plays with ``is_replay``: an earlier visible play of the same song exists.

    An earlier play exists exactly when the play is not the pair's first, so a
    pair's plays are compared with one aggregate, never ordered in one task.
    """
    order = F.struct("played_at", "id")
    first = visible.groupBy("user_id", "item_id").agg(F.min(order).alias("first"))
    return visible.join(first, ["user_id", "item_id"]).withColumn("is_replay", order > F.col("first")).drop("first")


def final_play_length(updates: DataFrame) -> DataFrame:
    """Longest reported length of each play; smaller late reports change nothing."""
    return updates.groupBy("history_id").agg(F.max("watch_seconds").alias("watch_seconds"))


def like_state(log: DataFrame) -> DataFrame:
    """(user_id, item_id, state): result of a row of like/dislike toggles, null when cleared.

    Asking for the current state clears it, asking for the other sets it. So
    the end state depends on the last run of equal requests: odd length means
    that request holds, even length means cleared. Runs are counted with
    aggregates only.
    """
    order = F.struct("ts", "event_id")
    last = log.groupBy("user_id", "item_id").agg(
        F.max(F.when(F.col("intent"), order)).alias("last_like"), F.max(F.when(~F.col("intent"), order)).alias("last_dislike")
    )
    ends_liked = F.col("last_dislike").isNull() | F.coalesce(F.col("last_like") > F.col("last_dislike"), F.lit(False))
    bounds = last.select(
        "user_id", "item_id", ends_liked.alias("final"), F.when(ends_liked, F.col("last_dislike")).otherwise(F.col("last_like")).alias("after")
    )
    run = log.join(bounds, ["user_id", "item_id"]).filter(F.col("after").isNull() | (order > F.col("after")))
    return run.groupBy("user_id", "item_id", "final").agg((F.count(F.lit(1)) % 2).alias("odd")).select(
        "user_id", "item_id", F.when(F.col("odd") == 1, F.col("final")).alias("state")
    )


def current_likes(log: DataFrame) -> DataFrame:
    return like_state(log).filter("state is not null").withColumnRenamed("state", "is_liked")


def favorites(playlist_songs: DataFrame, archive: str = "archive") -> DataFrame:
    """(user_id, item_id, added_at) of the reserved playlist, one row per song; adding it again keeps the first date."""
    kept = playlist_songs.filter(F.lower(F.trim("playlist_name")) == archive)
    return kept.groupBy("user_id", "item_id").agg(F.min("added_at").alias("added_at"))


def favorites_list(playlist_songs: DataFrame, catalogue: DataFrame) -> DataFrame:
    return favorites(playlist_songs).join(catalogue, "item_id")


def favorite_flag(songs: DataFrame, favs: DataFrame) -> DataFrame:
    """Song rows of users with ``is_favorited``."""
    marked = favs.select("user_id", "item_id").distinct().withColumn("is_favorited", F.lit(True))
    return songs.join(marked, ["user_id", "item_id"], "left").fillna(False, ["is_favorited"])


def playlist_counts(playlists: DataFrame, playlist_songs: DataFrame, archive: str = "archive") -> DataFrame:
    counts = playlist_songs.select("playlist_id", "item_id").distinct().groupBy("playlist_id").agg(F.count("item_id").alias("n_songs"))
    kept = playlists.filter(F.lower(F.trim("playlist_name")) != archive)
    return kept.join(counts, "playlist_id", "left").fillna(0, ["n_songs"])


def latest_batch_items(batches: DataFrame, items: DataFrame, catalogue: DataFrame, top: int = 9) -> DataFrame:
    """First rows of each user's newest stored batch, with song titles."""
    newest = batches.groupBy("user_id").agg(
        F.max_by("batch_id", F.struct("generated_at", "batch_id")).alias("batch_id")
    )
    return items.filter(F.col("rank") <= top).join(newest, "batch_id").join(catalogue, "item_id")


def unlock_flags(history: DataFrame) -> DataFrame:
    """Play mix per source and the 5- and 10-song counters of every user."""
    names = ("RECOMMENDATION", "SEARCH", "PLAYLIST", "ONBOARDING", "FRIEND")
    mix = [F.count_if(F.col("source") == s).alias(f"n_{s.lower()}") for s in names]
    counted = history.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_songs"), *mix)
    return counted.withColumns(
        {"unlock_5": (F.col("n_songs") >= 5).cast("int"), "unlock_10": (F.col("n_songs") >= 10).cast("int")}
    )


def friends_listening(friendships: DataFrame, visible: DataFrame, catalogue: DataFrame, users: DataFrame) -> DataFrame:
    """Each friend's latest visible play; friends without one are left out."""
    last = F.max_by(F.struct("item_id", "played_at"), F.struct("played_at", "id")).alias("last")
    playing = visible.groupBy(F.col("user_id").alias("friend_id")).agg(last).select("friend_id", "last.*")
    names = users.select(
        F.col("user_id").alias("friend_id"), F.coalesce(F.when(F.col("nickname") != "", F.col("nickname")), "google_name").alias("friend_name")
    )
    return friendships.join(playing, "friend_id").join(names, "friend_id").join(catalogue, "item_id")
