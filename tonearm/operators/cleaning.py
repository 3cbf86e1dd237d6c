"""Filters, whitelists, imputation and quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing, languages, text
from . import quantiles
from .ids import dense_ids


# --- members and users --------------------------------------------------------


def complete_members(members: DataFrame) -> DataFrame:
    return members.filter(F.col("bd").between(10, 80) & F.col("gender").isNotNull())


def profile_quality(profiles: DataFrame) -> DataFrame:
    """First broken rule of a registration profile, null when all hold.

    Needs nickname, gender, age, languages (array) and other_language.
    """
    base = F.filter("languages", lambda x: x != "Other")
    known = F.array(*[F.lit(n) for n in languages.LANGUAGES])
    nickname = F.trim(F.coalesce("nickname", F.lit("")))
    other = F.trim(F.coalesce("other_language", F.lit("")))
    code = (
        F.when(~nickname.rlike("^[a-zA-Z0-9]{1,16}$"), "INVALID_NICKNAME")
        .when(~F.coalesce(F.col("gender").isin("M", "F", "O"), F.lit(False)), "INVALID_GENDER")
        .when(~F.coalesce(F.col("age").between(0, 150), F.lit(False)), "INVALID_AGE")
        .when(F.coalesce(F.size("languages"), F.lit(0)) <= 0, "INVALID_LANGUAGES")
        .when(
            F.array_contains("languages", "Other") & ~other.rlike("^[一-鿿]+文$"), "INVALID_OTHER_LANGUAGE"
        )
        .when(F.size(F.array_except(base, known)) > 0, "INVALID_LANGUAGE_OPTION")
    )
    return profiles.withColumn("error_code", code)


def with_origin(users: DataFrame, seeded_prefix: str = "dev_") -> DataFrame:
    tag = F.when(F.col("google_id").startswith(seeded_prefix), "seeded").otherwise("real")
    return users.withColumn("source_tag", tag)


# --- interactions ---------------------------------------------------------------


def known_only(interactions: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """Rows whose keys all appear in the given key tables."""
    return reduce(lambda df, kv: df.join(kv[1].select(kv[0]), kv[0], "left_semi"), keys.items(), interactions)


def whitelist_report(interactions: DataFrame, members: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows kept and dropped by the user and song whitelists, in one pass."""
    m = members.select("msno").distinct().withColumn("known_user", F.lit(1))
    s = songs.select("song_id").distinct().withColumn("known_song", F.lit(1))
    flagged = interactions.join(m, "msno", "left").join(s, "song_id", "left")
    user, song = F.col("known_user").isNotNull(), F.col("known_song").isNotNull()
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(user & song).alias("n_kept"),
        F.count_if(~user).alias("n_unknown_user"),
        F.count_if(user & ~song).alias("n_unknown_song"),
    )


def positive_pairs(interactions: DataFrame, use_all_targets: bool = False) -> DataFrame:
    rows = interactions if use_all_targets else interactions.filter("target = 1")
    return rows.select("user_id", "item_id").distinct()


def positives_or_all(interactions: DataFrame) -> DataFrame:
    """Positive pairs; all pairs when there is no positive at all."""
    pos = positive_pairs(interactions)
    return positive_pairs(interactions, use_all_targets=True) if pos.isEmpty() else pos


def min_item_freq(pos: DataFrame, min_freq: int = 3) -> DataFrame:
    frequent = pos.groupBy("item_id").count().filter(F.col("count") >= min_freq)
    return pos.join(frequent, "item_id", "left_semi")


def eligible_rows(interactions: DataFrame, min_pos: int) -> DataFrame:
    """All rows, negatives included, of users with at least ``min_pos`` positives."""
    users = interactions.filter("target = 1").groupBy("user_id").count().filter(F.col("count") >= min_pos)
    return interactions.join(users, "user_id", "left_semi")


def implicit_positives(plays: DataFrame, min_pairs: int = 5, check: bool = False) -> DataFrame:
    """Pairs with a positive affinity, more than 30 seconds, or a like."""
    rule = (
        (F.coalesce("affinity_score", F.lit(0.0)) > 0)
        | (F.coalesce("watch_seconds", F.lit(0)) > 30)
        | (F.coalesce("is_liked", F.lit(0)) == 1)
    )
    pairs = plays.filter(rule).select("user_id", "item_id").distinct()
    if check and pairs.limit(min_pairs).count() < min_pairs:
        raise ValueError(f"fewer than {min_pairs} positive pairs")
    return pairs


def first_users(df: DataFrame, n: int | None) -> DataFrame:
    """Rows of the ``n`` lowest user ids (smoke runs)."""
    if n is None:
        return df
    return df.join(df.select("user_id").distinct().orderBy("user_id").limit(n), "user_id", "left_semi")


def hash_sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    return df.filter(hashing.in_fraction(fraction, *[F.col(k) for k in keys], seed))


def play_quality(requests: DataFrame, catalogue: DataFrame, sources: list[str]) -> DataFrame:
    """First broken rule of each play request, null when it is accepted."""
    known = catalogue.select("item_id", F.lit(True).alias("known"))
    seconds = F.col("watch_seconds").try_cast("int")
    code = (
        F.when(F.col("item_id").isNull(), "MISSING_SONG_ID")
        .when(F.col("watch_seconds").isNull(), "MISSING_WATCH_SECONDS")
        .when(F.coalesce("source", F.lit("")) == "", "MISSING_SOURCE")
        .when(~F.col("source").isin(sources), "INVALID_SOURCE")
        .when(F.col("known").isNull(), "SONG_NOT_FOUND")
        .when(seconds.isNull() | (seconds < 0), "INVALID_WATCH_SECONDS")
    )
    return requests.join(known, "item_id", "left").withColumn("error_code", code).drop("known")


# --- songs ------------------------------------------------------------------------

INDICATORS = {
    "has_isrc": "isrc",
    "has_genre": "genre_ids",
    "has_composer": "composer",
    "has_lyricist": "lyricist",
    "has_name": "name",
    "has_song_extra": "song_id_new",
}


def join_extras(songs: DataFrame, extra: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Songs with their dense id and extra columns; unmatched songs stay with null."""
    ids = dense_ids(extra, "song_id", "song_id_new") if ids is None else ids
    return songs.join(ids.join(extra, "song_id", "left"), "song_id", "left")


def missing_indicators(songs: DataFrame) -> DataFrame:
    return songs.withColumns({out: F.col(c).isNotNull().cast("int") for out, c in INDICATORS.items()})


def impute_songs(songs: DataFrame) -> DataFrame:
    """Median length, most frequent language (smallest on ties), fixed text for the rest."""
    filled = songs.withColumns(
        {
            "song_length": F.coalesce("song_length", quantiles.median(songs, "song_length")),
            "language": F.coalesce("language", quantiles.mode(songs, "language")),
        }
    )
    return (
        filled.fillna(text.UNKNOWN, ["genre_ids", "artist_name", "composer", "lyricist", "name"])
        .fillna("NONE", ["isrc"])
        .fillna(-1, ["song_id_new"])
    )


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, n_rows, n_null) from one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return counts.unpivot("n_rows", df.columns, "column_name", "n_null").select(
        F.lit(table).alias("table_name"), "column_name", "n_rows", "n_null"
    )


def load_profile(df: DataFrame, table: str, keys: list[str], signals: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, measure, value) from one scan: rows, distinct keys, rows with a filled signal, and rows per named value of a column."""
    measures = (
        [F.count(F.lit(1)).cast("double").alias("rows")]
        + [F.count_distinct(k).cast("double").alias(f"distinct_{k}") for k in keys]
        + [F.count_if(F.col(s).isNotNull()).cast("double").alias(f"filled_{s}") for s in signals]
        + [F.count_if(F.col(c) == v).cast("double").alias(f"{c}_{v}") for c, named in (values or {}).items() for v in named]
    )
    wide = df.agg(*measures)
    return wide.unpivot([], wide.columns, "measure", "value").select(
        F.lit(table).alias("table_name"), "measure", "value"
    )


def sanitize_catalogue(songs: DataFrame, artist: str = "artist_name", title: str = "name") -> DataFrame:
    return songs.withColumns({artist: text.clean_artist(F.col(artist)), title: text.clean_title(F.col(title))})


def drop_placeholders(songs: DataFrame, key: str = "song_id_new") -> DataFrame:
    return songs.filter(F.col(key) >= 0)


def in_languages(df: DataFrame, wanted: str, column: str = "lang") -> DataFrame:
    """Rows in one of a comma list of languages; an empty list keeps everything."""
    codes = [w.strip() for w in wanted.split(",") if w.strip()]
    return df.filter(F.col(column).isin(codes)) if codes else df


def catalogue_subset(songs: DataFrame, artists: DataFrame, played: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Songs that were played, and the artists those songs use."""
    kept = songs.join(played.select("item_id").distinct(), "item_id", "left_semi")
    return kept, artists.join(kept.select("artist_id"), "artist_id", "left_semi")


def id_set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids in both, only left, only right, from one full outer pass."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer")
    has_l: Column = F.col("in_left").isNotNull()
    has_r: Column = F.col("in_right").isNotNull()
    return both.agg(
        F.count_if(has_l & has_r).alias("n_common"),
        F.count_if(has_l & ~has_r).alias("n_only_left"),
        F.count_if(~has_l & has_r).alias("n_only_right"),
    )
