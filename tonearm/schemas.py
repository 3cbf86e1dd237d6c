"""Declared schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D, B, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

RAW = {
    "members": _struct(
        ("msno", S), ("city", I), ("bd", I), ("gender", S), ("registered_via", I),
        ("registration_init_time", I), ("expiration_date", I),
    ),
    "songs": _struct(
        ("song_id", S), ("song_length", D), ("genre_ids", S), ("artist_name", S),
        ("composer", S), ("lyricist", S), ("language", D),
    ),
    "song_extra": _struct(("song_id", S), ("name", S), ("isrc", S)),
    "train": _struct(
        ("msno", S), ("song_id", S), ("source_system_tab", S), ("source_screen_name", S),
        ("source_type", S), ("target", I),
    ),
}

EXPORT = {
    "users": _struct(
        ("user_id", L), ("google_id", S), ("email", S), ("nickname", S), ("age", I), ("gender", S),
        ("preferred_languages", S), ("profile_completed", I), ("google_name", S),
        ("source_tag", S), ("created_at", TS),
    ),
    "songs": _struct(
        ("song_id", L), ("song_title", S), ("artist_id", L), ("artist_name", S),
        ("album_name", S), ("language", S), ("release_date", T.DateType()),
    ),
    "interactions": _struct(
        ("user_id", L), ("song_id", L), ("source", S), ("watch_seconds", L), ("played_at", TS),
        ("is_liked", I), ("affinity_score", D),
    ),
    "onboarding": _struct(("user_id", L), ("kind", S), ("entity_id", L), ("created_at", TS)),
}

EVENTS = _struct(
    ("event_id", L), ("ts", T.TimestampNTZType()), ("user_id", L), ("event_type", S),
    ("value", D), ("props", S),
)

METRICS = _struct(
    ("date", S), ("model", S), ("k", I), ("recall", D), ("precision", D), ("ndcg", D),
    ("users_evaluated", L), ("notes", S),
)


def require_columns(df: DataFrame, required: set[str] | list[str], table: str = "table") -> DataFrame:
    """Fail fast when a column is missing; returns ``df`` unchanged."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df
