"""String rules: recording codes, genre lists, flags, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Recording-code pattern, last two-digit year read as 20yy, and
# the pattern of the featuring flag.
ISRC_PATTERN = r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{2}[0-9]{5}$"
ISRC_LAST_20YY = 25
FEATURING_PATTERN = r"\b(feat\.|featuring|ft\.?)\b"
UNKNOWN = "unknown"


def isrc_valid(isrc: Column) -> Column:
    return F.coalesce(isrc.rlike(ISRC_PATTERN), F.lit(False)).cast("int")


def isrc_part(isrc: Column, start: int, length: int) -> Column:
    return F.when(isrc_valid(isrc) == 1, F.substring(isrc, start, length)).otherwise(F.lit("UNK"))


def isrc_year(isrc: Column) -> Column:
    yy = F.substring(isrc, 6, 2).try_cast("int")
    return F.when(isrc_valid(isrc) == 1, yy + F.when(yy <= ISRC_LAST_20YY, 2000).otherwise(1900))


def genres(genre_ids: Column) -> Column:
    """Pipe-separated codes to an array; ``unknown`` is the empty list."""
    return F.when(genre_ids == UNKNOWN, F.array().cast("array<string>")).otherwise(F.split(genre_ids, r"\|"))


def has_featuring(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(FEATURING_PATTERN)


def has_word(text: Column, word: str) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).contains(word)


def match_key(code: Column) -> Column:
    return F.upper(F.trim(code))


def clean_artist(name: Column) -> Column:
    flat = F.when(name.contains("\n") | name.contains("\r"), F.lit(UNKNOWN)).otherwise(name)
    return F.translate(flat, '"', "'")


def clean_title(title: Column) -> Column:
    return F.regexp_replace(F.translate(title, '"', "'"), r"[\r\n]+", " ")


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])
