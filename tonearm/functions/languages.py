"""Language codes and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language name, its tag code, and the codes the re-rank accepts
# for it. The order is the order of names in a preferred-language string.
LANGUAGES = {
    "Chinese": {"tag": 3, "accepted": (3, 24)},
    "English": {"tag": 52, "accepted": (52,)},
    "Japanese": {"tag": 17, "accepted": (17,)},
    "Korean": {"tag": 31, "accepted": (31,)},
}
TAG_CODES = tuple(v["tag"] for v in LANGUAGES.values())
ALL_NAMES = ",".join(LANGUAGES)
SINGLE_SHARE = 0.7
MIN_SHARE = 0.3


def names(languages: Column) -> Column:
    """Comma list to an array of trimmed, non-empty names."""
    parts = F.transform(F.split(F.coalesce(languages, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def tag_code(name: Column) -> Column:
    pairs = [F.lit(x) for n, v in LANGUAGES.items() for x in (n, v["tag"])]
    return F.try_element_at(F.create_map(*pairs), name)


def accepted_codes(languages: Column) -> Column:
    pairs = []
    for n, v in LANGUAGES.items():
        pairs += [F.lit(n), F.array(*[F.lit(c) for c in v["accepted"]])]
    table = F.create_map(*pairs)
    none = F.array().cast("array<int>")
    found = F.transform(names(languages), lambda x: F.coalesce(F.try_element_at(table, x), none))
    return F.flatten(found)


def preferred_string(counts: dict[str, Column]) -> Column:
    """Preferred-language string from play counts per language name.

    One language with a share of at least 0.7 stands alone; otherwise all with
    at least 0.3; otherwise all names; ``Unknown`` without any counted play.
    """
    total = sum(counts.values(), F.lit(0))
    share = {n: c / F.nullif(total, F.lit(0)) for n, c in counts.items()}
    single = F.coalesce(*[F.when(s >= SINGLE_SHARE, F.lit(n)) for n, s in share.items()])
    several = F.concat_ws(",", *[F.when(s >= MIN_SHARE, F.lit(n)) for n, s in share.items()])
    return (
        F.when(total == 0, F.lit("Unknown"))
        .when(single.isNotNull(), single)
        .when(several != "", several)
        .otherwise(F.lit(ALL_NAMES))
    )
