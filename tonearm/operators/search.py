"""Catalogue and document search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MAX_QUERY = 100
PAGE = 20


def check_query(query: str) -> str:
    """Trimmed search words; empty or over-long ones are refused."""
    words = query.strip()
    if not words:
        raise ValueError("MISSING_QUERY")
    if len(words) > MAX_QUERY:
        raise ValueError("QUERY_TOO_LONG")
    return words


def bigrams(query: str) -> list[str]:
    """Distinct character pairs of the lower-cased words, in order of appearance."""
    grams = [w[i : i + 2] for w in check_query(query).lower().split() for i in range(max(1, len(w) - 1))]
    return list(dict.fromkeys(grams))


def _matches(texts: list[Column], query: str) -> Column:
    whole = F.lower(F.concat_ws(" ", *texts))
    return reduce(lambda a, b: a + b, [whole.contains(g).cast("int") for g in bigrams(query)])


def ngram(df: DataFrame, key: str, texts: list[str], query: str, page: int = PAGE) -> DataFrame:
    """Rows sharing most character pairs with the query, best first, lowest id on ties.

    One scan: each row's relevance is a sum of containment tests on its whole
    text, and only the page leaves each task.
    """
    scored = df.withColumn("relevance", _matches([F.col(t) for t in texts], query))
    return scored.filter("relevance > 0").orderBy(F.desc("relevance"), key).limit(page)


def bigram_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): inverted table of distinct character pairs, for repeated searches."""
    words = F.split(F.lower(text), r"\s+")
    pairs = F.flatten(
        F.transform(
            F.filter(words, lambda w: F.length(w) > 1),
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))),
        )
    )
    return df.select(key, F.explode(F.array_distinct(pairs)).alias("gram"))


def ngram_indexed(index: DataFrame, key: str, query: str, page: int = PAGE) -> DataFrame:
    """The same relevance from the inverted table."""
    hits = index.filter(F.col("gram").isin(bigrams(query)))
    scored = hits.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("relevance"))
    return scored.orderBy(F.desc("relevance"), key).limit(page)


def contains(df: DataFrame, key: str, title: str, artist: str, query: str, page: int = PAGE) -> DataFrame:
    """Rows with the words in the title or the artist name, ignoring case."""
    words = check_query(query).lower()
    inside = lambda c: F.lower(F.col(c)).contains(words)
    return df.filter(inside(title)).union(df.filter(inside(artist))).distinct().orderBy(key).limit(page)
