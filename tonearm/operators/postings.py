"""Indexed search by character pairs: posting lists in blocks of ids, and an exact top page that stops early.

A gram's list is cut into blocks of neighbouring ids, so no row of the index
grows with the collection. A search reads the rarest grams first; once no text
outside their lists can reach the page, the long lists of the frequent grams
are only looked at where candidates lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import search
from ..session import materialize

#: Ids in a block, the most that one row of a list can hold.
BLOCK_IDS = 8_192


def build(df: DataFrame, key: str, texts: list[str], block_ids: int = BLOCK_IDS) -> DataFrame:
    """(gram, block, ids): all characters and character pairs of the lower-cased texts, with the sorted ids per block.

    ``key`` is a whole number that names a row; rows under one id count as one
    text, rows without id or text are in no list.
    """
    whole = F.lower(F.concat_ws(" ", *texts))
    words = F.array_distinct(F.split(whole, r"\s+"))
    cut = lambda width: F.flatten(
        F.transform(
            F.filter(words, lambda w: F.length(w) >= width),
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (width - 1)), lambda i: F.substring(w, i, F.lit(width))),
        )
    )
    grams = F.array_union(cut(1), cut(2))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.explode(grams).alias("gram"))
    block = F.floor(F.col("id") / block_ids).cast("bigint").alias("block")
    return rows.groupBy("gram", block).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def frequencies(index: DataFrame, grams: list[str]) -> list[tuple[str, int]]:
    """The query's grams that occur, rarest first, with the number of texts that have them."""
    counts = index.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    return sorted(((r["gram"], r["n"]) for r in counts.collect()), key=lambda g: (g[1], g[0]))


def _scores(index: DataFrame, grams: list[str]) -> DataFrame:
    ids = index.filter(F.col("gram").isin(grams)).select("block", F.explode("ids").alias("id"))
    return ids.groupBy("block", "id").agg(F.count(F.lit(1)).alias("relevance"))


def enough(index: DataFrame, grams: list[str], page: int) -> tuple[int, int, DataFrame]:
    """(number of rarest grams read, relevance of the page's last row so far, their written scores).

    Doubles the number of grams until a text that has none of them cannot
    reach the page: it has at most the other grams, fewer than the last row.
    """
    read = 1
    while True:
        scores = materialize(_scores(index, grams[:read]), "scores")
        top = [r["relevance"] for r in scores.orderBy(F.desc("relevance")).limit(page).select("relevance").collect()]
        last = min(top) if len(top) == page else 0
        if read == len(grams) or last > len(grams) - read:
            return read, last, scores
        read = min(len(grams), 2 * read)


def top_page(index: DataFrame, query: str, page: int = search.PAGE) -> DataFrame:
    """(id, relevance) of the ``page`` texts with most of the query's grams, smallest id on ties.

    The same rows as a scan by ``search.ngram``; no row where no gram occurs.
    """
    grams = [g for g, _ in frequencies(index, search.bigrams(query))]
    if not grams:
        return _scores(index, []).select("id", "relevance")
    read, last, scores = enough(index, grams, page)
    rest = grams[read:]
    if rest:
        scores = scores.filter(F.col("relevance") >= last - len(rest))
        named = scores.groupBy("block").agg(F.collect_list("id").alias("candidates"))
        lists = index.filter(F.col("gram").isin(rest)).join(named, "block")
        more = lists.select("block", F.explode(F.array_intersect("ids", "candidates")).alias("id"))
        added = more.groupBy("block", "id").agg(F.count(F.lit(1)).alias("more"))
        scores = scores.join(added, ["block", "id"], "left").withColumn("relevance", F.col("relevance") + F.coalesce("more", F.lit(0)))
    return scores.select("id", "relevance").orderBy(F.desc("relevance"), "id").limit(page)
