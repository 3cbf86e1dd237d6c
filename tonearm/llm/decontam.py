"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` words, a window into
shingles of ``SHINGLE`` words.  A document holds a window only if it holds all
its shingles, so the rarest one is the necessary prefix: only where a document
has that shingle, and only where the window fits before and after it, is the
window compared in full.  How rare a shingle is, is counted over the places of
all documents where a window may lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .text import count_words, split_words

WINDOW = 13
SHINGLE = 5
#: Rows of benchmark shingles up to which they are sent to every executor (about 100 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: What stands between words: anything in ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """The words of a whole text, A-Z in lower case; none for a null text."""
    return split_words(F.translate(text, UPPER, LOWER), GAP)


def _run(ws: Column, start: Column | int, size: Column | int) -> Column:
    """``size`` words from the 0-based ``start`` as text; a word holds no space, so the text names the run exactly."""
    return F.array_join(F.slice(ws, start + 1, size), " ")


def _matches(cut: DataFrame, known: DataFrame, length: int, size: int) -> DataFrame:
    """(key, doc_words, pos, shingle): every occurrence of a known shingle that may lie in a window of ``length`` words.

    A window of ``length`` words holds a whole shingle at one of the places 0,
    s, 2s, ... of the document, with s = length - size + 1.  So only those are
    looked up first, each with the words around it that such a window can
    reach; where one is known, all shingles of these words are.
    """
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    step, n = length - size + 1, F.size("_w")

    def around(i: Column) -> Column:
        first = F.greatest(F.lit(0), i - (step - 1))
        return F.struct(i.alias("at"), first.alias("first"), _run(F.col("_w"), i, F.lit(size)).alias("shingle"), _run(F.col("_w"), first, i + length - first).alias("near"))

    looked = F.when(n >= length, F.transform(F.sequence(F.lit(0), n - size, F.lit(step)), around))
    spots = cut.select("key", n.alias("doc_words"), F.explode(looked).alias("s")).select("key", "doc_words", "s.first", "s.near", "s.shingle")
    spots = spots.join(known, "shingle", "left_semi").select("key", "doc_words", "first", F.split("near", " ").alias("_n"))
    every = F.transform(F.sequence(F.lit(0), F.size("_n") - size), lambda i: _run(F.col("_n"), i, F.lit(size)))
    placed = spots.select("key", "doc_words", "first", F.posexplode(every).alias("offset", "shingle"))
    return placed.join(known, "shingle", "left_semi").select("key", "doc_words", (F.col("first") + F.col("offset")).alias("pos"), "shingle")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window text -> item_id, one row per pair) and (distinct window text, its length in words)."""
    ws = words("text")
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", ws.alias("_w")).filter(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - length), lambda i: F.array_join(F.slice(F.col("_w"), i + 1, length), " "))
    owned = items.select("item_id", F.explode(cut).alias("window")).distinct()
    return owned, owned.select("window").distinct().withColumn("length", F.size(F.split("window", " ")))


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Exact occurrences of benchmark windows: (key, doc_words, start, length, window).

    ``key`` is the document's (doc_id, hash of its text), so equal rows share
    their occurrences and rows that only share an id don't.
    """
    owned, whole = windows_of(benchmark, window)
    size = F.least(F.lit(shingle), F.col("length"))
    ws = F.split("window", " ")
    parts = whole.withColumn("size", size).select(
        "window", "length", "size",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.col("length") - F.col("size")), lambda i: F.array_join(F.slice(ws, i + 1, F.col("size")), " "))
        ).alias("offset", "shingle"),
    )
    parts = materialize(parts, "decontam-windows")
    lengths = sorted(r[0] for r in parts.select("length").distinct().collect())  # at most WINDOW rows
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    cut = documents.select(key.alias("key"), words("text").alias("_w"))
    found = None
    for length in lengths:
        at = _matches(cut, parts.filter(F.col("length") == length).select("shingle").distinct(), length, min(shingle, length))
        found = at if found is None else found.unionByName(at)
    if found is None:
        found = cut.select("key", F.size("_w").alias("doc_words"), F.lit(0).alias("pos"), F.lit("").alias("shingle")).limit(0)
    # All later steps read these matches; what the corpus shares with no item ends here.
    found = materialize(found, "decontam-shingles")
    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    # A window with a shingle that no document has can't occur.  Of the others the rarest shingle is the prefix.
    ranked = parts.join(rarity, "shingle", "left").groupBy("window", "length", "size").agg(
        F.min(F.coalesce("df", F.lit(0))).alias("least"),
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("rarest"),
    )
    prefix = ranked.filter("least > 0").select("window", "length", "size", "rarest.shingle", "rarest.offset")
    placed = found.distinct()
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("doc_words")) & (F.col("length") <= F.col("doc_words"))
    candidates = placed.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("offset")).filter(fits)
    # Shingles side by side, the last one flush with the end, cover the window: the rarest is there already, the others are looked up.
    spans = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("length") - F.col("size"), F.col("size")), F.array(F.col("length") - F.col("size"))))
    tried = candidates.select("key", "doc_words", "start", "length", "size", "window", F.explode(spans).alias("offset"))
    wanted = tried.withColumn("pos", F.col("start") + F.col("offset")).withColumn(
        "shingle", F.array_join(F.slice(F.split("window", " "), F.col("offset") + 1, F.col("size")), " ")
    )
    met = wanted.join(placed.select("key", "pos", "shingle"), ["key", "pos", "shingle"])
    whole_runs = met.groupBy("key", "doc_words", "start", "length", "window").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return whole_runs.filter(F.col("n") == F.ceil(F.col("length") / F.col("size"))).drop("n", "size")


def scan(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, keyed: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any window of any item; a
    document is contaminated if ``share`` x its hit words reach its words.
    ``items_sha256`` is the digest of the ids of the occurring items, sorted as
    strings and comma-joined.

    Null and empty texts have no words, no hits and are clean.  Items without
    words or without item_id are left out; an item_id that occurs with several
    texts owns the windows of all of them.  Repeated document rows get the same
    result each, rows with a null doc_id or a shared doc_id are told apart by
    their text, further columns are ignored, empty tables give empty results.
    ``keyed`` adds the hash of the text as ``_hash``.
    """
    owned, _ = windows_of(benchmark, window)
    runs = materialize(hits(documents, benchmark, window, shingle), "decontam-hits")
    # Hit words: occurrences by start, each counted from where the furthest earlier one ended.
    ends = runs.groupBy("key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = ends.withColumn("_from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = covered.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("_from"))).cast("bigint").alias("n_hit"))
    items = runs.select("key", "window").distinct().join(owned, "window").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = n_hit.join(items, "key", "left").select(
        F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h"), "n_hit", F.size("items").cast("bigint").alias("n_items"), "items"
    )
    counted = documents.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
        count_words("text", GAP).alias("n_words"),
    )
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"), *(["_hash"] if keyed else []),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever these are named; rows are told apart as in ``scan``."""
    bad = scan(documents, benchmark, keyed=True, **options).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("id"), F.col("_hash").alias("hash")).distinct()
    # A row travels as one column, so that no name of its own meets one of this join.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    text_hash = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    kept = rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("hash")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
