"""Labelled samples and held-out folds of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold`` of ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """(text, y, part) of at most ``rows`` labelled ids outside the held-out fold, chosen by a hash of the id; one text per id.

    Labels without id or value are left out, and so are ids whose labels
    disagree.  ``part`` is a hash of the id in 0..3 for splitting the sample.
    The ids are at most ``rows``, so they are sent to the documents.  Of the
    texts that stand under one id the one with the smallest hash is taken.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", folds, fold)
    )
    agreed = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    chosen = agreed.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "y", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int").alias("part"))
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id", "y", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y", "part")
