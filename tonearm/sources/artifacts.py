"""Model tables: neighbour lists and embeddings, written and read as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT_VERSION = 1


def write_neighbors(neighbors: DataFrame, path: str, item_k: int) -> None:
    """Neighbour rows plus a one-row description, laid out for lookups by item."""
    spark = neighbors.sparkSession
    neighbors.repartition("item_id").sortWithinPartitions("item_id", "rank").write.mode("overwrite").parquet(
        f"{path}/neighbors"
    )
    meta = spark.range(1).select(F.lit(item_k).alias("item_k"), F.lit(FORMAT_VERSION).alias("format_version"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def write_embeddings(items: DataFrame, path: str, tags: DataFrame | None = None) -> None:
    items.write.mode("overwrite").parquet(f"{path}/items")
    if tags is not None:
        tags.write.mode("overwrite").parquet(f"{path}/tags")


def integrity(embeddings: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: counts, vector sizes, repeated ids, and the verdict."""
    size = F.size("embedding")
    return embeddings.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_ids"),
        F.min(size).alias("min_dims"),
        F.max(size).alias("max_dims"),
        F.count_if(F.col("embedding").isNull() | F.col("bias").isNull()).alias("n_null"),
    ).withColumn(
        "is_valid",
        (
            (F.col("n_rows") > 0)
            & (F.col("n_rows") == F.col("n_ids"))
            & (F.col("min_dims") == F.col("max_dims"))
            & (F.col("n_null") == 0)
        ).cast("int"),
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings of a written model; refuses a table that fails its integrity check."""
    table = spark.read.parquet(f"{path}/items")
    report = integrity(table).first()
    if not report["is_valid"]:
        raise ValueError(f"{path}: {report.asDict()}")
    return table


def read_neighbors(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path}: format version {meta['format_version']}")
    table = spark.read.parquet(f"{path}/neighbors")
    return table if k is None else table.filter(F.col("rank") <= k)
