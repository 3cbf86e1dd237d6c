"""Stored recommendation runs: published whole or not at all, replaced by a repeated run.

``path/batches`` and ``path/items`` hold one folder per attempt of a run,
``path/published`` one small row per finished attempt, written last. Readers
start from the newest row of a run and read the folder of its attempt, so rows
of an attempt that died, is still being written, or was replaced are never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import _exists

MARKS = "run_id string, attempt string, published_at timestamp, algorithm string, version string, n_batches bigint, n_items bigint"
STORED = {
    "items": "user_id bigint, rank int, item_id bigint, score double",
    "batches": "user_id bigint, n_rows bigint, generated_at timestamp",
}


def _schema(name: str, spark: SparkSession):
    return spark.createDataFrame([], STORED[name]).schema


def publish(recs: DataFrame, path: str, run_id: str, at: str, algorithm: str, version: str, seeds: DataFrame | None = None) -> str:
    """Store (user_id, item_id, score, rank) rows as one run; gives the name of the attempt.

    A batch per user with rows. ``seeds`` (user_id) names the users whom the
    run answers for: those without rows get an empty batch, which replaces what
    they had. ``at`` is the time of the run.
    """
    spark, attempt = recs.sparkSession, uuid.uuid4().hex
    folder = f"run_id={run_id}/attempt={attempt}"
    recs.to(_schema("items", spark)).write.parquet(f"{path}/items/{folder}")
    items = spark.read.parquet(f"{path}/items/{folder}")
    batches = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    if seeds is not None:
        batches = seeds.select("user_id").distinct().join(batches, "user_id", "left").fillna(0, ["n_rows"])
    batches.withColumn("generated_at", F.lit(at).cast("timestamp")).to(_schema("batches", spark)).write.parquet(f"{path}/batches/{folder}")
    mark(spark, path, run_id, attempt, at, algorithm, version)
    return attempt


def mark(spark: SparkSession, path: str, run_id: str, attempt: str, at: str, algorithm: str, version: str) -> None:
    """The row that makes an attempt visible: one row, one file, added in one commit."""
    folder = f"run_id={run_id}/attempt={attempt}"
    n = [spark.read.parquet(f"{path}/{name}/{folder}").agg(F.count(F.lit(1))).scalar() for name in ("batches", "items")]
    row = spark.range(1, numPartitions=1).select(
        F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.lit(at).cast("timestamp").alias("published_at"),
        F.lit(algorithm).alias("algorithm"), F.lit(version).alias("version"), n[0].alias("n_batches"), n[1].alias("n_items"),
    )
    order = F.current_timestamp().alias("marked_at")
    row.select("*", order).write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest mark of every run; empty before the first one."""
    if not _exists(spark, f"{path}/published"):
        return spark.createDataFrame([], MARKS)
    marks = spark.read.schema(f"{MARKS}, marked_at timestamp").parquet(f"{path}/published")
    names = [c for c in marks.columns if c not in ("run_id", "marked_at")]
    newest = marks.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct("marked_at", "attempt")).alias("m"))
    return newest.select("run_id", *[F.col(f"m.{c}").alias(c) for c in names])


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``batches`` or ``items`` of all published runs; the folders of other attempts are not opened.

    The folders are partitions, and the marks are small, so the join by
    (run_id, attempt) prunes what is read.
    """
    schema = f"{STORED[name]}, run_id string, attempt string"
    marks = published(spark, path).select("run_id", "attempt", "algorithm")
    if not _exists(spark, f"{path}/published"):
        return spark.createDataFrame([], f"{schema}, algorithm string")
    return spark.read.schema(schema).parquet(f"{path}/{name}").join(marks, ["run_id", "attempt"])


def newest_items(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """Each user's rows in the newest published batch of theirs (by time, then run); none where that batch is empty."""
    newest = read(spark, path, "batches").groupBy("user_id").agg(F.max(F.struct("generated_at", "run_id")).alias("b"))
    newest = newest.select("user_id", F.col("b.run_id").alias("run_id"), F.col("b.generated_at").alias("generated_at"))
    items = read(spark, path, "items").join(newest, ["user_id", "run_id"])
    return items if top is None else items.filter(F.col("rank") <= top)


def drop_replaced(spark: SparkSession, path: str, before: str) -> int:
    """Delete the folders of attempts that a newer mark replaced; gives how many.

    Attempts marked after ``before`` (a timestamp) stay: a reader may still be
    on them. Attempts without a mark stay as well, since they may be running.
    """
    if not _exists(spark, f"{path}/published"):
        return 0
    marks = spark.read.parquet(f"{path}/published").filter(F.col("marked_at") < F.lit(before).cast("timestamp")).select("run_id", "attempt").distinct()
    old = marks.join(published(spark, path), ["run_id", "attempt"], "left_anti")
    conf, dropped = spark._jsc.hadoopConfiguration(), 0
    for row in old.toLocalIterator():
        for name in ("items", "batches"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/run_id={row['run_id']}/attempt={row['attempt']}")
            dropped += folder.getFileSystem(conf).delete(folder, True)
    return dropped
