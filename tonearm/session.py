"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job wants; all of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is worth an extra shuffle when the alternative is one long task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Columns of ids are some ten times larger in a broadcast than in their file; the planner must not judge them by the file.
    "spark.sql.sources.fileCompressionFactor": "10",
    # Shuffle files go when their job has ended; what is read again is written (``materialize``).
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Keep wide one-pass aggregations (vector sums, metric grids) inside codegen.
    "spark.sql.codegen.maxFields": "400",
}


#: Bytes of a table that may be broadcast, unless the session says less; the driver holds ten times as much while it makes the relation, of each that is made at that time.
BROADCAST = 2**20


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set(limit, str(BROADCAST))
    return spark


def local_session(cores: str = "8", memory: str = "16g", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tonearm")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_local_dir: list[str] = []


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    # One process, one machine: a folder of its own, named once.
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="tonearm-"))
    return _local_dir[0]


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, for one run of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_run_tables: list[str] = []


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table, in a folder per value of ``by`` if that is given.

    Used where a plan is read several times: the rows are then the same each
    time, a lost executor costs no recomputation, and the planner knows the
    table's size.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _run_tables.append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_at)
        _run_tables.remove(table._written_at)


_run_results: dict[tuple[str, ...], tuple[str, object]] = {}


def once(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written by the first caller of this application and read by the next ones.

    For a result that several reports of one run share; ``key`` names it and
    the data it is made from, which must not change during the run.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _run_results:
        df = build()
        path = run_dir(spark, key[1])
        df.write.parquet(path)
        _run_tables.append(path)
        _run_results[key] = (path, df.schema)
    path, schema = _run_results[key]
    return spark.read.schema(schema).parquet(path)


def side_by_side(spark: SparkSession, builds: Sequence[Callable[[], DataFrame]], at_once: int = 4) -> list[DataFrame]:
    """What independent ``builds`` make, in their order; ``at_once`` of them submit jobs at a time, so small jobs share the cores.

    The first failure is raised once the others that run have ended.
    """
    with ThreadPoolExecutor(at_once) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]]


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_run_tables(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this process; call it when their results are stored."""
    dropped = 0
    _run_results.clear()
    while _run_tables:
        dropped += _delete(spark, _run_tables.pop())
    return dropped


_whole: list[str] = []
_whole_lock = threading.Lock()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def whole_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Arrow tasks are bounded by their number of rows alone, for jobs run inside.

    For short lines: to measure a batch after each takes many times longer than
    to read it. Jobs of several threads may be inside; the last one out sets
    the limit back.
    """
    with _whole_lock:
        _whole.append(_whole[0] if _whole else spark.conf.get(_BATCH_BYTES))
        spark.conf.set(_BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        with _whole_lock:
            before = _whole.pop()
            if not _whole:
                spark.conf.set(_BATCH_BYTES, before)
