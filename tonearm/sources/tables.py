"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", **options
) -> DataFrame:
    """CSV with a header; columns are taken by name, whatever their order, and quoted newlines are kept.

    Keeping newlines means that a file is read by one task; a large file whose
    texts hold none is split when ``multiLine=False`` is passed.
    """
    options = {"header": True, "encoding": encoding, "escape": '"', "multiLine": True} | options
    names = spark.read.options(**options, inferSchema=False).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: columns {missing} are missing")
    declared = {f.name: f for f in schema.fields}
    found = T.StructType([declared.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.schema(found).options(**options).csv(path).select(*[F.col(f"`{f.name}`") for f in schema.fields])


def read_columns(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Column-pruned read of a large CSV; Spark streams the splits, nothing is chunked by hand."""
    return read_csv(spark, path, schema).select(*columns)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet or CSV by suffix; a missing parquet falls back to the CSV of the same name."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    sibling = path.removesuffix(".parquet") + ".csv"
    if _exists(spark, sibling):
        return read_csv(spark, sibling, schema)
    raise FileNotFoundError(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def resolve_input(spark: SparkSession, path: str, raw_dir: str, filename: str) -> str:
    """The exact path, else the file in ``raw_dir``, else its only match below it."""
    for candidate in (path, f"{raw_dir.rstrip('/')}/{filename}"):
        if candidate and _exists(spark, candidate):
            return candidate
    found = sorted(
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", filename)
        .load(raw_dir)
        .inputFiles()
    )
    if len(found) > 1:
        raise ValueError(f"{filename}: several matches under {raw_dir}: {found}")
    if not found:
        raise FileNotFoundError(f"{filename} under {raw_dir}")
    return found[0]


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed reload of an exported CSV; values that do not parse become null."""
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = read_csv(spark, path, as_text)

    def typed(field: T.StructField):
        col = F.nullif(F.col(field.name), F.lit(""))
        if isinstance(field.dataType, T.TimestampType):
            return F.try_to_timestamp(col).alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            return col.try_cast("double").try_cast(field.dataType).alias(field.name)
        return col.try_cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields])


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Range-partitioned read of a site table over any JDBC driver on the class path."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", parts)
        .load()
    )


def load_catalogue_once(df: DataFrame, path: str) -> bool:
    """Write the catalogue without its placeholder rows; does nothing when already loaded."""
    if _exists(df.sparkSession, path):
        return False
    df.filter("song_id >= 0").write.parquet(path)
    return True


def append_metrics(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append metric rows, aligned to the log's schema (missing columns are null)."""
    empty = df.sparkSession.createDataFrame([], schema)
    aligned = empty.unionByName(df, allowMissingColumns=True).select(*schema.fieldNames())
    aligned.write.mode("append").parquet(path)


def head(df: DataFrame, rows: int | None) -> DataFrame:
    """First rows for smoke runs; the whole table when ``rows`` is not given."""
    return df if rows is None else df.limit(rows)
