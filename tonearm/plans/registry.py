"""Name -> (Spark plan, comparison SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.fixtures import Tables
from .ctes import with_ctes

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` names shared tables of ``ctes`` freely."""

    def add(build: Callable[[Tables], DataFrame]):
        assert name not in PLANS, name
        PLANS[name] = build
        if sql is not None:
            SQL[name] = sql if sql in SQL.values() else with_ctes(sql)
        return build

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and booleans as 0/1, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, T.BooleanType):
            col = col.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(f.name))
    return df.select(*out)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(PLANS[name](Tables(spark, sf_dir)))

    run.__name__ = name
    return run
