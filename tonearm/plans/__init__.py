"""Named queries over the supplied tables, each a Spark plan with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from . import activity, catalogue, evaluate, recommend, streams  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: registry.runner(name) for name in registry.PLANS}


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
