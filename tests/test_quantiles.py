"""Quantiles and modes against NumPy, with ties, hot values, nulls and no rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.operators import features, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


@pytest.mark.parametrize("n,values", [(1, 3), (2, 9), (7, 3), (1000, 17), (1001, 5000)])
def test_quantiles(spark, n, values):
    draw = np.random.default_rng(n)
    rows = np.round(draw.integers(0, values, n) / 3, 3)
    rows[: n // 3] = rows[0]  # a third of all rows share one value
    df = spark.createDataFrame([(float(x),) for x in rows] + [(None,)] * 3, "x double")
    counts = quantiles.counted(df, "x")
    assert np.allclose(quantiles.quantiles(counts, "x", SHARES), np.quantile(rows, SHARES), atol=1e-9)
    assert df.select(quantiles.median(df, "x")).first()[0] == pytest.approx(np.median(rows))
    top = {v: (rows == v).sum() for v in rows}
    assert df.select(quantiles.mode(df, "x")).first()[0] == min(v for v in top if top[v] == max(top.values()))


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantiles(quantiles.counted(df, "x"), "x", [0.0, 1.0]) == [None, None]
    assert df.select(quantiles.median(df, "x"), quantiles.mode(df, "x")).first()[:] == (None, None)


def test_plans_sort_no_raw_rows(spark):
    """Edges are literals: the plan of the buckets holds neither an aggregate nor a sort."""
    songs = spark.createDataFrame([(i, float(i % 50)) for i in range(500)] + [(500, None)], "song_id bigint, song_length double")
    plan = features.length_bucket(songs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("percentile", "Aggregate", "Sort"))
    labels = features.length_bucket(songs).groupBy("length_tag").agg(F.count("*").alias("n")).collect()
    assert {r["length_tag"] for r in labels} == {f"len_{i}" for i in range(5)}
