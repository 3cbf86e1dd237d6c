"""Readers, writers and artifacts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonearm import schemas
from tonearm.operators import search
from tonearm.sources import artifacts, tables


def test_csv_round_trip_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([("s1", 'say "hi", then', None), ("s2", None, "x")], schemas.RAW["song_extra"])
    tables.write_table(df, f"{tmp_path}/extra.csv")
    got = tables.read_table(spark, f"{tmp_path}/extra.parquet", schemas.RAW["song_extra"])  # no parquet: reads the csv
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    tables.write_table(df.limit(1), f"{tmp_path}/extra.parquet")
    assert tables.read_table(spark, f"{tmp_path}/extra.parquet", schemas.RAW["song_extra"]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{tmp_path}/none.parquet", schemas.RAW["song_extra"])


def test_resolve_input(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "train.csv").write_text("x\n")
    assert tables.resolve_input(spark, "", str(tmp_path), "train.csv").endswith("a/b/train.csv")
    (tmp_path / "a" / "train.csv").write_text("x\n")
    with pytest.raises(ValueError):
        tables.resolve_input(spark, "", str(tmp_path), "train.csv")
    with pytest.raises(FileNotFoundError):
        tables.resolve_input(spark, "", str(tmp_path), "songs.csv")


def test_typed_reload(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "user_id,song_id,source,watch_seconds,played_at,is_liked,affinity_score\n"
        "1,2,SEARCH,30,2024-01-01T10:00:00+00:00,1.0,0.5\n3,4,SEARCH,oops,not-a-time,,\n"
    )
    rows = tables.read_export(spark, f"{tmp_path}/i.csv", schemas.EXPORT["interactions"]).orderBy("user_id").collect()
    assert (rows[0]["is_liked"], rows[0]["affinity_score"], rows[0]["played_at"].year) == (1, 0.5, 2024)
    assert (rows[1]["watch_seconds"], rows[1]["played_at"], rows[1]["is_liked"]) == (None, None, None)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns \\['b'\\]"):
        schemas.require_columns(spark.range(1).select(F.lit(1).alias("a")), {"a", "b"})


def test_metric_log_grows(spark, tmp_path):
    row = spark.sql("SELECT 'm' AS model, 10 AS k, 0.5D AS recall")
    for _ in range(2):
        tables.append_metrics(row, f"{tmp_path}/log", schemas.METRICS)
    log = spark.read.schema(schemas.METRICS).parquet(f"{tmp_path}/log")
    assert log.count() == 2 and log.filter("ndcg is null").count() == 2


def test_catalogue_loads_once(spark, tmp_path):
    songs = spark.createDataFrame([(-1, "x"), (0, "y"), (5, "z")], "song_id int, name string")
    assert tables.load_catalogue_once(songs, f"{tmp_path}/c")
    assert not tables.load_catalogue_once(songs, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2


def test_artifacts(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0], 0.1), (2, [3.0, 4.0], 0.2)], "item_id bigint, embedding array<float>, bias float")
    artifacts.write_embeddings(good, f"{tmp_path}/good")
    assert artifacts.read_embeddings(spark, f"{tmp_path}/good").count() == 2
    bad = good.unionByName(spark.createDataFrame([(2, [1.0], 0.0)], good.schema))
    artifacts.write_embeddings(bad, f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        artifacts.read_embeddings(spark, f"{tmp_path}/bad")
    neighbors = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.4, 2)], "item_id bigint, neighbor_id bigint, sim double, rank int")
    artifacts.write_neighbors(neighbors, f"{tmp_path}/nb", 2)
    assert artifacts.read_neighbors(spark, f"{tmp_path}/nb", 1).count() == 1


def test_search_rules(spark, sf_dir):
    with pytest.raises(ValueError, match="MISSING_QUERY"):
        search.check_query("  ")
    with pytest.raises(ValueError, match="QUERY_TOO_LONG"):
        search.check_query("x" * 101)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'")
    scanned = search.ngram(docs, "doc_id", ["text"], "retition ouen").select("doc_id", "relevance").collect()
    indexed = search.ngram_indexed(search.bigram_index(docs, "doc_id", "text"), "doc_id", "retition ouen").collect()
    assert list(map(tuple, scanned)) == list(map(tuple, indexed))
