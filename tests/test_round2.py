"""Golden rows for corrected rules."""

from __future__ import annotations

from pyspark.sql import types as T

from tonearm.operators import external, history
from tonearm.sources import tables


def test_favourite_keeps_its_first_date(spark):
    rows = [(1, 7, "Archive ", "2024-01-02"), (1, 7, "archive", "2024-01-01"), (1, 8, "other", "2024-01-01")]
    got = history.favorites(spark.createDataFrame(rows, "user_id int, item_id int, playlist_name string, added_at string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, "2024-01-01")]


def test_external_rows_are_one_per_code(spark):
    rows = [("A", "Q1", None, 1), ("A", "Q2", "text", 2), ("A", "Q2", "later", 3), ("B", "Q1", None, 4)]
    got = external.dedupe(spark.createDataFrame(rows, "isrc string, wd_qid string, desc_en string, doc_id int"))
    assert sorted((r.isrc, r.wd_qid, r.doc_id) for r in got.collect()) == [("A", "Q2", 2), ("B", "Q1", 4)]


def test_csv_by_name_with_newlines(spark, tmp_path):
    path = tmp_path / "songs.csv"
    path.write_text('name,song_id,extra\n"a\nb",s1,x\nc,s2,y\n')
    schema = T.StructType([T.StructField("song_id", T.StringType()), T.StructField("name", T.StringType())])
    assert sorted(tuple(r) for r in tables.read_csv(spark, str(path), schema).collect()) == [("s1", "a\nb"), ("s2", "c")]
