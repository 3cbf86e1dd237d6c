"""Codes without a type label stay in the join-back."""

from __future__ import annotations

from types import SimpleNamespace

from tonearm.plans import activity


def test_codes_without_type_labels_are_kept(spark):
    rows = [("q1", "aa1", 1, "song featuring x", None), ("q2", "bb2", 2, None, "single"), (None, "cc3", 3, None, "single")]
    ext = spark.createDataFrame(rows, "wd_qid string, isrc string, doc_id bigint, desc_en string, type_label string")
    songs = spark.createDataFrame([("s1", " AA1"), ("s2", "BB2"), ("s3", "CC3"), ("s4", None)], "song_id string, isrc string")
    t = SimpleNamespace(external=ext, song_extra=songs)
    got = {r["song_id"]: tuple(r)[1:] for r in activity._matched_songs(t, "left").collect()}
    assert got == {"s1": ("AA1", None, 1, 0, 0), "s2": ("BB2", "single", 0, 1, 0), "s3": (None,) * 5, "s4": (None,) * 5}
    assert {r["song_id"] for r in activity._matched_songs(t, "inner").collect()} == {"s1", "s2"}
