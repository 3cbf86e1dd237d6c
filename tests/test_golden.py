"""Worked examples and bin edges."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tonearm.functions import buckets, languages, text
from tonearm.operators import affinity, challenges, features, history


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_age_edges(spark):
    got = column(spark, [0, 10, 12, 13, 18, 19, 25, 26, 35, 36, 50, 51, 80, 81, None], "int", buckets.age_group)
    assert got == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, None, None]


def test_tenure_edges(spark):
    days = [0, 30, 31, 180, 181, 365, 366, 730, 731, 1825, 1826, 3650, 3651]
    assert column(spark, days, "int", buckets.tenure_group) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6]


def test_watch_edges(spark):
    got = column(spark, [0, 9, 10, 29, 30, 59, 60, 179, 180], "int", buckets.watch_weight)
    assert got == [0.0, 0.0, 0.1, 0.1, 0.3, 0.3, 0.5, 0.5, 0.7]


def test_length_labels(spark):
    got = column(spark, [0.0, 59999.0, 60000.0, 299999.0, 300000.0, 17999999.0, 18000000.0], "double", buckets.length_label)
    assert got == ["0-1", "0-1", "1-2", "4-5", "5+", "5+", None]


def test_levels(spark):
    xp = [0, 49, 50, 100, 200, 400, 799, 800]
    assert column(spark, xp, "int", buckets.level) == [1, 1, 2, 3, 4, 5, 5, 6]
    assert column(spark, xp, "int", buckets.level_floor) == [0, 0, 50, 100, 200, 400, 400, 800]
    assert column(spark, xp, "int", buckets.level_span) == [50, 50, 50, 100, 200, 400, 400, None]


def test_recording_code(spark):
    codes = ["TWA471214002", "NONE", "USX0125aaaaa", "USX012512345", "USX012612345", None]
    assert column(spark, codes, "string", text.isrc_valid) == [1, 0, 0, 1, 1, 0]
    assert column(spark, codes, "string", text.isrc_year) == [2012, None, None, 2025, 1926, None]
    assert column(spark, codes[:2], "string", lambda c: text.isrc_part(c, 3, 3)) == ["A47", "UNK"]


def test_genres(spark):
    assert column(spark, ["a|b", "unknown", "c"], "string", text.genres) == [["a", "b"], [], ["c"]]


@pytest.mark.parametrize(
    "seconds,skips,like,favorite,expected",
    [(200, 0, 1, True, 1.0), (0, 5, 0, False, -0.5), (200, 3, 0, False, 0.4), (0, 0, -1, False, -1.0), (0, 0, 0, False, 0.0)],
)
def test_affinity_examples(spark, seconds, skips, like, favorite, expected):
    row = spark.range(1).select(
        F.round(affinity.score(F.lit(seconds), F.lit(skips), F.lit(favorite), F.lit(like)), 6)
    )
    assert row.first()[0] == pytest.approx(expected)


def test_skip_threshold(spark):
    plays = spark.createDataFrame([(1, 1, 4), (1, 1, 5), (1, 1, 12)], "user_id bigint, item_id bigint, watch_seconds int")
    likes = spark.createDataFrame([], "user_id bigint, item_id bigint, is_liked boolean")
    row = affinity.affinity_scores(plays, likes, likes).first()
    assert (row["total_watch_seconds"], row["skip_count"], row["score"]) == (17, 1, 0.0)


def toggle(requests):
    state = None
    for wanted in requests:
        state = None if state == wanted else wanted
    return state


def test_like_toggle_all_sequences(spark):
    rows, expected = [], {}
    sequences = [s for n in range(1, 8) for s in itertools.product([True, False], repeat=n)]
    for user, sequence in enumerate(sequences):
        expected[user] = toggle(sequence)
        rows += [(user, 0, i, i, wanted) for i, wanted in enumerate(sequence)]
    log = spark.createDataFrame(rows, "user_id bigint, item_id bigint, ts bigint, event_id bigint, intent boolean")
    assert {r["user_id"]: r["state"] for r in history.like_state(log).collect()} == expected


def test_a_song_added_again_counts_once(spark):
    log = spark.createDataFrame([], "user_id bigint, item_id bigint, ts timestamp, event_id bigint, intent boolean")
    songs = spark.sql(
        "SELECT 10L AS playlist_id, 1L AS user_id, 5L AS item_id, TIMESTAMP'2024-01-01 00:00:00' AS added_at "
        "UNION ALL SELECT 10L, 1L, 5L, TIMESTAMP'2024-01-03 00:00:00' UNION ALL SELECT 10L, 1L, 6L, TIMESTAMP'2024-01-03 00:00:00'"
    )
    counts = challenges.daily_counts(challenges.other_events(log, songs)).collect()
    assert {(str(r["day"]), r["type"]): r["n"] for r in counts} == {("2024-01-01", 2): 1, ("2024-01-01", 5): 1, ("2024-01-03", 2): 1}


def test_likes_that_clear_do_not_count(spark):
    """Each sequence of requests, dealt over many partitions, against a sequential count."""
    rows, expected = [], 0
    for user, sequence in enumerate(s for n in range(1, 6) for s in itertools.product([True, False], repeat=n)):
        state = None
        for i, wanted in enumerate(sequence):
            rows.append((user % 7, user, f"2024-01-01 00:{i:02d}:00", i, wanted))
            state = None if state == wanted else wanted
            expected += state is not None
    rows += [(9, 9, "2024-01-02 00:00:00", i, True) for i in range(301)]
    log = spark.createDataFrame(rows, "user_id bigint, item_id bigint, ts string, event_id bigint, intent boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    songs = spark.createDataFrame([], "playlist_id bigint, user_id bigint, item_id bigint, added_at timestamp")
    total = hot = 0
    for r in challenges.daily_counts(challenges.other_events(log, songs)).collect():
        hot, total = (hot + r["n"], total) if r["user_id"] == 9 else (hot, total + r["n"])
    assert (total, hot) == (expected, 151)


def test_preferred_language_string(spark):
    rows = [(7, 1, 1, 1), (4, 6, 0, 0), (2, 2, 2, 2), (0, 0, 0, 0), (3, 3, 2, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, b int, c int, d int")
    cols = dict(zip(languages.LANGUAGES, (F.col(c) for c in "abcd")))
    got = [r[0] for r in df.orderBy("i").select(languages.preferred_string(cols)).collect()]
    assert got == ["Chinese", "Chinese,English", "Chinese,English,Japanese,Korean", "Unknown", "Chinese,English"]


def test_profile_defaults(spark):
    users = spark.sql(
        "SELECT 1L AS user_id, 9 AS age, 'O' AS gender, CAST(NULL AS STRING) AS preferred_languages, CAST(NULL AS TIMESTAMP) AS created_at "
        "UNION ALL SELECT 2L, 81, 'F', 'Korean, Martian', TIMESTAMP'2020-01-01 00:00:00' UNION ALL SELECT 3L, 12, 'M', '', TIMESTAMP'2030-01-01 00:00:00'"
    )
    got = {r["user_id"]: r["tags"] for r in features.profile_tags(users, "2020-02-01 00:00:00").collect()}
    assert got[1] == ["bd_3", "gender_unknown", "ms_0"]
    assert got[2] == ["bd_3", "gender_female", "ms_1", "lang_pref_31"]
    assert got[3] == ["bd_1", "gender_male", "ms_0"]


def test_repeated_quantile_edges_make_one_bucket(spark):
    songs = spark.createDataFrame([(f"s{i}", 1000.0 if i < 8 else 2000.0) for i in range(10)], "song_id string, song_length double")
    assert {r["length_tag"] for r in features.length_bucket(songs).collect()} == {"len_0"}
