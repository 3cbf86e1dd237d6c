"""Queries over the catalogue, the members and the interaction log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import buckets, vectors
from ..operators import cleaning, features, ids, itemknn
from ..session import materialize
from ..sources.fixtures import Tables
from .registry import query

YEAR = 2025


def complete(t: Tables):
    return cleaning.complete_members(t.members_raw)


def member_features(t: Tables):
    return features.member_features(complete(t))


def song_merge(t: Tables):
    joined = cleaning.join_extras(t.songs_raw, t.song_extra)
    return cleaning.impute_songs(materialize(cleaning.missing_indicators(joined), "songs-joined"))


# --- loading and cleaning -----------------------------------------------------


@query("complete_members", "SELECT user_id, msno, city, bd, gender, registered_via FROM complete")
def _(t):
    return complete(t).select("user_id", "msno", "city", "bd", "gender", "registered_via")


@query(
    "known_id_whitelist",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE m.msno IS NOT NULL AND e.song_id IS NOT NULL) AS n_kept,
       count(*) FILTER (WHERE m.msno IS NULL) AS n_unknown_user,
       count(*) FILTER (WHERE m.msno IS NOT NULL AND e.song_id IS NULL) AS n_unknown_song
       FROM train_raw t LEFT JOIN complete m USING (msno) LEFT JOIN extra e USING (song_id)""",
)
def _(t):
    return cleaning.whitelist_report(t.train_raw, complete(t), t.song_extra)


@query("positive_pairs", "SELECT user_id, item_id FROM pos")
def _(t):
    return cleaning.positive_pairs(t.interactions)


@query(
    "min_item_freq",
    "SELECT user_id, item_id FROM pos QUALIFY count(*) OVER (PARTITION BY item_id) >= 20",
)
def _(t):
    return cleaning.min_item_freq(cleaning.positive_pairs(t.interactions), 20)


@query(
    "eligible_users",
    """SELECT user_id, item_id, target, order_id, line_no FROM inter
       WHERE user_id IN (SELECT user_id FROM inter WHERE target = 1 GROUP BY 1 HAVING count(*) >= 25)""",
)
def _(t):
    return cleaning.eligible_rows(t.interactions, 25).drop("ts")


@query(
    "implicit_positives",
    """SELECT DISTINCT user_id, item_id FROM hist h LEFT JOIN affinity a USING (user_id, item_id) LEFT JOIN likes l USING (user_id, item_id)
       WHERE coalesce(score, 0) > 0 OR watch_seconds > 30 OR coalesce(is_liked, FALSE)""",
)
def _(t):
    from .activity import plays_with_signals

    return cleaning.implicit_positives(plays_with_signals(t))


@query(
    "impute_songs",
    "SELECT song_id, song_length, genre_ids, artist_name, composer, lyricist, language, name, isrc, song_id_new FROM song_merge",
)
def _(t):
    return song_merge(t).select(
        "song_id", "song_length", "genre_ids", "artist_name", "composer", "lyricist", "language", "name", "isrc", "song_id_new"
    )


@query("missing_indicators", "SELECT song_id, has_isrc, has_genre, has_composer, has_lyricist, has_name, has_song_extra FROM song_ind")
def _(t):
    return cleaning.missing_indicators(cleaning.join_extras(t.songs_raw, t.song_extra)).select("song_id", *cleaning.INDICATORS)


_SONG_COLUMNS = ("song_id", "song_length", "genre_ids", "artist_name", "composer", "lyricist", "language")
PROFILED = {
    "song_extra": ("extra", ("song_id", "name", "isrc")),
    "songs": ("songs_raw", _SONG_COLUMNS),
    "song_merge": ("song_joined", (*_SONG_COLUMNS, "name", "isrc", "song_id_new")),
}


@query(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {source}"
        for name, (source, columns) in PROFILED.items()
        for c in columns
    ),
)
def _(t):
    """The three tables of the catalogue, the last one before its gaps are filled."""
    given = {"song_extra": t.song_extra, "songs": t.songs_raw, "song_merge": cleaning.join_extras(t.songs_raw, t.song_extra)}
    return reduce(DataFrame.unionByName, [cleaning.null_profile(given[name].select(*columns), name) for name, (_, columns) in PROFILED.items()])


def _measures(table: str, source: str, columns: dict[str, str]) -> str:
    names, values = ", ".join(f"'{c}'" for c in columns), ", ".join(columns.values())
    return f"SELECT '{table}' AS table_name, unnest([{names}]) AS measure, unnest([{values}])::DOUBLE AS value FROM {source}"


_ORIGIN = "(SELECT *, CASE WHEN starts_with(google_id, 'dev_') THEN 'seeded' ELSE 'real' END AS source_tag FROM users_t)"
_SIGNALS = "hist LEFT JOIN likes USING (user_id, item_id) LEFT JOIN affinity USING (user_id, item_id)"


@query(
    "load_profile",
    " UNION ALL ".join(
        [
            _measures("users", _ORIGIN, {
                "rows": "count(*)", "distinct_user_id": "count(DISTINCT user_id)", "filled_preferred_languages": "count(preferred_languages)",
                "source_tag_real": "count(*) FILTER (WHERE source_tag = 'real')", "source_tag_seeded": "count(*) FILTER (WHERE source_tag = 'seeded')",
            }),
            _measures("songs", "catalogue", {"rows": "count(*)", "distinct_item_id": "count(DISTINCT item_id)", "distinct_artist_id": "count(DISTINCT artist_id)", "filled_artist_name": "count(artist_name)"}),
            _measures("interactions", _SIGNALS, {
                "rows": "count(*)", "distinct_user_id": "count(DISTINCT user_id)", "distinct_item_id": "count(DISTINCT item_id)",
                "filled_is_liked": "count(is_liked)", "filled_affinity_score": "count(score)",
            }),
            _measures("onboarding", "(SELECT DISTINCT user_id, 'artist' AS kind, artist_id AS entity_id FROM picks JOIN catalogue USING (item_id) UNION ALL SELECT user_id, 'song', item_id FROM picks)", {
                "rows": "count(*)", "distinct_user_id": "count(DISTINCT user_id)", "kind_artist": "count(*) FILTER (WHERE kind = 'artist')", "kind_song": "count(*) FILTER (WHERE kind = 'song')",
            }),
        ]
    ),
)
def _(t):
    """All four tables that a run loads, users also by origin."""
    from .activity import onboarding, plays_with_signals

    profile = cleaning.load_profile
    return reduce(
        DataFrame.unionByName,
        [
            profile(cleaning.with_origin(t.users), "users", ["user_id"], ["preferred_languages"], {"source_tag": ["real", "seeded"]}),
            profile(t.catalogue, "songs", ["item_id", "artist_id"], ["artist_name"]),
            profile(plays_with_signals(t), "interactions", ["user_id", "item_id"], ["is_liked", "affinity_score"]),
            profile(onboarding(t), "onboarding", ["user_id"], [], {"kind": ["artist", "song"]}),
        ],
    )


@query("catalog_load_clean", "SELECT song_id_new AS song_id, name, artist_name FROM song_merge WHERE song_id_new >= 0")
def _(t):
    kept = cleaning.drop_placeholders(song_merge(t))
    return kept.select(F.col("song_id_new").alias("song_id"), "name", "artist_name")


@query(
    "catalog_sanitize",
    r"""SELECT doc_id, CASE WHEN contains(source || chr(10), chr(10)) AND doc_id % 10 = 0 THEN 'unknown' ELSE replace(source, '"', chr(39)) END AS artist_name,
       md5(regexp_replace(replace(text, '"', chr(39)), '[\r\n]+', ' ', 'g')) AS name_md5 FROM documents""",
)
def _(t):
    docs = t.raw("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("\n"))).otherwise(F.col("source")).alias("artist_name"),
        F.col("text").alias("name"),
    )
    return cleaning.sanitize_catalogue(docs).select("doc_id", "artist_name", F.md5("name").alias("name_md5"))


@query("filter_by_language", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def _(t):
    return cleaning.in_languages(t.raw("documents"), "fr, de, ,").select("doc_id", "lang")


@query(
    "profile_quality",
    """WITH p AS (SELECT user_id, trim(coalesce(nickname, '')) AS nick, gender, age, preferred_languages AS pl, user_id % 6 AS other FROM users_t),
       q AS (SELECT *, CASE WHEN pl IS NULL THEN CASE WHEN other < 3 THEN ['Other'] ELSE []::VARCHAR[] END
                 ELSE list_filter(list_transform(string_split(pl, ','), lambda x: trim(x)), lambda x: x <> '') || CASE WHEN other = 5 THEN ['Latin'] ELSE []::VARCHAR[] END END AS ls,
                CASE WHEN other = 2 THEN '泰文' WHEN other = 1 THEN 'Thai' END AS ol FROM p)
       SELECT user_id, CASE WHEN NOT regexp_full_match(nick, '[a-zA-Z0-9]{1,16}') THEN 'INVALID_NICKNAME'
         WHEN gender IS NULL OR gender NOT IN ('M', 'F', 'O') THEN 'INVALID_GENDER' WHEN age IS NULL OR age NOT BETWEEN 0 AND 150 THEN 'INVALID_AGE'
         WHEN len(ls) = 0 THEN 'INVALID_LANGUAGES'
         WHEN list_contains(ls, 'Other') AND NOT coalesce(regexp_full_match(ol, '[一-鿿]+文'), FALSE) THEN 'INVALID_OTHER_LANGUAGE'
         WHEN len(list_filter(ls, lambda x: x NOT IN ('Other', 'Chinese', 'English', 'Japanese', 'Korean'))) > 0 THEN 'INVALID_LANGUAGE_OPTION' END AS error_code
       FROM q""",
)
def _(t):
    from ..functions import languages

    other = F.col("user_id") % 6
    none = F.array().cast("array<string>")
    asked = F.when(
        F.col("preferred_languages").isNull(), F.when(other < 3, F.array(F.lit("Other"))).otherwise(none)
    ).otherwise(F.concat(languages.names(F.col("preferred_languages")), F.when(other == 5, F.array(F.lit("Latin"))).otherwise(none)))
    profiles = t.users.withColumns(
        {"languages": asked, "other_language": F.when(other == 2, "泰文").when(other == 1, "Thai")}
    )
    return cleaning.profile_quality(profiles).select("user_id", "error_code")


@query(
    "hash_sample",
    """SELECT user_id, item_id, order_id, line_no FROM inter
       WHERE ('0x' || substr(md5(user_id || '-' || item_id || '-42'), 1, 8))::BIGINT < 1288490188""",
)
def _(t):
    return cleaning.hash_sample(t.interactions, 0.3, 42, "user_id", "item_id").select("user_id", "item_id", "order_id", "line_no")


@query(
    "catalog_subset",
    """WITH s AS (SELECT * FROM catalogue WHERE item_id IN (SELECT item_id FROM ev))
       SELECT 'song' AS kind, item_id AS id FROM s UNION ALL SELECT 'artist', artist_id FROM artists WHERE artist_id IN (SELECT artist_id FROM s)""",
)
def _(t):
    songs, artists = cleaning.catalogue_subset(t.catalogue, t.artists, t.events)
    return songs.select(F.lit("song").alias("kind"), F.col("item_id").alias("id")).unionByName(
        artists.select(F.lit("artist").alias("kind"), F.col("artist_id").alias("id"))
    )


@query(
    "id_set_diff",
    """SELECT count(*) FILTER (WHERE a.item_id IS NOT NULL AND b.item_id IS NOT NULL) AS n_common,
       count(*) FILTER (WHERE b.item_id IS NULL) AS n_only_left, count(*) FILTER (WHERE a.item_id IS NULL) AS n_only_right
       FROM (SELECT DISTINCT item_id FROM inter) a FULL JOIN (SELECT DISTINCT item_id FROM items_v) b USING (item_id)""",
)
def _(t):
    return cleaning.id_set_diff(t.interactions, t.item_vectors, "item_id")


# --- encoding --------------------------------------------------------------------


@query(
    "label_encode",
    "SELECT msno, row_number() OVER (ORDER BY msno) - 1 AS msno_id FROM (SELECT DISTINCT msno FROM complete)",
)
def _(t):
    return ids.dense_ids(complete(t), "msno", "msno_id")


@query(
    "encode_sources",
    """WITH s AS (SELECT coalesce(source_system_tab, 'Unknown') AS a, source_screen_name AS b, source_type AS c FROM train_raw),
       x AS (SELECT dense_rank() OVER (ORDER BY a) - 1 AS source_system_tab, dense_rank() OVER (ORDER BY b) - 1 AS source_screen_name,
                    dense_rank() OVER (ORDER BY c) - 1 AS source_type FROM s)
       SELECT *, count(*) AS n FROM x GROUP BY 1, 2, 3""",
)
def _(t):
    names = ["source_system_tab", "source_screen_name", "source_type"]
    filled = t.train_raw.fillna("Unknown", names)
    out = filled
    for name in names:
        codes = ids.dense_ids(filled, name, f"{name}_id")
        out = ids.encode(out, name, codes, f"{name}_id").withColumnRenamed(f"{name}_id", name)
    return out.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query(
    "encode_interactions",
    """WITH m AS (SELECT msno, row_number() OVER (ORDER BY msno) - 1 AS msno_id FROM complete)
       SELECT msno_id, song_id_new AS song_id, target, count(*) AS n FROM train_raw JOIN m USING (msno) JOIN extra_ids USING (song_id) GROUP BY 1, 2, 3""",
)
def _(t):
    members = ids.dense_ids(complete(t), "msno", "msno_id")
    songs = ids.dense_ids(t.song_extra, "song_id", "song_id_new")
    coded = t.train_raw.select("msno", "song_id", "target").join(members, "msno").join(songs, "song_id")
    return coded.groupBy("msno_id", F.col("song_id_new").alias("song_id"), "target").agg(F.count(F.lit(1)).alias("n"))


# --- members ----------------------------------------------------------------------


@query("city_count", "SELECT city, count(*) AS city_count FROM complete GROUP BY 1")
def _(t):
    return features.city_count(complete(t))


@query("member_features", "SELECT * FROM member_feat")
def _(t):
    return member_features(t)


@query(
    "member_activity",
    """SELECT user_id, coalesce(n, 0) AS play_count, round(coalesce(n, 0) / greatest(membership_days, 1), 6) AS songs_per_day
       FROM member_feat LEFT JOIN (SELECT user_id, count(*) AS n FROM inter GROUP BY 1) USING (user_id)""",
)
def _(t):
    out = features.member_activity(member_features(t), t.interactions)
    return out.select("user_id", "play_count", F.round("songs_per_day", 6).alias("songs_per_day"))


@query(
    "user_feature_tags",
    """SELECT user_id, 'bd_' || bd_group || ',' || CASE WHEN gender_female = 1 THEN 'gender_female' WHEN gender_male = 1 THEN 'gender_male' ELSE 'gender_unknown' END
       || ',ms_' || membership_group AS tags FROM member_feat""",
)
def _(t):
    return features.user_tags(member_features(t)).select("user_id", F.array_join("tags", ",").alias("tags"))


PROFILE_TAGS = """
SELECT user_id, 'bd_' || CASE WHEN age IS NULL OR age < 10 OR age > 80 THEN 3 WHEN age <= 12 THEN 1 WHEN age <= 18 THEN 2 WHEN age <= 25 THEN 3
    WHEN age <= 35 THEN 4 WHEN age <= 50 THEN 5 ELSE 6 END
  || CASE gender WHEN 'F' THEN ',gender_female' WHEN 'M' THEN ',gender_male' ELSE ',gender_unknown' END
  || ',ms_' || CASE WHEN d IS NULL OR d <= 30 THEN 0 WHEN d <= 180 THEN 1 WHEN d <= 365 THEN 2 WHEN d <= 730 THEN 3 WHEN d <= 1825 THEN 4 WHEN d <= 3650 THEN 5 ELSE 6 END
  || CASE preferred_languages WHEN 'Chinese, English' THEN ',lang_pref_3,lang_pref_52' WHEN 'Japanese' THEN ',lang_pref_17'
     WHEN 'English,,Korean' THEN ',lang_pref_52,lang_pref_31' WHEN 'Chinese' THEN ',lang_pref_3' ELSE '' END AS tags
FROM (SELECT *, date_diff('day', created_at, TIMESTAMP '2001-01-01') AS d FROM users_t)"""
AS_OF = "2001-01-01 00:00:00"


@query("profile_tags", PROFILE_TAGS)
def _(t):
    return features.profile_tags(t.users, AS_OF).select("user_id", F.array_join("tags", ",").alias("tags"))


LANG_COUNTS = """
SELECT user_id, language, count(*) AS n FROM pos JOIN catalogue USING (item_id) WHERE language IN (3, 52, 17, 31) GROUP BY 1, 2"""


@query(
    "lang_pref_tags",
    f"""WITH c AS ({LANG_COUNTS}), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c)
        SELECT user_id, 'lang_pref_' || language AS tag, n, round(share, 6) AS share FROM s WHERE share >= 0.3""",
)
def _(t):
    out = features.language_tags(cleaning.positive_pairs(t.interactions), t.catalogue)
    return out.select("user_id", "tag", "n", F.round("share", 6).alias("share"))


PREFERRED = """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE language = 3) AS a, count(*) FILTER (WHERE language = 52) AS b,
                  count(*) FILTER (WHERE language = 17) AS c, count(*) FILTER (WHERE language = 31) AS d
           FROM {rows} LEFT JOIN catalogue USING (item_id) GROUP BY 1), s AS (SELECT *, a + b + c + d AS n FROM c)
SELECT user_id, CASE WHEN n = 0 THEN 'Unknown' WHEN a / n >= 0.7 THEN 'Chinese' WHEN b / n >= 0.7 THEN 'English' WHEN c / n >= 0.7 THEN 'Japanese'
    WHEN d / n >= 0.7 THEN 'Korean' WHEN greatest(a, b, c, d) / n >= 0.3 THEN concat_ws(',', CASE WHEN a / n >= 0.3 THEN 'Chinese' END,
    CASE WHEN b / n >= 0.3 THEN 'English' END, CASE WHEN c / n >= 0.3 THEN 'Japanese' END, CASE WHEN d / n >= 0.3 THEN 'Korean' END)
    ELSE 'Chinese,English,Japanese,Korean' END AS preferred_languages FROM s"""


@query("preferred_languages", PREFERRED.format(rows="pos"))
def _(t):
    return features.preferred_languages(cleaning.positive_pairs(t.interactions), t.catalogue)


@query(
    "members_with_language",
    f"""WITH top AS (SELECT user_id, count(*) AS like_count FROM inter WHERE target = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500),
        lk AS (SELECT i.user_id, i.item_id FROM inter i JOIN top USING (user_id) WHERE target = 1), pref AS ({PREFERRED.format(rows="lk")})
        SELECT user_id, like_count, bd_group, city_count, preferred_languages FROM top LEFT JOIN member_feat USING (user_id) LEFT JOIN pref USING (user_id)""",
)
def _(t):
    out = features.members_with_language(t.interactions, member_features(t), t.catalogue, 500)
    return out.select("user_id", "like_count", "bd_group", "city_count", "preferred_languages")


@query(
    "top_active_users",
    """WITH top AS (SELECT user_id, n AS play_count FROM member_feat JOIN (SELECT user_id, count(*) AS n FROM inter GROUP BY 1) USING (user_id)
         WHERE membership_days > 30 ORDER BY n DESC, user_id LIMIT 300)
       SELECT user_id, play_count, count(*) AS n_rows, sum(target)::BIGINT AS n_pos FROM top JOIN inter USING (user_id) GROUP BY 1, 2""",
)
def _(t):
    rows = itemknn_top_rows(t, 300)
    return rows.groupBy("user_id", "play_count").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("n_pos"))


def itemknn_top_rows(t: Tables, n: int):
    """Interactions of the most active members with more than 30 days of membership."""
    active = features.member_activity(member_features(t).select("user_id", "membership_days"), t.interactions)
    top = (
        active.filter(F.coalesce("membership_days", F.lit(0)) > 30)
        .filter("play_count > 0")
        .orderBy(F.desc("play_count"), "user_id")
        .limit(n)
        .select("user_id", "play_count")
    )
    return t.interactions.join(top, "user_id")


@query(
    "profile_backfill",
    f"""WITH mp AS (SELECT 'site-' || user_id AS site_user, user_id FROM member_feat), pref AS ({PREFERRED.format(rows="pos")}),
        f AS (SELECT user_id, item_id FROM pos JOIN mp USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 100),
        k AS (SELECT user_id, count(*) AS n FROM f JOIN catalogue USING (item_id) GROUP BY 1)
        SELECT site_user, user_id, CASE bd_group WHEN 1 THEN 10 WHEN 2 THEN 16 WHEN 3 THEN 22 WHEN 4 THEN 30 WHEN 5 THEN 43 WHEN 6 THEN 60 END AS age,
        CASE WHEN gender_male = 1 THEN 'M' WHEN gender_female = 1 THEN 'F' ELSE 'O' END AS gender, preferred_languages, coalesce(n, 0) AS n_songs
        FROM mp JOIN member_feat USING (user_id) LEFT JOIN pref USING (user_id) LEFT JOIN k USING (user_id)""",
)
def _(t):
    pos = cleaning.positive_pairs(t.interactions)
    members = member_features(t).join(features.preferred_languages(pos, t.catalogue), "user_id", "left")
    mapping = members.select(F.concat(F.lit("site-"), F.col("user_id").cast("string")).alias("site_user"), "user_id")
    return features.profile_backfill(mapping, members, pos, t.catalogue)


# --- songs -----------------------------------------------------------------------


@query(
    "song_merge",
    """WITH a AS (SELECT artist_name, row_number() OVER (ORDER BY artist_name) AS artist_id FROM (SELECT DISTINCT artist_name FROM song_merge))
       SELECT song_id, song_id_new, song_length, artist_name, artist_id, has_song_extra FROM song_merge JOIN a USING (artist_name)""",
)
def _(t):
    songs = song_merge(t)
    artists = features.artist_table(songs).select("artist_name", "artist_id")
    return songs.join(artists, "artist_name").select(
        "song_id", "song_id_new", "song_length", "artist_name", "artist_id", "has_song_extra"
    )


@query("artist_popularity", "SELECT artist_name, count(*) AS artist_popularity, round(ln(1 + count(*)), 6) AS artist_popularity_log FROM song_merge GROUP BY 1")
def _(t):
    return features.artist_popularity(song_merge(t)).withColumn("artist_popularity_log", F.round("artist_popularity_log", 6))


@query(
    "artist_table",
    """SELECT artist_name, count(*) AS artist_popularity, round(ln(1 + count(*)), 6) AS artist_popularity_log,
       row_number() OVER (ORDER BY artist_name) AS artist_id FROM song_merge GROUP BY 1""",
)
def _(t):
    return features.artist_table(song_merge(t)).withColumn("artist_popularity_log", F.round("artist_popularity_log", 6))


@query(
    "artist_indie_ratio",
    """SELECT artist_name, round(avg((composer <> 'unknown' AND composer <> artist_name)::INT), 6) AS composer_diff_ratio,
       round(avg((lyricist <> 'unknown' AND lyricist <> artist_name)::INT), 6) AS lyricist_diff_ratio FROM song_merge GROUP BY 1""",
)
def _(t):
    out = features.artist_indie_ratio(song_merge(t))
    return out.select("artist_name", *[F.round(c, 6).alias(c) for c in ("composer_diff_ratio", "lyricist_diff_ratio")])


@query(
    "isrc_features",
    """SELECT song_id, has_valid_isrc, isrc_country, isrc_registrant, isrc_year, isrc_item_id, isrc_year_full, 2025 - isrc_year_full AS song_age FROM song_isrc""",
)
def _(t):
    return features.isrc_features(song_merge(t), YEAR).select(
        "song_id", "has_valid_isrc", "isrc_country", "isrc_registrant", "isrc_year", "isrc_item_id", "isrc_year_full", "song_age"
    )


GENRES = """
g AS (SELECT song_id, CASE WHEN genre_ids = 'unknown' THEN []::VARCHAR[] ELSE string_split(genre_ids, '|') END AS l FROM song_merge),
v AS (SELECT list(DISTINCT x ORDER BY x) AS voc FROM (SELECT unnest(l) AS x FROM g))"""


@query(
    "genre_features",
    f"""WITH {GENRES} SELECT song_id, array_to_string(l, '|') AS genre_list, len(l) AS genre_count,
        array_to_string(list_transform(voc, lambda x: CASE WHEN list_contains(l, x) THEN '1' ELSE '0' END), '') AS genre_vector FROM g, v""",
)
def _(t):
    songs = song_merge(t)
    out = features.genre_features(songs, features.genre_vocabulary(songs))
    return out.select(
        "song_id",
        F.array_join("genre_list", "|").alias("genre_list"),
        "genre_count",
        F.array_join(F.transform("genre_vector", lambda x: x.cast("string")), "").alias("genre_vector"),
    )


@query(
    "metadata_scores",
    """SELECT song_id, has_name + has_genre + has_composer + has_lyricist + has_isrc + has_song_extra AS metadata_score,
       has_name + has_genre + has_composer + has_lyricist + has_valid_isrc + has_song_extra AS metadata_score_strict FROM song_isrc""",
)
def _(t):
    coded = features.isrc_features(song_merge(t), YEAR)
    return features.metadata_scores(coded).select("song_id", "metadata_score", "metadata_score_strict")


@query(
    "song_features",
    f"""WITH {GENRES}, p AS (SELECT artist_name, count(*) AS artist_popularity FROM song_merge GROUP BY 1)
        SELECT s.song_id, isrc_country, 2025 - isrc_year_full AS song_age, len(l) AS genre_count, artist_popularity, round(ln(1 + artist_popularity), 6) AS artist_popularity_log,
        has_name + has_genre + has_composer + has_lyricist + has_isrc + has_song_extra AS metadata_score
        FROM song_isrc s JOIN g USING (song_id) JOIN p USING (artist_name)""",
)
def _(t):
    out = features.song_features(song_merge(t), YEAR)
    return out.select(
        "song_id", "isrc_country", "song_age", "genre_count", "artist_popularity",
        F.round("artist_popularity_log", 6).alias("artist_popularity_log"), "metadata_score",
    )


@query(
    "length_bin",
    """SELECT song_id, CASE WHEN m < 1 THEN '0-1' WHEN m < 2 THEN '1-2' WHEN m < 3 THEN '2-3' WHEN m < 4 THEN '3-4' WHEN m < 5 THEN '4-5' WHEN m < 300 THEN '5+' END AS length_bin
       FROM (SELECT song_id, song_length / 60000 AS m FROM song_merge)""",
)
def _(t):
    return song_merge(t).select("song_id", buckets.length_label(F.col("song_length")).alias("length_bin"))


LENGTH = """
e AS (SELECT quantile_cont(coalesce(song_length, m), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q, any_value(m) AS m
      FROM songs_raw, (SELECT median(song_length) AS m FROM songs_raw)),
b AS (SELECT s.*, CASE WHEN len(list_distinct(q)) < 6 THEN 'len_0' WHEN x <= q[2] THEN 'len_0' WHEN x <= q[3] THEN 'len_1' WHEN x <= q[4] THEN 'len_2'
        WHEN x <= q[5] THEN 'len_3' ELSE 'len_4' END AS length_tag FROM (SELECT r.*, coalesce(song_length, m) AS x, q FROM songs_raw r, e) s)"""


@query("length_quantile_bucket", f"WITH {LENGTH} SELECT song_id, length_tag FROM b")
def _(t):
    return features.length_bucket(t.songs_raw).select("song_id", "length_tag")


ITEM_TAGS = f"""{LENGTH},
ta AS (SELECT artist_name FROM songs_raw WHERE artist_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
it AS (SELECT song_id, ['lang_' || coalesce(language::INT, -1), CASE WHEN ta.artist_name IS NULL THEN 'artist_other' ELSE 'artist_' || b.artist_name END, length_tag]
    || CASE WHEN genre_ids IS NULL OR genre_ids = 'unknown' THEN ['genre_unknown'] ELSE list_transform(list_filter(string_split(genre_ids, '|'), lambda x: x <> ''), lambda x: 'genre_' || x) END AS tags
    FROM b LEFT JOIN ta USING (artist_name))"""


@query("item_feature_tags", f"WITH {ITEM_TAGS} SELECT song_id, array_to_string(tags, ',') AS tags FROM it")
def _(t):
    tagged = features.item_tags(t.songs_raw, top_artists=10)
    return features.default_item_tags(t.songs_raw, tagged).select("song_id", F.array_join("tags", ",").alias("tags"))


@query(
    "tag_vocabulary",
    f"""WITH {ITEM_TAGS}, ut AS (SELECT unnest(['bd_' || bd_group, CASE WHEN gender_female = 1 THEN 'gender_female' ELSE 'gender_male' END, 'ms_' || membership_group]) AS tag FROM member_feat)
        SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_id FROM (SELECT unnest(tags) AS tag FROM it UNION SELECT tag FROM ut)""",
)
def _(t):
    return features.tag_vocabulary(features.item_tags(t.songs_raw, top_artists=10), features.user_tags(member_features(t)))


# --- counts and distributions -------------------------------------------------------


@query("play_counts", "SELECT item_id, count(*) AS n_plays, count(DISTINCT user_id) AS n_users FROM inter GROUP BY 1")
def _(t):
    return t.interactions.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_plays"), F.count_distinct("user_id").alias("n_users")
    )


@query("item_popularity", "SELECT item_id, count(*) AS pop FROM pos GROUP BY 1")
def _(t):
    return itemknn.item_popularity(cleaning.positive_pairs(t.interactions))


@query(
    "sparsity",
    """SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows,
       round(1 - count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS sparsity FROM inter""",
)
def _(t):
    # Two separate distinct counts expand every row twice; the sets themselves are small.
    users = t.interactions.select("user_id").distinct().agg(F.count(F.lit(1)))
    items = t.interactions.select("item_id").distinct().agg(F.count(F.lit(1)))
    out = t.interactions.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"n_users": users.scalar(), "n_items": items.scalar()}
    )
    filled = F.col("n_rows") / (F.col("n_users") * F.col("n_items"))
    return out.select("n_users", "n_items", "n_rows", F.round(1 - filled, 6).alias("sparsity"))


@query(
    "pareto_head",
    """WITH c AS (SELECT item_id, count(*) AS n FROM inter GROUP BY 1),
       r AS (SELECT row_number() OVER w AS rk, sum(n) OVER w / (SELECT sum(n) FROM c) AS share FROM c WINDOW w AS (ORDER BY n DESC, item_id ROWS UNBOUNDED PRECEDING))
       SELECT min(rk) AS head_items, round(min(rk) / (SELECT count(*) FROM c), 6) AS head_fraction FROM r WHERE share >= 0.8""",
)
def _(t):
    counts = t.interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = ids.running_sum(counts, [F.desc("n"), F.col("item_id")], "n", "cum", "rk")
    total = t.interactions.agg(F.count(F.lit(1))).scalar()
    n_items = t.interactions.select("item_id").distinct().agg(F.count(F.lit(1))).scalar()
    head = ranked.filter(F.col("cum") / total >= 0.8).agg(F.min("rk").alias("head_items"))
    return head.withColumn("head_fraction", F.round(F.col("head_items") / n_items, 6))


@query("year_histogram", "SELECT (isrc_year_full // 10) * 10 AS decade, count(*) AS n, min(isrc_year_full) AS first_year, max(isrc_year_full) AS last_year FROM song_isrc WHERE isrc_year_full IS NOT NULL GROUP BY 1")
def _(t):
    coded = features.isrc_features(song_merge(t), YEAR).filter(F.col("isrc_year_full").isNotNull())
    decade = (F.floor(F.col("isrc_year_full") / 10) * 10).alias("decade")
    return coded.groupBy(decade).agg(
        F.count(F.lit(1)).alias("n"), F.min("isrc_year_full").alias("first_year"), F.max("isrc_year_full").alias("last_year")
    )


@query("country_top20", "SELECT isrc_country, count(*) AS n FROM song_isrc WHERE has_valid_isrc = 1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def _(t):
    coded = features.isrc_features(song_merge(t), YEAR).filter("has_valid_isrc = 1")
    return coded.groupBy("isrc_country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "isrc_country").limit(20)
