"""Queries over the site's events: plays, likes, playlists, challenges, friends, exports, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinity, challenges, cleaning, external, history, itemknn, postings, rerank, search, splits
from ..session import materialize, once, run_dir
from ..sources import runs
from ..sources.fixtures import SOURCES, Tables
from .ctes import knn_recs
from .registry import query


def likes(t: Tables):
    return history.current_likes(t.like_log)


def affinities(t: Tables):
    return affinity.affinity_scores(t.history, likes(t), history.favorites(t.playlist_songs))


def plays_with_signals(t: Tables):
    """Plays with the pair's like and affinity: two joins on unique keys."""
    liked = likes(t).select("user_id", "item_id", F.col("is_liked").cast("int").alias("is_liked"))
    scored = affinities(t).select("user_id", "item_id", F.col("score").alias("affinity_score"))
    keys = ["user_id", "item_id"]
    return t.history.join(liked, keys, "left").join(scored, keys, "left")


# --- affinity and history -----------------------------------------------------


@query("affinity_scores", "SELECT user_id, item_id, total_watch_seconds, skip_count, is_favorited, like_state, score FROM affinity")
def _(t):
    return affinities(t)


@query(
    "recent_history",
    """WITH l AS (SELECT id, user_id, item_id, watch_seconds, source, played_at FROM vis QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY played_at DESC, id DESC) = 1)
       SELECT id, user_id, item_id, watch_seconds, source, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at, (SELECT count(*) FROM l) AS total
       FROM l ORDER BY l.played_at DESC, id DESC LIMIT 50 OFFSET 50""",
)
def _(t):
    return history.recent_history(t.visible, offset=50, limit=200)


@query(
    "replay_flags",
    """SELECT id, user_id, item_id, (row_number() OVER (PARTITION BY user_id, item_id ORDER BY played_at, id) > 1)::BIGINT AS is_replay FROM vis""",
)
def _(t):
    return history.replay_flags(t.visible).select("id", "user_id", "item_id", "is_replay")


@query(
    "play_length_final",
    "SELECT user_id || '-' || item_id || '-' || strftime(ts, '%Y%m%d') AS history_id, max(seconds) AS watch_seconds FROM ev GROUP BY 1",
)
def _(t):
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return history.final_play_length(t.events.select(key.alias("history_id"), F.col("seconds").alias("watch_seconds")))


@query("like_state", "SELECT user_id, item_id, state::BIGINT AS state FROM like_end")
def _(t):
    return history.like_state(t.like_log)


@query(
    "favorites_list",
    "SELECT user_id, item_id, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at, title, artist_name FROM favs JOIN catalogue USING (item_id)",
)
def _(t):
    return history.favorites_list(t.playlist_songs, t.catalogue).select("user_id", "item_id", "added_at", "title", "artist_name")


@query(
    "favorite_flags",
    """SELECT id, user_id, item_id, (f.user_id IS NOT NULL)::BIGINT AS is_favorited FROM vis v LEFT JOIN favs f USING (user_id, item_id)""",
)
def _(t):
    flagged = history.favorite_flag(t.visible, history.favorites(t.playlist_songs))
    return flagged.select("id", "user_id", "item_id", "is_favorited")


@query(
    "playlist_counts",
    """SELECT playlist_id, user_id, playlist_name, count(DISTINCT item_id) AS n_songs FROM pl LEFT JOIN (SELECT playlist_id, item_id FROM pls) USING (playlist_id)
       WHERE lower(trim(playlist_name)) <> 'archive' GROUP BY 1, 2, 3""",
)
def _(t):
    return history.playlist_counts(t.playlists, t.playlist_songs)


@query(
    "latest_batch_items",
    """WITH b AS (SELECT o_custkey AS user_id, o_orderkey AS batch_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       SELECT user_id, batch_id, l_linenumber AS rank, l_partkey AS item_id, title, l_extendedprice AS score
       FROM b JOIN lineitem ON l_orderkey = batch_id JOIN catalogue ON item_id = l_partkey WHERE l_linenumber <= 9""",
)
def _(t):
    return history.latest_batch_items(t.batches, t.batch_items, t.catalogue).select(
        "user_id", "batch_id", "rank", "item_id", "title", "score"
    )


@query(
    "unlock_flags",
    """SELECT user_id, count(DISTINCT item_id) AS n_songs, count(*) FILTER (WHERE source = 'RECOMMENDATION') AS n_recommendation, count(*) FILTER (WHERE source = 'SEARCH') AS n_search,
       count(*) FILTER (WHERE source = 'PLAYLIST') AS n_playlist, count(*) FILTER (WHERE source = 'ONBOARDING') AS n_onboarding, count(*) FILTER (WHERE source = 'FRIEND') AS n_friend,
       (count(DISTINCT item_id) >= 5)::BIGINT AS unlock_5, (count(DISTINCT item_id) >= 10)::BIGINT AS unlock_10 FROM hist GROUP BY 1""",
)
def _(t):
    return history.unlock_flags(t.history)


@query(
    "friends_listening",
    """WITH l AS (SELECT user_id AS friend_id, item_id, played_at FROM vis QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, id DESC) = 1)
       SELECT e.user_id, friend_id, coalesce(nullif(nickname, ''), google_name) AS friend_name, item_id, title, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at
       FROM edges e JOIN l USING (friend_id) JOIN users_t u ON u.user_id = friend_id JOIN catalogue USING (item_id)""",
)
def _(t):
    return history.friends_listening(t.friendships, t.visible, t.catalogue, t.users).select(
        "user_id", "friend_id", "friend_name", "item_id", "title", "played_at"
    )


# --- request quality ------------------------------------------------------------


@query(
    "event_quality",
    """SELECT event_id, CASE WHEN r.item_id IS NULL THEN 'MISSING_SONG_ID' WHEN watch_seconds IS NULL THEN 'MISSING_WATCH_SECONDS' WHEN coalesce(source, '') = '' THEN 'MISSING_SOURCE'
       WHEN source NOT IN ('RECOMMENDATION', 'SEARCH', 'PLAYLIST', 'ONBOARDING', 'FRIEND') THEN 'INVALID_SOURCE' WHEN c.item_id IS NULL THEN 'SONG_NOT_FOUND'
       WHEN TRY_CAST(watch_seconds AS INT) IS NULL OR TRY_CAST(watch_seconds AS INT) < 0 THEN 'INVALID_WATCH_SECONDS' END AS error_code
       FROM requests r LEFT JOIN catalogue c USING (item_id)""",
)
def _(t):
    return cleaning.play_quality(t.play_requests, t.catalogue, list(SOURCES.values())).select("event_id", "error_code")


# --- challenges --------------------------------------------------------------------


def challenge_counts(t: Tables):
    events = challenges.play_events(t.visible).unionByName(challenges.other_events(t.like_log, t.playlist_songs))
    return challenges.daily_counts(events)


def challenge_days(t: Tables):
    return t.events.select("user_id", challenges.local_day(F.col("ts")).alias("day")).distinct()


def challenge_progress(t: Tables):
    return challenges.chain(challenge_days(t), challenge_counts(t))


COUNTS = """
lp AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY played_at, id) > 1 AS again FROM vis),
lr AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, item_id, intent ORDER BY ts, event_id) AS run FROM like_log),
lk AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, intent, run ORDER BY ts, event_id) AS place FROM lr),
ce AS (SELECT user_id, played_at AS ts, unnest(list_filter([1, CASE WHEN source = 'RECOMMENDATION' THEN 6 END, CASE WHEN again THEN 4 END], lambda x: x IS NOT NULL)) AS type
       FROM lp WHERE watch_seconds >= 120
  UNION ALL SELECT user_id, ts, 3 FROM lk WHERE place % 2 = 1 UNION ALL SELECT user_id, min(added_at), 2 FROM pls GROUP BY playlist_id, user_id, item_id
  UNION ALL SELECT user_id, min(added_at), 5 FROM pls GROUP BY playlist_id, user_id),
cn AS (SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, type, count(*) AS n FROM ce GROUP BY 1, 2, 3)"""


def _offers(days: str, name: str) -> str:
    key = "user_id || '-' || strftime(day, '%Y%m%d') || '-' || type"
    return f"""{name} AS (SELECT user_id, day, type, md5({key} || '-42') AS h, lo + ('0x' || substr(md5({key} || '-n42'), 1, 8))::BIGINT % (hi - lo + 1) AS target
    FROM {days}, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS type, unnest([1, 1, 1, 1, 1, 1]) AS lo, unnest([5, 5, 5, 3, 3, 5]) AS hi))"""


def _state(kept: str, offers: str) -> str:
    """A day's challenges: what was kept, then as many of the offers of other types as are left."""
    open_ = f"list_transform({kept}, lambda x: {{'type': x.type, 'target': x.target, 'carried': 1}})"
    drawn = f"list_filter({offers}, lambda o: NOT list_contains(list_transform({kept}, lambda x: x.type), o.type))[:3 - len({kept})]"
    return f"list_concat({open_}, list_transform({drawn}, lambda o: {{'type': o.type, 'target': o.target, 'carried': 0}}))"


PROGRESS = f"""{COUNTS}, dy AS (SELECT DISTINCT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM ev), {_offers("dy", "ofr")},
cl AS (SELECT user_id, day, [{", ".join(f"coalesce(sum(n) FILTER (WHERE type = {t}), 0)::BIGINT" for t in range(1, 7))}] AS ns FROM cn GROUP BY 1, 2),
dd AS MATERIALIZED (SELECT o.user_id, o.day, offers, coalesce(ns, [0, 0, 0, 0, 0, 0]) AS ns
       FROM (SELECT user_id, day, list({{'type': type, 'target': target}} ORDER BY h, type) AS offers FROM ofr GROUP BY 1, 2) o LEFT JOIN cl USING (user_id, day)),
ch AS (SELECT user_id, day, ns, {_state("offers[:0]", "offers")} AS state FROM dd
       WHERE NOT EXISTS (SELECT 1 FROM dy WHERE dy.user_id = dd.user_id AND dy.day = CAST(dd.day - INTERVAL 1 DAY AS DATE))
       UNION ALL SELECT user_id, day, ns, {_state("kept", "offers")} AS state
       FROM (SELECT dd.*, list_transform(list_filter(ch.state, lambda x: ch.ns[x.type] < x.target), lambda x: {{'type': x.type, 'target': x.target}}) AS kept
             FROM ch JOIN dd ON dd.user_id = ch.user_id AND dd.day = CAST(ch.day + INTERVAL 1 DAY AS DATE))),
pr AS (SELECT user_id, day, c.type, c.target, c.carried, least(ns[c.type], c.target) AS current_count, (ns[c.type] >= c.target)::BIGINT AS is_completed
       FROM (SELECT user_id, day, ns, unnest(state) AS c FROM ch))"""
CHAIN_SQL = f"WITH RECURSIVE {PROGRESS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, type, target, carried, current_count, is_completed FROM pr"


@query("challenge_events", f"WITH {COUNTS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, type, n FROM cn")
def _(t):
    return challenge_counts(t)


@query("challenge_progress", CHAIN_SQL)
def _(t):
    return challenge_progress(t)


@query(
    "challenge_assignment",
    f"""WITH RECURSIVE {PROGRESS}, nx AS (SELECT user_id, CAST(day + INTERVAL 1 DAY AS DATE) AS day, type, target, is_completed FROM pr),
        nd AS (SELECT user_id, day, sum(is_completed) AS need FROM nx GROUP BY 1, 2), {_offers("nd", "of2")},
        dn AS (SELECT o.* FROM of2 o LEFT JOIN (SELECT * FROM nx WHERE is_completed = 0) c USING (user_id, day, type) WHERE c.user_id IS NULL
               QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY h, type) <= (SELECT need FROM nd WHERE nd.user_id = o.user_id AND nd.day = o.day))
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, type, target, 1 AS carried FROM nx WHERE is_completed = 0
        UNION ALL SELECT user_id, strftime(day, '%Y-%m-%d'), type, target, 0 FROM dn""",
)
def _(t):
    return challenges.next_day(challenge_progress(t))


@query(
    "xp_levels",
    f"""WITH RECURSIVE {PROGRESS}, x AS (SELECT user_id, least(5 * sum(is_completed), 800)::BIGINT AS xp FROM pr GROUP BY 1)
        SELECT user_id, xp, 1 + (xp >= 50)::INT + (xp >= 100)::INT + (xp >= 200)::INT + (xp >= 400)::INT + (xp >= 800)::INT AS lv,
        xp - CASE WHEN xp >= 800 THEN 800 WHEN xp >= 400 THEN 400 WHEN xp >= 200 THEN 200 WHEN xp >= 100 THEN 100 WHEN xp >= 50 THEN 50 ELSE 0 END AS xp_in_level,
        CASE WHEN xp < 50 THEN 50 WHEN xp < 100 THEN 50 WHEN xp < 200 THEN 100 WHEN xp < 400 THEN 200 WHEN xp < 800 THEN 400 END AS xp_for_level FROM x""",
)
def _(t):
    return challenges.xp_levels(challenge_progress(t))


# --- exports -------------------------------------------------------------------------


@query(
    "export_users",
    """SELECT user_id, google_id, email, nickname, age, gender, coalesce(preferred_languages, '') AS preferred_languages, profile_completed, google_name,
       CASE WHEN starts_with(google_id, 'dev_') THEN 'seeded' ELSE 'real' END AS source_tag, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM users_t""",
)
def _(t):
    return cleaning.with_origin(t.users).fillna("", ["preferred_languages"])


@query(
    "export_songs",
    """SELECT item_id AS song_id, title AS song_title, artist_id, coalesce(nullif(c.artist_name, ''), a.artist_name) AS artist_name, album_name, language
       FROM catalogue c LEFT JOIN artists a USING (artist_id)""",
)
def _(t):
    names = t.artists.withColumnRenamed("artist_name", "known_name")
    name = F.coalesce(F.when(F.col("artist_name") != "", F.col("artist_name")), "known_name")
    return t.catalogue.join(names, "artist_id", "left").select(
        F.col("item_id").alias("song_id"), F.col("title").alias("song_title"), "artist_id", name.alias("artist_name"), "album_name", "language"
    )


@query(
    "export_interactions",
    """SELECT user_id, item_id AS song_id, source, watch_seconds, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at, is_liked::BIGINT AS is_liked, score AS affinity_score
       FROM hist LEFT JOIN likes USING (user_id, item_id) LEFT JOIN affinity USING (user_id, item_id)""",
)
def _(t):
    return plays_with_signals(t).select(
        "user_id", F.col("item_id").alias("song_id"), "source", "watch_seconds", "played_at", "is_liked", "affinity_score"
    )


@query(
    "export_onboarding",
    """SELECT DISTINCT user_id, 'artist' AS kind, artist_id AS entity_id FROM picks JOIN catalogue USING (item_id)
       UNION ALL SELECT user_id, 'song', item_id FROM picks""",
)
def _(t):
    return onboarding(t)


def onboarding(t: Tables):
    """Artists and songs that users picked when they joined."""
    from .recommend import picks

    chosen = picks(t)
    artists = chosen.join(t.catalogue, "item_id").select("user_id", F.lit("artist").alias("kind"), F.col("artist_id").alias("entity_id")).distinct()
    return artists.unionByName(chosen.select("user_id", F.lit("song").alias("kind"), F.col("item_id").alias("entity_id")))


# --- rules of the recommendation page ---------------------------------------------------


@query(
    "recalc_due",
    """SELECT user_id, coalesce(h, 0) AS n_history, coalesce(b, 0) AS n_batches, (coalesce(b, 0) = 0 OR coalesce(h, 0) // 10 > coalesce(b, 0) - 1)::BIGINT AS is_due
       FROM users_t LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS h FROM hist GROUP BY 1) USING (user_id)
       LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS b FROM orders GROUP BY 1) USING (user_id)""",
)
def _(t):
    return rerank.recalc_due(t.users, t.history, t.batches)


# --- search ----------------------------------------------------------------------------


def _relevance(text: str, query_text: str) -> str:
    return " + ".join(f"contains({text}, '{g}')::BIGINT" for g in search.bigrams(query_text))


@query(
    "search_ngram",
    f"""SELECT item_id, title, {_relevance("lower(concat_ws(' ', title, artist_name))", "red widget brand")} AS relevance FROM catalogue
        WHERE relevance > 0 ORDER BY relevance DESC, item_id LIMIT 20""",
)
def _(t):
    return search.ngram(t.catalogue, "item_id", ["title", "artist_name"], "red widget brand").select("item_id", "title", "relevance")


@query(
    "search_ngram_documents",
    f"""SELECT doc_id, lang, {_relevance("lower(text)", "être eauou thorreou")} AS relevance FROM documents
        WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 20""",
)
def _(t):
    return search.ngram(t.raw("documents"), "doc_id", ["text"], "être eauou thorreou").select("doc_id", "lang", "relevance")


INDEXED = "quartz être eauou thorreou red"


@query(
    "search_indexed_documents",
    f"""SELECT doc_id, lang, {_relevance("lower(text)", INDEXED)} AS relevance FROM documents
        WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 20""",
)
def _(t):
    docs = t.raw("documents")
    index = once(t.spark, ("postings", t.sf_dir), lambda: postings.build(docs, "doc_id", ["text"]))
    found = postings.top_page(index, INDEXED)
    return docs.select("doc_id", "lang").join(found.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "lang", "relevance")


@query(
    "search_contains",
    """SELECT item_id, title, artist_name FROM catalogue WHERE contains(lower(title), 'brand#2') OR contains(lower(artist_name), 'brand#2') ORDER BY item_id LIMIT 20""",
)
def _(t):
    found = search.contains(t.catalogue, "item_id", "title", "artist_name", "BRAND#2")
    return found.select("item_id", "title", "artist_name")


# --- external metadata -------------------------------------------------------------------


@query(
    "external_dedupe",
    """SELECT isrc, wd_qid, doc_id, (desc_en IS NULL)::BIGINT AS no_description FROM ext_matched
       QUALIFY row_number() OVER (PARTITION BY isrc ORDER BY desc_en IS NULL, doc_id) = 1""",
)
def _(t):
    out = external.dedupe(external.matched(t.external))
    return out.select("isrc", "wd_qid", "doc_id", F.col("desc_en").isNull().alias("no_description"))


@query(
    "external_uniq_join",
    """SELECT isrc, string_agg(v, ' || ' ORDER BY o) AS label_en FROM (SELECT isrc, trim(label_en) AS v, min(doc_id) AS o FROM ext_matched WHERE trim(label_en) <> '' GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return external.uniq_join(external.matched(t.external), "label_en")


@query(
    "external_flags",
    r"""SELECT isrc, max(regexp_matches(lower(coalesce(desc_en, '')), '\b(feat\.|featuring|ft\.?)\b')::BIGINT) AS has_feat,
        max(contains(lower(coalesce(type_label, '')), 'single')::BIGINT) AS is_single, max(contains(lower(coalesce(type_label, '')), 'with vocals')::BIGINT) AS has_vocal
        FROM ext_matched GROUP BY 1""",
)
def _(t):
    return external.flags(external.matched(t.external))


def _metadata(t: Tables):
    rows = external.matched(t.external)
    return external.flags(rows).join(external.uniq_join(rows, "type_label"), "isrc", "left")


MATCH = r"""
SELECT song_id, f.isrc AS code, type_label, has_feat, is_single, has_vocal FROM extra s {how} JOIN
  (SELECT isrc, max(regexp_matches(lower(coalesce(desc_en, '')), '\b(feat\.|featuring|ft\.?)\b')::BIGINT) AS has_feat,
   max(contains(lower(coalesce(type_label, '')), 'single')::BIGINT) AS is_single, max(contains(lower(coalesce(type_label, '')), 'with vocals')::BIGINT) AS has_vocal
   FROM ext_matched GROUP BY 1) f ON f.isrc = upper(trim(s.isrc)) LEFT JOIN
  (SELECT isrc, string_agg(v, ' || ' ORDER BY o) AS type_label FROM (SELECT isrc, trim(type_label) AS v, min(doc_id) AS o FROM ext_matched WHERE trim(type_label) <> '' GROUP BY 1, 2) GROUP BY 1) e
  ON e.isrc = f.isrc"""


def _matched_songs(t: Tables, how: str):
    out = external.match_songs(t.song_extra, _metadata(t), how)
    code = F.when(F.col("is_single").isNotNull(), F.col("match_key"))
    return out.select("song_id", code.alias("code"), "type_label", "has_feat", "is_single", "has_vocal")


@query("external_match_inner", MATCH.format(how=""))
def _(t):
    return _matched_songs(t, "inner")


@query("external_match_left", MATCH.format(how="LEFT"))
def _(t):
    return _matched_songs(t, "left")


# --- stored runs --------------------------------------------------------------------


def _stored_runs(t: Tables) -> str:
    """Two runs of ItemKNN over the onboarding songs: all users, then again those of even ids with ten rows; the first is repeated."""
    path = run_dir(t.spark, "stored-runs")
    picks = materialize(splits.first_seeds(t.positive_pairs, 5), "stored-picks")
    scored = itemknn.scores(picks, itemknn.neighbors(t.positive_pairs, 20))
    recs = materialize(itemknn.in_catalogue(scored, t.catalogue.filter("artist_name is not null"), 30), "stored-recs")
    users, even = picks.select("user_id"), "user_id % 2 = 0"
    first, second = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    runs.publish(recs.filter("rank <= 3"), path, "r1", first, "ItemKNN", "v1.0", users)
    runs.publish(recs, path, "r1", first, "ItemKNN", "v1.0", users)
    runs.publish(recs.filter(even).filter("rank <= 10"), path, "r2", second, "ItemKNN", "v1.0", users.filter(even))
    return path


STORED = f"""WITH {", ".join(f"{name} AS ({body})" for name, body in knn_recs("r", "picks", "nb", "sim", 9).items())},
    k AS (SELECT item_id FROM catalogue WHERE artist_name IS NOT NULL),
    st AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM r_s JOIN k USING (item_id) WHERE score > 0)"""


@query(
    "stored_run_items",
    f"""{STORED} SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'r2' ELSE 'r1' END AS run_id, rank, item_id, score FROM st WHERE rank <= CASE WHEN user_id % 2 = 0 THEN 10 ELSE 30 END""",
)
def _(t):
    return runs.newest_items(t.spark, _stored_runs(t)).select("user_id", "run_id", "rank", "item_id", "score")


@query(
    "stored_runs_published",
    f"""{STORED} SELECT 'r1' AS run_id, (SELECT count(DISTINCT user_id) FROM picks) AS n_batches, count(*) AS n_items FROM st WHERE rank <= 30
        UNION ALL SELECT 'r2', (SELECT count(DISTINCT user_id) FROM picks WHERE user_id % 2 = 0), count(*) FROM st WHERE rank <= 10 AND user_id % 2 = 0""",
)
def _(t):
    return runs.published(t.spark, _stored_runs(t)).select("run_id", "n_batches", "n_items")
