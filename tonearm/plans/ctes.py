"""Comparison SQL of the shared tables: the same mapping as ``sources.fixtures``, written for DuckDB."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["inter"] = """
SELECT o_custkey AS user_id, l_partkey AS item_id, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS target,
       o_orderdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["pos"] = "SELECT DISTINCT user_id, item_id FROM inter WHERE target = 1"
CTES["labelled"] = "SELECT user_id, item_id, max(target) AS target FROM inter GROUP BY 1, 2"
CTES["train_raw"] = """
SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS msno, 'S' || lpad(l_partkey::VARCHAR, 9, '0') AS song_id,
       CASE WHEN l_linenumber <> 7 THEN o_orderstatus END AS source_system_tab,
       o_orderpriority AS source_screen_name, l_linestatus AS source_type,
       CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS target
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["songs_raw"] = """
SELECT 'S' || lpad(p_partkey::VARCHAR, 9, '0') AS song_id,
       CASE WHEN p_partkey % 17 <> 0 THEN ((p_partkey * 7919) % 600000)::DOUBLE END AS song_length,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_type = 'PROMO' THEN p_type
            ELSE p_type || '|' || split_part(p_name, ' ', 1) END AS genre_ids,
       CASE WHEN p_partkey % 23 <> 0 THEN p_brand END AS artist_name,
       CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_brand ELSE 'Composer ' || p_size END AS composer,
       CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN p_brand ELSE 'Lyricist ' || (p_size % 7) END AS lyricist,
       CASE WHEN p_partkey % 19 <> 0 THEN ([3, 52, 17, 31, 24, 10])[p_size % 6 + 1]::DOUBLE END AS language
FROM part"""
CTES["codes"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'BAD-' || p_partkey
    ELSE upper(substr(p_type, 1, 2)) || 'X' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || lpad(p_size::VARCHAR, 2, '0')
         || lpad((p_partkey % 100000)::VARCHAR, 5, '0') END AS isrc
FROM part"""
CTES["extra"] = """
SELECT 'S' || lpad(p.p_partkey::VARCHAR, 9, '0') AS song_id, CASE WHEN p.p_partkey % 11 <> 0 THEN p_name END AS name, isrc
FROM part p JOIN codes USING (p_partkey) WHERE p_size <> 50"""
CTES["extra_ids"] = "SELECT song_id, row_number() OVER (ORDER BY song_id) - 1 AS song_id_new FROM (SELECT DISTINCT song_id FROM extra)"
CTES["song_joined"] = """
SELECT s.*, e.name, e.isrc, i.song_id_new FROM songs_raw s LEFT JOIN extra_ids i USING (song_id) LEFT JOIN extra e USING (song_id)"""
CTES["song_ind"] = """
SELECT *, (isrc IS NOT NULL)::INT AS has_isrc, (genre_ids IS NOT NULL)::INT AS has_genre, (composer IS NOT NULL)::INT AS has_composer,
       (lyricist IS NOT NULL)::INT AS has_lyricist, (name IS NOT NULL)::INT AS has_name, (song_id_new IS NOT NULL)::INT AS has_song_extra
FROM song_joined"""
CTES["lang_mode"] = """
SELECT language AS fill FROM songs_raw WHERE language IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 1"""
CTES["song_merge"] = """
SELECT song_id, coalesce(song_length, (SELECT median(song_length) FROM song_ind)) AS song_length,
       coalesce(genre_ids, 'unknown') AS genre_ids, coalesce(artist_name, 'unknown') AS artist_name,
       coalesce(composer, 'unknown') AS composer, coalesce(lyricist, 'unknown') AS lyricist,
       coalesce(language, (SELECT fill FROM lang_mode)) AS language, coalesce(name, 'unknown') AS name,
       coalesce(isrc, 'NONE') AS isrc, coalesce(song_id_new, -1) AS song_id_new,
       has_isrc, has_genre, has_composer, has_lyricist, has_name, has_song_extra
FROM song_ind"""
CTES["song_isrc"] = """
SELECT *, CASE WHEN ok = 1 THEN substr(isrc, 1, 2) ELSE 'UNK' END AS isrc_country,
       CASE WHEN ok = 1 THEN substr(isrc, 3, 3) ELSE 'UNK' END AS isrc_registrant,
       CASE WHEN ok = 1 THEN substr(isrc, 6, 2) ELSE 'UNK' END AS isrc_year,
       CASE WHEN ok = 1 THEN substr(isrc, 8, 5) ELSE 'UNK' END AS isrc_item_id,
       CASE WHEN ok = 1 THEN yy + CASE WHEN yy <= 25 THEN 2000 ELSE 1900 END END AS isrc_year_full, ok AS has_valid_isrc
FROM (SELECT *, regexp_matches(isrc, '^[A-Z]{2}[A-Z0-9]{3}[0-9]{2}[0-9]{5}$')::INT AS ok,
             TRY_CAST(substr(isrc, 6, 2) AS INT) AS yy FROM song_merge)"""
CTES["catalogue"] = """
SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 23 <> 0 THEN p_brand END AS artist_name,
       ([3, 52, 17, 31, 24, 10])[p_size % 6 + 1] AS language, p_type AS album_name, split_part(p_brand, '#', 2)::BIGINT AS artist_id
FROM part"""
CTES["artists"] = "SELECT DISTINCT split_part(p_brand, '#', 2)::BIGINT AS artist_id, p_brand AS artist_name FROM part"

CTES["span"] = "SELECT o_custkey AS c_custkey, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1"
CTES["members_raw"] = """
SELECT c.c_custkey AS user_id, c_name AS msno, c_nationkey AS city, (c.c_custkey % 95)::INT AS bd,
       CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'female' WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'male' END AS gender,
       (c.c_custkey % 10)::INT AS registered_via,
       CASE WHEN c.c_custkey % 37 = 0 THEN 99999999 ELSE strftime(first_ts, '%Y%m%d')::INT END AS registration_init_time,
       strftime(last_ts, '%Y%m%d')::INT AS expiration_date
FROM customer c LEFT JOIN span USING (c_custkey)"""
CTES["complete"] = "SELECT * FROM members_raw WHERE bd BETWEEN 10 AND 80 AND gender IS NOT NULL"
CTES["member_days"] = """
SELECT *, greatest(coalesce(date_diff('day', reg, expi), 0), 0) AS membership_days
FROM (SELECT *, TRY_CAST(try_strptime(registration_init_time::VARCHAR, '%Y%m%d') AS DATE) AS reg,
             TRY_CAST(try_strptime(expiration_date::VARCHAR, '%Y%m%d') AS DATE) AS expi FROM complete)"""
CTES["member_feat"] = """
SELECT user_id, msno, city, registered_via,
       CASE WHEN bd <= 0 THEN 0 WHEN bd <= 12 THEN 1 WHEN bd <= 18 THEN 2 WHEN bd <= 25 THEN 3 WHEN bd <= 35 THEN 4 WHEN bd <= 50 THEN 5 ELSE 6 END AS bd_group,
       (gender = 'female')::INT AS gender_female, (gender = 'male')::INT AS gender_male, year(reg) AS registration_year, membership_days,
       CASE WHEN membership_days <= 30 THEN 0 WHEN membership_days <= 180 THEN 1 WHEN membership_days <= 365 THEN 2 WHEN membership_days <= 730 THEN 3
            WHEN membership_days <= 1825 THEN 4 WHEN membership_days <= 3650 THEN 5 ELSE 6 END AS membership_group,
       count(*) OVER (PARTITION BY city) AS city_count
FROM member_days"""
CTES["users_t"] = """
SELECT c.c_custkey AS user_id, CASE WHEN c.c_custkey % 10 = 0 THEN 'dev_' ELSE 'g' END || c.c_custkey AS google_id,
       lower(replace(c_name, '#', '.')) || '@example.org' AS email,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 3 = 1 THEN '' ELSE 'nick' || c.c_custkey END AS nickname,
       CASE WHEN c.c_custkey % 41 <> 0 THEN (c.c_custkey % 95)::INT END AS age,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'M' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'F' WHEN c.c_custkey % 2 = 0 THEN 'O' END AS gender,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Chinese, English' WHEN 'MACHINERY' THEN 'Japanese' WHEN 'FURNITURE' THEN 'English,,Korean' WHEN 'AUTOMOBILE' THEN 'Chinese' END AS preferred_languages,
       (c.c_custkey % 4 <> 0)::INT AS profile_completed, c_name AS google_name, first_ts AS created_at
FROM customer c LEFT JOIN span USING (c_custkey)"""

CTES["ev"] = """
SELECT event_id, ts, user_id, (props->>'k')::BIGINT AS item_id, event_type, floor(value)::INT AS seconds FROM events"""
CTES["hist"] = """
SELECT event_id AS id, user_id, item_id, ts AS played_at, seconds AS watch_seconds,
       CASE event_type WHEN 'view' THEN 'RECOMMENDATION' WHEN 'click' THEN 'SEARCH' WHEN 'purchase' THEN 'PLAYLIST'
            WHEN 'signup' THEN 'ONBOARDING' WHEN 'error' THEN 'FRIEND' END AS source, event_type = 'error' AND seconds < 20 AS is_hidden
FROM ev"""
CTES["vis"] = "SELECT * FROM hist WHERE NOT is_hidden"
CTES["like_log"] = """
SELECT event_id, user_id, item_id, ts, event_type = 'purchase' AS intent FROM ev WHERE event_type IN ('purchase', 'error')"""
CTES["like_end"] = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS o FROM like_log),
l AS (SELECT user_id, item_id, arg_max(intent, o) AS final FROM o GROUP BY 1, 2),
b AS (SELECT o.user_id, o.item_id, final, coalesce(max(o) FILTER (WHERE intent <> final), 0) AS after, max(o) AS last
      FROM o JOIN l USING (user_id, item_id) GROUP BY 1, 2, 3)
SELECT user_id, item_id, CASE WHEN (last - after) % 2 = 1 THEN final END AS state FROM b"""
CTES["likes"] = "SELECT user_id, item_id, state AS is_liked FROM like_end WHERE state IS NOT NULL"
CTES["pls"] = """
SELECT user_id * 10 + item_id % 4 AS playlist_id, user_id, CASE WHEN item_id % 4 = 0 THEN 'archive' ELSE 'list-' || (item_id % 4) END AS playlist_name,
       item_id, ts AS added_at, event_id FROM ev WHERE event_type = 'signup'"""
CTES["pl"] = """
SELECT user_id * 10 + slot AS playlist_id, user_id, CASE WHEN slot = 0 THEN 'archive' ELSE 'list-' || slot END AS playlist_name
FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest([0, 1, 2, 3, 4]) AS slot)"""
CTES["favs"] = "SELECT user_id, item_id, min(added_at) AS added_at FROM pls WHERE lower(trim(playlist_name)) = 'archive' GROUP BY 1, 2"
CTES["requests"] = """
SELECT event_id, user_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 31 = 0 THEN item_id + 100000000 ELSE item_id END AS item_id,
       CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '-5' WHEN event_id % 37 = 0 THEN 'soon' ELSE seconds::VARCHAR END AS watch_seconds,
       CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'RADIO' WHEN event_type = 'view' THEN 'RECOMMENDATION' WHEN event_type = 'click' THEN 'SEARCH'
            WHEN event_type = 'purchase' THEN 'PLAYLIST' WHEN event_type = 'signup' THEN 'ONBOARDING' WHEN event_type = 'error' THEN 'FRIEND' END AS source
FROM ev"""
CTES["edges"] = """
WITH one AS (SELECT a.c_custkey AS user_id, b.c_custkey AS friend_id FROM customer a
             JOIN (SELECT unnest([1, 7, 25]) AS step) s ON TRUE JOIN customer b ON b.c_custkey = a.c_custkey + s.step)
SELECT * FROM one UNION ALL SELECT friend_id, user_id FROM one"""
CTES["affinity"] = """
WITH s AS (SELECT user_id, item_id, CASE WHEN watch_seconds >= 5 THEN watch_seconds ELSE 0 END AS sec, CASE WHEN watch_seconds < 5 THEN 1 ELSE 0 END AS skip, 0 AS fav, 0 AS lk FROM hist
  UNION ALL SELECT user_id, item_id, 0, 0, 0, CASE WHEN is_liked THEN 1 ELSE -1 END FROM likes
  UNION ALL SELECT user_id, item_id, 0, 0, 1, 0 FROM favs),
g AS (SELECT user_id, item_id, sum(sec)::BIGINT AS total_watch_seconds, sum(skip)::BIGINT AS skip_count, max(fav) AS is_favorited, sum(lk)::BIGINT AS like_state FROM s GROUP BY 1, 2)
SELECT *, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN total_watch_seconds < 10 THEN 0.0 WHEN total_watch_seconds < 30 THEN 0.1 WHEN total_watch_seconds < 60 THEN 0.3 WHEN total_watch_seconds < 180 THEN 0.5 ELSE 0.7 END)::DOUBLE
  + greatest(-0.1::DOUBLE * skip_count, -0.5::DOUBLE) + 0.5::DOUBLE * is_favorited
  + (CASE like_state WHEN 1 THEN 0.5 WHEN -1 THEN -1.0 ELSE 0.0 END)::DOUBLE)), 6) AS score FROM g"""
CTES["items_v"] = "SELECT vec_id AS item_id, embedding::DOUBLE[] AS embedding, label / 10.0::DOUBLE AS bias FROM embeddings"
CTES["ext"] = """
SELECT doc_id, ' ' || lower(isrc) || ' ' AS isrc, CASE WHEN doc_id % 5 <> 0 THEN 'Q' || (doc_id % 700) END AS wd_qid, source AS label_en,
       CASE WHEN doc_id % 3 <> 0 THEN text END AS desc_en,
       CASE lang WHEN 'en' THEN 'single' WHEN 'fr' THEN 'music track with vocals' WHEN 'de' THEN 'song' WHEN 'es' THEN 'Single release' END AS type_label
FROM documents JOIN codes ON p_partkey = doc_id // 3"""
CTES["ext_matched"] = "SELECT * REPLACE (upper(trim(isrc)) AS isrc) FROM ext WHERE wd_qid IS NOT NULL"

# Five onboarding picks per user, in hash order.
CTES["picks"] = """
SELECT user_id, item_id FROM pos QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '-' || item_id || '-42'), item_id) <= 5"""
CTES["loo_test"] = """
SELECT user_id, item_id FROM pos QUALIFY count(*) OVER (PARTITION BY user_id) >= 2
 AND row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '-' || item_id || '-42') DESC, item_id DESC) = 1"""
CTES["loo_train"] = "SELECT p.* FROM pos p LEFT JOIN loo_test t USING (user_id, item_id) WHERE t.user_id IS NULL"


def knn(pos: str, k: int, prefix: str = "") -> dict[str, str]:
    """Neighbour tables over the pairs of ``pos``."""
    return {
        f"{prefix}cnt": f"SELECT item_id, count(*) AS n FROM {pos} GROUP BY 1",
        f"{prefix}co": f"""SELECT a.item_id, b.item_id AS neighbor_id, count(*) AS co FROM {pos} a JOIN {pos} b
            ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2""",
        f"{prefix}nb": f"""SELECT c.item_id, neighbor_id, round(co / sqrt(x.n * y.n), 6) AS sim,
            row_number() OVER (PARTITION BY c.item_id ORDER BY co * co / y.n DESC, neighbor_id) AS rank
            FROM {prefix}co c JOIN {prefix}cnt x ON x.item_id = c.item_id JOIN {prefix}cnt y ON y.item_id = neighbor_id
            QUALIFY rank <= {k}""",
    }


def knn_recs(name: str, seeds: str, nb: str, add: str, n: int, threshold: float = 0.0, divisor: str = "1") -> dict[str, str]:
    """Ranked recommendations of ``seeds`` from ``nb``; ``add`` is the share of one neighbour row."""
    return {
        f"{name}_s": f"""SELECT s.user_id, neighbor_id AS item_id, floor(sum(floor(({add}) * 1e9 + 0.5)::BIGINT)::DOUBLE / (1000.0::DOUBLE * any_value({divisor})) + 0.5) / 1e6 AS score
            FROM {seeds} s JOIN {nb} nb ON nb.item_id = s.item_id
            LEFT JOIN {seeds} seen ON seen.user_id = s.user_id AND seen.item_id = neighbor_id
            WHERE sim > {threshold} AND seen.user_id IS NULL GROUP BY 1, 2""",
        name: f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM {name}_s
            QUALIFY rank <= {n}""",
    }


for _name, _seeds, _k in (("nb", "pos", 20), ("loo_nb", "loo_train", 20)):
    CTES.update(knn(_seeds, _k, _name[:-2]))


def with_ctes(body: str) -> str:
    """``body`` preceded by the shared tables it names, directly or through another."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for word in re.findall(r"[a-z_][a-z0-9_]*", sql):
            if word in CTES and word not in needed and word not in visiting:
                visiting.add(word)
                visit(CTES[word])
                needed.append(word)

    visiting: set[str] = set()
    visit(body)
    if not needed:
        return body.strip()
    shared = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    return f"WITH {shared}\nSELECT * FROM ({body.strip()})"
