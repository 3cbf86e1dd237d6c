"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, hnsw, jaccard, licenses, merkle, mixing, quality, repeats, secrets, toxicity, trie, warc

_A_TO_Z = f"'{decontam.UPPER}', '{decontam.LOWER}'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(_table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in millionths of the training progress."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("position") * 1_000_000).cast("bigint").alias("position"))


def with_control_text(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, which speaks in control strings."""
    said = "</s>[INST] ok [/INST]"
    schema = conversations.select("conv_id", "turn", "role", "text").schema
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import materialize

    made = chat.examples(with_control_text(_table(spark, sf_dir, "conversations")))
    return chat.read_back(materialize(made, "chat-examples"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        "doc_id", (F.octet_length("kept") + gone).cast("bigint").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), cut AS (
  SELECT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS t
  FROM (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0)
), win AS (SELECT DISTINCT item_id, l, t FROM cut),
runs AS (
  SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: {{'i': i, 't': array_to_string(w[i:i + l - 1], ' ')}})) AS r
  FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l
), hit AS (
  SELECT r.doc_id, win.item_id, r.r.i AS i, r.l FROM runs r JOIN win ON win.t = r.r.t AND win.l = r.l
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, t FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM d WHERE len(w) > 0
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""

_QUADS = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {5 * k + 1}, 5) AS bigint), 32), 4, '0')" for k in range(8))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS k FROM pages),
o AS (SELECT k, min(page_id) AS origin FROM p GROUP BY k)
SELECT page_id, strlen(body) AS payload_bytes, translate({_QUADS}, '{warc.HEX32}', '{warc.BASE32}') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM p JOIN o USING (k)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source
), w AS (SELECT *, kind + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(weight) OVER () AS all_weights, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), full_ AS (SELECT *, caps * weight + cap * (all_weights - weights) < total * weight AS is_full FROM r),
level AS (
  SELECT max(total) - coalesce(sum(cap) FILTER (WHERE is_full), 0) AS rest, coalesce(sum(weight) FILTER (WHERE NOT is_full), 0) AS open FROM full_
), t AS (
  SELECT source, source_size, kind, CASE WHEN is_full THEN CAST(cap AS double) ELSE CAST(rest AS double) / CAST(open AS double) * weight END AS target
  FROM full_, level
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.kind,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('-', CAST(d.doc_id AS varchar), 'mix')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, least(size, greatest(0, floor(target) - c)) AS a, least(size, greatest(0, floor(target) - source_size - c)) AS b,
         least(size, greatest(0, floor(target) - 2 * source_size - c)) AS e, c / target AS y FROM p
)
SELECT doc_id, size, source_size, target, CAST(a + b + e AS bigint) AS taken,
       CASE WHEN a > 0 THEN CAST(floor(1000000 * CASE kind WHEN 0 THEN (sqrt(2.25 - 2 * y) - 1.5) / -1 WHEN 1 THEN y
            ELSE CASE WHEN y < 0.375 THEN sqrt(0.25 + 2 * y) - 0.5 ELSE 0.5 + sqrt(1 + 2 * (y - 0.375)) - 1 END END) AS bigint) END AS position
FROM q
"""

_SAID = "</s>[INST] ok [/INST]"
OP8_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(text, '{chat.ESCAPE}', '\1\\\2\3', 'g'))
         + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 WHEN 'system' THEN 18
           ELSE 17 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{chat.ESCAPE}', '\1\\\2\3', 'g')) END AS chars
  FROM c
), f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::bigint AS formatted_chars
FROM f GROUP BY conv_id
"""



OP11_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), blocks AS (
  SELECT rid, doc_id, k, least(256, n - {repeats.LENGTH - 1} - 256 * k) AS m, substring(x, 512 * k + 1, {512 + 2 * repeats.LENGTH}) AS y
  FROM (SELECT rid, doc_id, x, n, unnest(range(0, (n - {repeats.LENGTH}) // 256 + 1)) AS k FROM d WHERE n >= {repeats.LENGTH})
), w AS MATERIALIZED (
  SELECT rid, doc_id, 256 * k + s AS s, substring(y, 2 * s + 1, {2 * repeats.LENGTH}) AS t FROM (SELECT rid, doc_id, k, y, unnest(range(0, m)) AS s FROM blocks)
), least AS (SELECT t, min(doc_id) AS doc_id FROM w GROUP BY t HAVING count(*) > 1),
gone AS (SELECT rid, s FROM w JOIN least USING (t) WHERE least.doc_id < w.doc_id OR (w.doc_id IS NULL AND least.doc_id IS NOT NULL)),
marked AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER o + {repeats.LENGTH} THEN 0 ELSE 1 END AS new FROM gone WINDOW o AS (PARTITION BY rid ORDER BY s)),
numbered AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS k FROM marked),
spans AS (SELECT rid, min(s) AS a, max(s) + {repeats.LENGTH} AS b FROM numbered GROUP BY rid, k),
cut AS (
  SELECT d.rid, a, b, substring(x, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS before, lead(a) OVER o IS NULL AS is_last, substring(x, 2 * b + 1) AS rest
  FROM spans JOIN d USING (rid) WINDOW o AS (PARTITION BY d.rid ORDER BY a)
), kept AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(before || CASE WHEN is_last THEN rest ELSE '' END, '' ORDER BY a) AS x FROM cut GROUP BY rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    step = "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), lambda c, b: {step}, 4294967295::bigint), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS varchar)" for c in merkle.FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_LEVEL = "SELECT {key}, l + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY {key}, l, i // 3"
_FOLD = """SELECT w.rid, w.source, w.l + 1, w.i // 3, (any_value(w.n) + 2) // 3,
         sha256(string_agg(CASE WHEN t.i = w.i THEN w.cur ELSE t.h END, '' ORDER BY t.i)),
         any_value(w.sib) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> w.i), '')"""
OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_crc32("CAST(doc_id AS varchar)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents)
), t AS (
  SELECT source, 0 AS l, i, n, leaf AS h FROM d UNION ALL {_LEVEL.format(key="source", t="t")}
), s AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS k, 0 AS l, i, n, h FROM s UNION ALL {_LEVEL.format(key="k", t="u")}
), low AS (
  SELECT rid, source, 0 AS l, i, n, coalesce(changed, leaf) AS cur, '' AS sib FROM d UNION ALL
  {_FOLD} FROM low w JOIN t ON t.source IS NOT DISTINCT FROM w.source AND t.l = w.l AND t.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.rid, w.source, w.l, w.i
), high AS (
  SELECT low.rid, low.source, 0 AS l, s.i, s.n, low.cur, low.sib FROM low JOIN s ON s.source IS NOT DISTINCT FROM low.source WHERE low.n = 1 UNION ALL
  {_FOLD} FROM high w JOIN u t ON t.l = w.l AND t.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.rid, w.source, w.l, w.i
), r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.root, sha256(high.sib) AS proof_sha256, high.cur AS folded_root, high.cur = r.root AS verified
FROM d JOIN high ON high.rid = d.rid AND high.n = 1 JOIN s ON s.source IS NOT DISTINCT FROM d.source, r
"""

OP13_SQL = rf"""
WITH c AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS k,
         {{'r': role, 't': text}} AS turn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), v AS (SELECT conv_id, list(turn ORDER BY k) AS turns, {_crc32("CAST(conv_id AS varchar)")} % {trie.SHARED} AS h FROM c GROUP BY conv_id),
b AS MATERIALIZED (
  SELECT v.conv_id, list_concat(coalesce(f.turns, [])[:v.h], v.turns[v.h + 1:]) AS turns FROM v LEFT JOIN v f ON f.conv_id = v.conv_id - v.conv_id % {trie.BLOCK}
), p AS MATERIALIZED (
  SELECT conv_id, d, sha256(CAST(turns[:d] AS varchar)) AS node, CASE WHEN d > 0 THEN sha256(CAST(turns[:d - 1] AS varchar)) END AS above, d = len(turns) AS ends,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)
), n AS MATERIALIZED (
  SELECT node, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(above) AS above, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY node
), k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (
  SELECT a.node, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved_tokens
  FROM o JOIN p a ON a.conv_id = o.conv_id AND a.d <= o.depth GROUP BY a.node
)
SELECT o.conv_id, o.depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves::bigint AS n_leaves, s.saved_tokens::bigint AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (node) LEFT JOIN n q ON q.node = o.above
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity, op3_ngram_jaccard_join, op4_warc, op5_nearest_neighbours, op6_secret_scan, op7_source_mix,
        op8_chat_format, op9_license_scan, op10_quality, op11_suffix_dedup, op12_merkle_manifest, op13_prefix_trie, pipeline,
    )
}
SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op7_source_mix": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
