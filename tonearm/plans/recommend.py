"""Recommendation queries: neighbours, embeddings, re-ranking, trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cleaning, embeddings, factors, features, itemknn, metrics, models, rerank, splits
from ..session import once
from ..sources import artifacts
from ..sources.fixtures import Tables
from .activity import affinities
from .catalogue import AS_OF, PROFILE_TAGS
from .ctes import knn, knn_recs
from .registry import PLANS, query

K, N = 20, 20


def pairs(t: Tables):
    return t.positive_pairs


def picks(t: Tables):
    """Five onboarding songs per user, written once: they are read several times."""
    return t.keep("picks", lambda: splits.first_seeds(pairs(t), 5))


def _sql(tables: dict[str, str]) -> str:
    return ", ".join(f"{name} AS ({body})" for name, body in tables.items())


# --- ItemKNN ---------------------------------------------------------------------


@query("itemknn_neighbors", "SELECT item_id, neighbor_id, sim, rank FROM nb")
def _(t):
    return itemknn.neighbors(pairs(t), K)


MODES = {
    "itemknn_recommend": ("baseline", "sim"),
    "itemknn_sim2": ("sim2", "sim * sim"),
    "itemknn_pop_pow": ("pop_pow", "sim / pow(greatest(n, 1)::DOUBLE, 0.5)"),
    "itemknn_pop_log": ("pop_log", "sim / pow(ln(1 + greatest(n, 1)::DOUBLE), 0.5)"),
}


def _recommend(t: Tables, mode: str):
    pos = pairs(t)
    return itemknn.recommend(pos, itemknn.neighbors(pos, K), N, mode, popularity=itemknn.item_popularity(pos))


def _recommend_sql(add: str) -> str:
    tables = {"nbp": "SELECT nb.*, n FROM nb JOIN cnt ON cnt.item_id = neighbor_id"} | knn_recs("r", "pos", "nbp", add, N)
    return f"WITH {_sql(tables)} SELECT user_id, item_id, score, rank FROM r"


for _name, (_mode, _add) in MODES.items():
    query(_name, _recommend_sql(_add))(lambda t, m=_mode: _recommend(t, m))


@query(
    "itemknn_norm",
    f"""WITH sn AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_seeds FROM pos),
        {_sql(knn_recs("r", "sn", "nb", "sim", N, divisor="s.n_seeds"))} SELECT user_id, item_id, score, rank FROM r""",
)
def _(t):
    return _recommend(t, "normalize_seed")


KNOWN = "SELECT item_id FROM catalogue WHERE artist_name IS NOT NULL"


@query(
    "catalog_filtered_recs",
    f"""WITH {_sql(knn_recs("r", "picks", "nb", "sim", 9))}, k AS ({KNOWN})
        SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM r_s JOIN k USING (item_id)
        WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) <= 9""",
)
def _(t):
    scored = itemknn.scores(picks(t), itemknn.neighbors(pairs(t), K))
    return itemknn.in_catalogue(scored, t.catalogue.filter("artist_name is not null"), 9)


@query(
    "skipped_seeds",
    "SELECT DISTINCT user_id, item_id FROM picks WHERE item_id NOT IN (SELECT item_id FROM items_v)",
)
def _(t):
    return itemknn.skipped_seeds(picks(t), t.item_vectors)


@query(
    "demo_recs",
    f"""WITH {_sql(knn_recs("r", "pos", "nb", "sim", N))}, u AS (SELECT DISTINCT user_id FROM pos WHERE ('0x' || substr(md5(user_id || '-7'), 1, 8))::BIGINT < 429496729),
        s AS (SELECT user_id, item_id FROM pos JOIN u USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 20)
        SELECT user_id, seeds, recs FROM (SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS seeds FROM s GROUP BY 1)
        LEFT JOIN (SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS recs FROM r GROUP BY 1) USING (user_id)""",
)
def _(t):
    pos = pairs(t)
    sample = cleaning.hash_sample(pos.select("user_id").distinct(), 0.1, 7, "user_id")
    recs = itemknn.recommend(pos.join(sample, "user_id", "left_semi"), itemknn.neighbors(pos, K), N)
    demo = itemknn.demo_table(sample, pos, recs)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return demo.select("user_id", text(F.col("seed_items")).alias("seeds"), text(F.col("recs.item_id")).alias("recs"))


# --- popularity --------------------------------------------------------------------

POPULAR = "SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM inter WHERE target = 1 GROUP BY 1 QUALIFY rank <= {k}"


@query("popular_topk", POPULAR.format(k=20))
def _(t):
    return metrics.popular(t.interactions.filter("target = 1"), 20)


@query(
    "popularity_recs",
    f"WITH p AS ({POPULAR.format(k=10)}) SELECT user_id, item_id, n AS score, rank FROM (SELECT DISTINCT user_id FROM pos), p",
)
def _(t):
    return metrics.popularity_recs(pairs(t).select("user_id").distinct(), t.interactions.filter("target = 1"), 10)


# --- embeddings ---------------------------------------------------------------------

# Vectors are compared per dimension: (key, dim, value rounded to five decimals).
DIMS = 64


def _long(df, key: str):
    return df.select(key, F.posexplode("embedding").alias("dim", "v")).select(
        key, F.col("dim").alias("dim"), (F.round(F.col("v").cast("double"), 5) + F.lit(0.0)).alias("value")
    )


WARM = """
w AS (SELECT h.user_id, h.item_id, coalesce(score, 0.3) AS aff FROM (SELECT DISTINCT user_id, item_id FROM hist) h LEFT JOIN affinity a USING (user_id, item_id) WHERE coalesce(score, 0.3) >= -0.5),
wx AS (SELECT user_id, greatest(aff + 0.5, 0.0)::DOUBLE AS wt, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM w JOIN items_v USING (item_id)),
wd AS (SELECT user_id, dim, CASE WHEN sum(wt) > 0 THEN sum(wt * x) / sum(wt) ELSE avg(x) END AS v FROM wx GROUP BY 1, 2)"""


@query("warm_user_vectors", f"WITH {WARM} SELECT user_id, dim, round(v, 5) + 0.0 AS value FROM wd")
def _(t):
    return _long(embeddings.warm_vectors(t.history, affinities(t), t.item_vectors, DIMS), "user_id")


def _topk_sql(vectors_name: str, k: int, exclude: str) -> str:
    return f"""
    uv AS (SELECT user_id, list(v ORDER BY dim) AS u FROM {vectors_name} GROUP BY 1),
    sc AS (SELECT uv.user_id, i.item_id, round(list_dot_product(u, embedding) + 0.3::DOUBLE * bias, 6) AS score FROM uv, items_v i
           LEFT JOIN ({exclude}) x ON x.user_id = uv.user_id AND x.item_id = i.item_id WHERE x.user_id IS NULL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc QUALIFY rank <= {k})"""


EXCLUDE = "SELECT DISTINCT user_id, item_id FROM (SELECT user_id, item_id FROM hist UNION ALL SELECT user_id, item_id FROM picks)"


def warm_candidates(t: Tables, k: int):
    return embeddings.warm_recs(
        t.history, affinities(t), t.item_vectors, embeddings.exclusion(t.history, picks(t)), k
    )


@query("warm_recs", f"WITH {WARM}, {_topk_sql('wd', 9, EXCLUDE)} SELECT user_id, item_id, score, rank FROM rk")
def _(t):
    return warm_candidates(t, 9)


@query(
    "mips_topk",
    f"""WITH pv AS (SELECT user_id, dim, avg(x) AS v FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM pos JOIN items_v USING (item_id)) GROUP BY 1, 2),
        {_topk_sql('pv', 10, 'SELECT user_id, item_id FROM pos')} SELECT user_id, item_id, score, rank FROM rk""",
)
def _(t):
    pos = pairs(t)
    users = embeddings.warm_vectors(pos, None, t.item_vectors, DIMS)
    return embeddings.score_topk(users, t.item_vectors, 10, pos)


def tag_table(t: Tables, tagged=None, heard=None):
    """Tag vectors of the comparison data: mean vector of the songs that each tag's listeners ``heard``.

    ``tagged`` names the listeners, by default all; the songs are those of onboarding unless others are given.
    """
    tagged = features.profile_tags(t.users, AS_OF) if tagged is None else tagged
    heard = picks(t) if heard is None else heard.select("user_id", "item_id")
    rows = tagged.join(heard, "user_id").join(t.item_vectors, "item_id")
    inv = F.lit(1.0) / F.col("n")
    return (
        rows.select(F.explode("tags").alias("tag"), "embedding", "bias")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"), vectors.sum_of("embedding", DIMS).alias("s"), F.avg("bias").alias("bias"))
        .filter("tag <> 'gender_unknown'")
        .select("tag", vectors.scale(F.col("s"), inv).alias("embedding"), "bias")
    )


def tags_sql(known: str = "tg") -> str:
    return f"""
tg AS (SELECT user_id, unnest(string_split(tags, ',')) AS tag FROM ({PROFILE_TAGS})),
tk AS (SELECT user_id, tag FROM {known}),
tb AS (SELECT tag, avg(bias) AS bias FROM tk JOIN picks USING (user_id) JOIN items_v USING (item_id) WHERE tag <> 'gender_unknown' GROUP BY 1),
tv AS (SELECT tag, dim, avg(x) AS v FROM (SELECT tag, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM tk JOIN picks USING (user_id) JOIN items_v USING (item_id))
       WHERE tag <> 'gender_unknown' GROUP BY 1, 2),
fv AS (SELECT user_id, dim, avg(v) AS f FROM tg JOIN tv USING (tag) GROUP BY 1, 2),
fb AS (SELECT user_id, avg(bias) AS b FROM tg JOIN tb USING (tag) GROUP BY 1),
tt AS (SELECT user_id, dim, avg(x) AS t FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM picks JOIN items_v USING (item_id)) GROUP BY 1, 2),
cd AS (SELECT coalesce(fv.user_id, tt.user_id) AS user_id, coalesce(fv.dim, tt.dim) AS dim, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 0.5 * f + 0.5 * t ELSE coalesce(t, f) END AS v
       FROM fv FULL JOIN tt ON fv.user_id = tt.user_id AND fv.dim = tt.dim)"""


TAGS = tags_sql()


@query("cold_user_vectors", f"WITH {TAGS} SELECT user_id, dim, round(v, 5) + 0.0 AS value FROM cd")
def _(t):
    tagged = features.profile_tags(t.users, AS_OF)
    return _long(embeddings.cold_vectors(tagged, tag_table(t), picks(t), t.item_vectors, dims=DIMS), "user_id")


def cold_candidates(t: Tables, k: int):
    tagged = features.profile_tags(t.users, AS_OF)
    exclude = embeddings.exclusion(t.history, picks(t))
    return embeddings.cold_recs(tagged, tag_table(t), picks(t), t.item_vectors, exclude, k)


@query(
    "cold_recs",
    f"""WITH {TAGS}, {_topk_sql('cd', 9, EXCLUDE)}
        SELECT user_id, item_id, round(score + 0.3::DOUBLE * coalesce(b, 0), 5) AS score, rank FROM rk LEFT JOIN fb USING (user_id)""",
)
def _(t):
    return cold_candidates(t, 9).withColumn("score", F.round("score", 5))


@query(
    "full_item_vectors",
    f"""WITH it AS (SELECT item_id, unnest(['lang_pref_' || language, 'bd_' || (item_id % 7)]) AS tag FROM catalogue), {TAGS},
        s AS (SELECT item_id, dim, sum(v) AS s FROM it JOIN tv USING (tag) GROUP BY 1, 2),
        o AS (SELECT item_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM items_v)
        SELECT item_id, dim, round(x + coalesce(s, 0), 5) + 0.0 AS value FROM o LEFT JOIN s USING (item_id, dim)""",
)
def _(t):
    tags = F.array(
        F.concat(F.lit("lang_pref_"), F.col("language").cast("string")), F.concat(F.lit("bd_"), (F.col("item_id") % 7).cast("string"))
    )
    tagged = t.catalogue.select("item_id", tags.alias("tags"))
    return _long(embeddings.full_item_vectors(t.item_vectors, tagged, tag_table(t), DIMS), "item_id")


@query(
    "tag_weights",
    f"""WITH {TAGS}, k AS (SELECT user_id, tag FROM tg JOIN tb USING (tag))
        SELECT user_id, tag, round(1.0 / count(*) OVER (PARTITION BY user_id), 6)::DOUBLE AS weight FROM k""",
)
def _(t):
    out = embeddings.tag_weights(features.profile_tags(t.users, AS_OF), tag_table(t))
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "artifact_integrity",
    """SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_ids, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims,
       count(*) FILTER (WHERE embedding IS NULL OR bias IS NULL) AS n_null,
       (count(*) = count(DISTINCT item_id) AND min(len(embedding)) = max(len(embedding)))::BIGINT AS is_valid FROM items_v""",
)
def _(t):
    return artifacts.integrity(t.item_vectors)


# --- page rules -----------------------------------------------------------------------


@query(
    "algorithm_choice",
    """WITH h AS (SELECT user_id, count(*) AS n, count(v.item_id) AS k FROM (SELECT DISTINCT user_id, item_id FROM hist) d LEFT JOIN items_v v USING (item_id) GROUP BY 1)
       SELECT user_id, coalesce(n, 0) AS n_history, CASE WHEN user_id NOT IN (SELECT user_id FROM picks) THEN 'none'
       WHEN coalesce(n, 0) >= 10 AND k > 0 THEN 'purecf' ELSE 'hybrid' END AS algorithm FROM users_t LEFT JOIN h USING (user_id)""",
)
def _(t):
    return rerank.algorithm_choice(t.users, t.history, picks(t), t.item_vectors)


@query(
    "language_rerank",
    f"""WITH {WARM}, {_topk_sql('wd', 200, EXCLUDE)},
        c AS (SELECT rk.user_id, rk.item_id, score, language, CASE preferred_languages WHEN 'Chinese, English' THEN [3, 24, 52] WHEN 'Japanese' THEN [17] WHEN 'English,,Korean' THEN [52, 31]
              WHEN 'Chinese' THEN [3, 24] ELSE []::INT[] END AS codes, min(score) OVER (PARTITION BY rk.user_id) AS lo
              FROM rk JOIN catalogue USING (item_id) JOIN users_t u ON u.user_id = rk.user_id),
        a AS (SELECT user_id, item_id, round(CASE WHEN len(codes) = 0 THEN score WHEN list_contains(codes, language) THEN score + greatest(0.0::DOUBLE, 1.0::DOUBLE - lo)
              ELSE (score + greatest(0.0::DOUBLE, 1.0::DOUBLE - lo)) * 0.2::DOUBLE END, 6) AS score FROM c)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM a QUALIFY rank <= 9""",
)
def _(t):
    return rerank.language_rerank(warm_candidates(t, 200), t.users, t.catalogue)


@query(
    "affinity_rerank",
    f"""WITH {_sql(knn_recs("r", "picks", "nb", "sim", 9))},
        a AS (SELECT r.user_id, r.item_id, round(r.score * (1 + coalesce(f.score, 0)), 6) AS score FROM r_s r LEFT JOIN affinity f ON f.user_id = r.user_id AND f.item_id = r.item_id
              WHERE coalesce(f.score, 0) >= -0.5)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM a QUALIFY rank <= 9""",
)
def _(t):
    return rerank.affinity_rerank(itemknn.scores(picks(t), itemknn.neighbors(pairs(t), K)), affinities(t))


# --- trained models (no SQL: the factors come out of an iterative solver) ------------------

RANK, ITERATIONS = 16, 5


def _model(t: Tables, pos):
    return models.train_als(pos, rank=RANK, iterations=ITERATIONS)


@query("item_embedding_table")
def _(t):
    pos = pairs(t)
    return models.item_factors(_model(t, pos), pos).withColumn("embedding", vectors.text(F.col("embedding")))


@query("tag_embedding_table")
def _(t):
    users = models.user_factors(_model(t, pairs(t)))
    tags = models.tag_embeddings(users, features.profile_tags(t.users, AS_OF), RANK)
    return tags.withColumn("embedding", vectors.text(F.col("embedding")))


@query("als_recs")
def _(t):
    pos = pairs(t)
    model = _model(t, pos)
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.col("features").alias("embedding"), F.lit(0.0).alias("bias"))
    return embeddings.score_topk(models.user_factors(model), items, 10, pos)


# --- logistic factors with biases: outputs that SQL can state -----------------------------

LOGISTIC_REG = 2.0


def _logistic(t: Tables) -> factors.Factors:
    """One model per run, fitted on all labelled pairs and read by the queries below."""

    def build(side: str):
        if side not in made:
            model = factors.train_logistic(t.labelled_pairs, RANK, ITERATIONS, LOGISTIC_REG)
            made.update(users=model.users, items=model.items)
        return made[side]

    made: dict = {}
    users = once(t.spark, (f"logistic-users-{RANK}", t.sf_dir), lambda: build("users"))
    items = once(t.spark, (f"logistic-items-{RANK}", t.sf_dir), lambda: build("items"))
    return factors.Factors(users, items)


def logistic_recs(t: Tables):
    """Ten songs per user by the logistic model; the user's own bias shifts no order."""
    model = _logistic(t)
    return embeddings.score_topk(model.users, model.items, 10, pairs(t), beta=1.0)


@query(
    "logistic_fit_report",
    """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, 17 AS n_parameters, 1 AS below_constant,
       1 AS is_finite FROM labelled""",
)
def _(t):
    """Model sizes, and whether its loss on the rows it learned from is below that of the constant share of likes."""
    model = _logistic(t)
    size = lambda side, key: side.agg(F.count_distinct(key)).scalar()
    lengths = model.users.unionByName(model.items.withColumnRenamed("item_id", "user_id")).agg(F.max(F.size("embedding")) + 1).scalar()
    return factors.fit_report(t.labelled_pairs, model).select(
        "n_rows", size(model.users, "user_id").alias("n_users"), size(model.items, "item_id").alias("n_items"), lengths.alias("n_parameters"),
        (F.col("log_loss") < F.col("constant_loss")).cast("int").alias("below_constant"), (~F.isnan("log_loss")).cast("int").alias("is_finite"),
    )


def _list_checks(recs, pos):
    """(user_id, n_listed, n_distinct, n_seen, is_ordered) of top lists."""
    seen = recs.join(pos.select("user_id", "item_id", F.lit(1).alias("seen")), ["user_id", "item_id"], "left")
    listed = F.sort_array(F.collect_list(F.struct("rank", (-F.col("score")).alias("down"), "item_id")))
    lists = seen.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_listed"), F.count_distinct("item_id").alias("n_distinct"), F.count("seen").alias("n_seen"), listed.alias("l")
    )
    order = F.transform("l", lambda x: F.struct(x["down"], x["item_id"]))
    ranks = F.transform("l", lambda x: x["rank"].cast("int")) == F.sequence(F.lit(1), F.size("l"))
    return lists.select("user_id", "n_listed", "n_distinct", "n_seen", (ranks & (order == F.array_sort(order))).cast("int").alias("is_ordered"))


# Every user gets ten items, or all that are left, none of them a positive of theirs.
LIST_CHECKS = """SELECT user_id, least(10, n - have) AS n_listed, least(10, n - have) AS n_distinct, 0 AS n_seen, 1 AS is_ordered
    FROM (SELECT {users}.user_id, count(pos.item_id) AS have FROM (SELECT DISTINCT user_id FROM {users}) {users} LEFT JOIN pos ON pos.user_id = {users}.user_id GROUP BY 1),
         (SELECT count(DISTINCT item_id) AS n FROM {users}) WHERE n > have"""


@query("logistic_list_checks", LIST_CHECKS.format(users="labelled"))
def _(t):
    return _list_checks(logistic_recs(t), pairs(t))


@query("als_list_checks", "SELECT user_id, least(10, n - have) AS n_listed, least(10, n - have) AS n_distinct, 0 AS n_seen, 1 AS is_ordered "
       "FROM (SELECT user_id, count(*) AS have FROM pos GROUP BY 1), (SELECT count(DISTINCT item_id) AS n FROM pos) WHERE n > have")
def _(t):
    return _list_checks(PLANS["als_recs"](t), pairs(t))


@query(
    "item_embedding_checks",
    f"""SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_ids, {RANK} AS min_dims, {RANK} AS max_dims, 0 AS n_null, 1 AS is_valid, 1 AS is_centred
        FROM (SELECT DISTINCT item_id FROM pos)""",
)
def _(t):
    """Integrity of the trained item table, and whether its biases add up to nothing."""
    pos = pairs(t)
    items = models.item_factors(_model(t, pos), pos)
    centred = items.agg((F.abs(F.sum("bias")) < 1e-6 * F.count(F.lit(1))).cast("int")).scalar()
    return artifacts.integrity(items).withColumn("is_centred", centred)


@query(
    "tag_embedding_checks",
    f"""SELECT tag, {RANK} AS n_dims, 1 AS is_finite FROM (SELECT DISTINCT user_id FROM pos) JOIN
        (SELECT user_id, unnest(string_split(tags, ',')) AS tag FROM ({PROFILE_TAGS})) USING (user_id) GROUP BY 1""",
)
def _(t):
    """One row per tag of a user with factors."""
    users = models.user_factors(_model(t, pairs(t)))
    tags = models.tag_embeddings(users, features.profile_tags(t.users, AS_OF), RANK)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return tags.select("tag", F.size("embedding").alias("n_dims"), finite.cast("int").alias("is_finite"))
