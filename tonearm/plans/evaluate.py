"""Splits, ranking metrics and their reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import embeddings, factors, features, hybrid, itemknn, metrics, splits
from ..schemas import METRICS
from ..session import materialize, once, run_dir, side_by_side
from ..sources import tables
from ..sources.fixtures import Tables
from .catalogue import AS_OF, PROFILE_TAGS
from .ctes import knn, knn_recs
from .recommend import DIMS, pairs, tag_table, tags_sql, _sql, _topk_sql
from .registry import query

ITEM_K, HELD_OUT = 20, 200
SEED_SPLITS = (1, 3, 5)


# --- splits -----------------------------------------------------------------------


def loo(t: Tables):
    """(train pairs, test rows) of the leave-one-out protocol."""
    pos = pairs(t)
    test = t.keep("loo-test", lambda: splits.leave_one_out(pos))
    return t.keep("loo-train", lambda: splits.without(pos, test)), test


def seed_split(t: Tables, n: int):
    return splits.seed_n(t.labelled_pairs, n)


def seed_pairs(t: Tables, n: int):
    """(seeds, test pairs) of a seed split: the order is written once for all splits, each model and report reads it several times."""
    first = t.keep("first-positives", lambda: splits.first_positives(t.labelled_pairs, max(n, *SEED_SPLITS)))
    placed = t.keep("placed-positives", lambda: splits.placed_positives(t.labelled_pairs, first))
    seeds, test = splits.seeds_and_test(first, placed, n)
    return seeds.select("user_id", "item_id"), test


def seed_sql(n: int) -> dict[str, str]:
    order = "row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '-' || item_id || '-42'), item_id)"
    return {
        f"el{n}": f"SELECT user_id FROM labelled WHERE target = 1 GROUP BY 1 HAVING count(*) > {n}",
        f"or{n}": f"SELECT user_id, item_id, {order} AS rn FROM labelled SEMI JOIN el{n} USING (user_id) WHERE target = 1",
        f"sd{n}": f"SELECT user_id, item_id FROM or{n} WHERE rn <= {n}",
        f"te{n}": f"SELECT user_id, item_id FROM or{n} WHERE rn > {n}",
    }


def held_out(t: Tables):
    """Whole users held out: ``HELD_OUT`` of them, a fifth where there are fewer than five times as many."""

    made: list = []

    def part(i: int):
        if not made:
            users = t.labelled_pairs.filter("target = 1").select("user_id").distinct().count()
            made.extend(splits.held_out_users(t.labelled_pairs, min(HELD_OUT, users // 5)))
        return made[i]

    return t.keep("held-train", lambda: part(0)), t.keep("held-test", lambda: part(1))


HELD_SQL = {
    "hu": f"SELECT user_id FROM (SELECT DISTINCT user_id FROM pos) ORDER BY md5(user_id || '-42'), user_id LIMIT (SELECT least({HELD_OUT}, count(DISTINCT user_id) // 5) FROM pos)",
    "htr": "SELECT user_id, item_id, target FROM labelled ANTI JOIN hu USING (user_id)",
    "hte": "SELECT user_id, item_id FROM labelled SEMI JOIN hu USING (user_id) WHERE target = 1 AND item_id IN (SELECT item_id FROM htr)",
}


@query("split_loo", "SELECT user_id, item_id AS test_item_id FROM loo_test")
def _(t):
    return loo(t)[1].withColumnRenamed("item_id", "test_item_id")


@query(
    "split_loo_full",
    """SELECT l.user_id, l.item_id, CASE WHEN x.user_id IS NULL THEN l.target ELSE 2 END AS part
       FROM labelled l SEMI JOIN (SELECT user_id AS u FROM loo_test) t ON l.user_id = u LEFT JOIN loo_test x USING (user_id, item_id)""",
)
def _(t):
    train, test = splits.leave_one_out_rows(t.labelled_pairs)
    return train.withColumnRenamed("target", "part").unionByName(test.withColumn("part", F.lit(2)))


@query(
    "split_seed_n",
    f"""WITH {_sql(seed_sql(3))} SELECT user_id, item_id, 'seed' AS part FROM sd3 UNION ALL SELECT user_id, item_id, 'test' FROM te3
        UNION ALL SELECT user_id, item_id, 'negative' FROM labelled SEMI JOIN el3 USING (user_id) WHERE target = 0""",
)
def _(t):
    train, test = seed_split(t, 3)
    part = F.when(F.col("target") == 1, "seed").otherwise("negative")
    return train.select("user_id", "item_id", part.alias("part")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "split_heldout_users",
    f"""WITH {_sql(HELD_SQL)} SELECT user_id, item_id, 'train' AS part FROM htr UNION ALL SELECT user_id, item_id, 'test' FROM hte""",
)
def _(t):
    train, test = held_out(t)
    return train.select("user_id", "item_id", F.lit("train").alias("part")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "split_hash_10",
    """SELECT user_id, item_id, (('0x' || substr(md5(user_id || '-' || item_id || '-42'), 1, 8))::BIGINT < 429496729)::BIGINT AS is_validation FROM labelled""",
)
def _(t):
    labelled = t.interactions.select("user_id", "item_id").distinct()
    return splits.train_validation(labelled, 0.1, 42, "user_id", "item_id")


# --- leave-one-out metrics -----------------------------------------------------------


def _loo_sql(recs: str, known: str, model: str, test: str = "loo_test") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{model}' AS model, {k} AS k, round(count(*) FILTER (WHERE rank <= {k}) / count(*), 5) AS recall,
        round(count(*) FILTER (WHERE rank <= {k}) / (count(*) * {k}), 5) AS precision,
        round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) / count(*), 5) AS ndcg, count(*) AS users_evaluated
        FROM {test} t LEFT JOIN {recs} r USING (user_id, item_id) WHERE t.item_id IN (SELECT item_id FROM {known})"""
        for k in metrics.KS
    )


@query(
    "itemknn_loo_metrics",
    f"""WITH {_sql(knn_recs("r", "loo_train", "loo_nb", "sim", 20))} {_loo_sql("r", "loo_train", "ItemKNN")}""",
)
def _(t):
    train, test = loo(t)
    recs = itemknn.recommend(train, itemknn.neighbors(train, ITEM_K), 20)
    return metrics.loo_metrics(test, recs, train)


EMB_LOO = f"""
tvv AS (SELECT user_id, dim, avg(x) AS v FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM loo_train JOIN items_v USING (item_id)) GROUP BY 1, 2),
{_topk_sql("tvv", 20, "SELECT user_id, item_id FROM loo_train")}"""


@query("embedding_loo_metrics", f"WITH {EMB_LOO} {_loo_sql('rk', 'items_v', 'Embedding')}")
def _(t):
    train, test = loo(t)
    recs = embeddings.score_topk(embeddings.warm_vectors(train, None, t.item_vectors, DIMS), t.item_vectors, 20, train)
    return metrics.loo_metrics(test, recs, t.item_vectors, model="Embedding")


NEGATIVES = 999


def _permuted(x: str) -> str:
    """SQL of a permutation's value: the same four steps on the grid ``a`` x ``b``."""
    row, column = f"({x} // b)", f"({x} % b)"
    for i in range(4):
        shift = f"(({row if i % 2 else column}) * c{i} + k{i}) % 2147483647"
        if i % 2:
            column = f"({column} + {shift}) % b"
        else:
            row = f"({row} + {shift}) % a"
    return f"{row} * b + {column}"


_KEYS = ", ".join(
    f"('0x' || substr(md5(user_id || '-42-p{i}'), 1, 8))::BIGINT % 2147483646 + 1 AS c{i}, ('0x' || substr(md5(user_id || '-42-p{i}'), 9, 8))::BIGINT % 2147483647 AS k{i}"
    for i in range(4)
)


@query(
    "sampled_negative_metrics",
    f"""WITH tvv AS (SELECT user_id, dim, avg(x) AS v FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM loo_train JOIN items_v USING (item_id)) GROUP BY 1, 2),
        uv AS (SELECT user_id, list(v ORDER BY dim) AS u FROM tvv GROUP BY 1),
        sl AS (SELECT item_id, embedding, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM items_v),
        nn AS (SELECT count(*) AS n FROM sl),
        gr AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, greatest(1, floor(sqrt(n))::BIGINT) + unnest(range(64)) AS a FROM nn) ORDER BY a * ((n + a - 1) // a), a LIMIT 1),
        ps AS (SELECT user_id, round(list_dot_product(u, embedding), 6) AS p FROM loo_test JOIN items_v USING (item_id) JOIN uv USING (user_id)),
        hs AS (SELECT user_id, slot FROM pos JOIN sl USING (item_id)),
        hn AS (SELECT user_id, count(*) AS held FROM hs GROUP BY 1),
        ky AS (SELECT user_id, a, b, n, least(a * b, {NEGATIVES} + a * b - n + coalesce(held, 0)) AS draws, {_KEYS} FROM ps LEFT JOIN hn USING (user_id), gr),
        dr AS (SELECT user_id, x, {_permuted("x")} AS slot, n FROM (SELECT *, unnest(range(draws)) AS x FROM ky)),
        fr AS (SELECT user_id, slot FROM dr ANTI JOIN hs USING (user_id, slot) WHERE slot < n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x) <= {NEGATIVES}),
        ng AS (SELECT user_id, round(list_dot_product(u, embedding), 6) AS s FROM fr JOIN sl USING (slot) JOIN uv USING (user_id)),
        rn AS (SELECT user_id, 1 + count(*) FILTER (WHERE s > p) AS rank FROM ps LEFT JOIN ng USING (user_id) GROUP BY 1, p)
        """ + " UNION ALL ".join(
        f"""SELECT 'sampled_negatives' AS model, {k} AS k, round(count(*) FILTER (WHERE rank <= {k}) / count(*), 5) AS recall, round(count(*) FILTER (WHERE rank <= {k}) / (count(*) * {k}), 5) AS precision,
        round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) / count(*), 5) AS ndcg, count(*) AS users_evaluated FROM rn""" for k in metrics.KS),
)
def _(t):
    train, test = loo(t)
    usable = test.join(t.item_vectors.select("item_id"), "item_id", "left_semi")
    users = embeddings.warm_vectors(train, None, t.item_vectors, DIMS)
    return metrics.sampled_negative_metrics(usable, pairs(t), t.item_vectors, users, NEGATIVES, 42)


POP_LOO = "pl_top AS (SELECT item_id, count(*) AS n FROM loo_train GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20)"


@query(
    "popularity_loo",
    f"""WITH {POP_LOO} SELECT count(*) AS n_test, count(p.item_id) AS n_hit, round(count(p.item_id) / count(*), 5) AS recall FROM loo_test LEFT JOIN pl_top p USING (item_id)""",
)
def _(t):
    train, test = loo(t)
    return metrics.hit_rate(test, metrics.popular(train, 20))


# --- several relevant items ------------------------------------------------------------


def _multi_sql(recs: str, truth: str, users: str, model: str, notes: str) -> str:
    """Multi-truth metrics; ``recs`` may be a per-user or (user_id missing) shared list."""
    ideal = lambda k: f"list_sum(list_transform(range(1, least(n_truth, {k}) + 1), lambda r: 1 / log2(r + 1)))"
    return " UNION ALL ".join(
        f"""SELECT '{model}' AS model, {k} AS k, round(coalesce(avg(h{k} / n_truth), 0), 5) AS recall, round(coalesce(avg(h{k} / {k}), 0), 5) AS precision,
        round(coalesce(avg(g{k} / {ideal(k)}), 0), 5) AS ndcg, count(*) AS users_evaluated, '{notes}' AS notes FROM
        (SELECT t.user_id, count(*) AS n_truth, count(*) FILTER (WHERE r.rank <= {k}) AS h{k}, coalesce(sum(1 / log2(r.rank + 1)) FILTER (WHERE r.rank <= {k}), 0) AS g{k}
         FROM (SELECT DISTINCT user_id, item_id FROM {truth}) t SEMI JOIN (SELECT user_id AS pu FROM {users}) ON t.user_id = pu LEFT JOIN {recs} r ON r.item_id = t.item_id {'AND r.user_id = t.user_id' if recs[0] != 'p' else ''} GROUP BY 1)"""
        for k in metrics.KS
    )


@query(
    "topk_metrics_multi",
    f"""WITH {_sql(seed_sql(5) | knn("sd5", ITEM_K, "m_") | knn_recs("r", "sd5", "m_nb", "sim", 20))} {_multi_sql("r", "te5", "r", "ItemKNN", "split=A_N5")}""",
)
def _(t):
    seeds, test = seed_pairs(t, 5)
    # Neighbours come from the seeds: the test positives must not be known.
    recs = itemknn.recommend(seeds, itemknn.neighbors(seeds, ITEM_K), 20)
    return metrics.multi_truth_metrics(recs, test, model="ItemKNN", notes="split=A_N5")


def cold_itemknn(t: Tables, n: int, item_k: int):
    """ItemKNN on the seeds alone; users without recommendations count as zero."""
    seeds, test = seed_pairs(t, n)
    recs = itemknn.recommend(seeds, itemknn.neighbors(seeds, item_k), 20)
    return metrics.multi_truth_metrics(recs, test, model="ItemKNN", notes=f"split=A_N{n}, item_k={item_k}", users=test)


def _cold_knn_sql(n: int, item_k: int) -> tuple[dict[str, str], str]:
    p = f"k{n}_{item_k}_"
    parts = seed_sql(n) | knn(f"sd{n}", item_k, p) | knn_recs(f"{p}r", f"sd{n}", f"{p}nb", "sim", 20)
    return parts, _multi_sql(f"{p}r", f"te{n}", f"te{n}", "ItemKNN", f"split=A_N{n}, item_k={item_k}")


def _union_sql(parts: list[tuple[dict[str, str], str]]) -> tuple[dict[str, str], str]:
    shared: dict[str, str] = {}
    for tables_, _ in parts:
        shared |= tables_
    return shared, " UNION ALL ".join(body for _, body in parts)


KNN_RUNS = ((1, 20), (3, 20), (5, 20))
_knn_tables, _knn_body = _union_sql([_cold_knn_sql(n, k) for n, k in KNN_RUNS])


@query("coldstart_itemknn_metrics", f"WITH {_sql(_knn_tables)} {_knn_body}")
def _(t):
    return metrics.combine(*[cold_itemknn(t, n, k) for n, k in KNN_RUNS])


def cold_popularity(t: Tables):
    """Popularity on the three seed splits and the held-out users."""
    train, test = held_out(t)
    runs = [(f"A_N{n}", *seed_pairs(t, n)) for n in SEED_SPLITS] + [("C", train.filter("target = 1"), test)]
    out = []
    for name, known, test in runs:
        users = test.select("user_id").distinct()
        top = t.keep(f"popular-{name}", lambda known=known: metrics.popular(known, 20))
        recs = metrics.repeated(users, top)
        out.append(
            metrics.multi_truth_metrics(recs, test, model="Popularity", notes=f"split={name}", users=recs.filter("rank = 1"), listed=top)
        )
    return metrics.combine(*out)


def _pop_sql(name: str, train: str, truth: str) -> tuple[dict[str, str], str]:
    top = f"SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM {train} GROUP BY 1 QUALIFY rank <= 20"
    return {f"p{name}": top}, _multi_sql(f"p{name}", truth, truth, "Popularity", f"split={name}")


_pop_parts = [(seed_sql(n) | _pop_sql(f"A_N{n}", f"sd{n}", f"te{n}")[0], _pop_sql(f"A_N{n}", f"sd{n}", f"te{n}")[1]) for n in (1, 3, 5)]
_pop_c = _pop_sql("C", "(SELECT * FROM htr WHERE target = 1)", "hte")
_pop_tables, _pop_body = _union_sql(_pop_parts + [(HELD_SQL | _pop_c[0], _pop_c[1])])


@query("coldstart_popularity_metrics", f"WITH {_sql(_pop_tables)} {_pop_body}")
def _(t):
    return cold_popularity(t)


COLD_SQL = f"""WITH {_sql(HELD_SQL)}, {tags_sql("(SELECT * FROM tg ANTI JOIN hu USING (user_id))")}, hv AS (SELECT user_id, dim, f AS v FROM fv SEMI JOIN hu USING (user_id)),
    {_topk_sql("hv", 20, "SELECT 0 AS user_id, 0 AS item_id WHERE FALSE")} {_multi_sql("rk", "hte", "rk", "Hybrid", "split=C")}"""


def cold_hybrid(t: Tables):
    """The hybrid model on users it has never seen: their tags alone, with tag vectors of the known users."""
    train, test = held_out(t)
    everyone = features.profile_tags(t.users, AS_OF)
    tagged = everyone.join(test.select("user_id").distinct(), "user_id", "left_semi")
    known = everyone.join(train.select("user_id").distinct(), "user_id", "left_semi")
    users = embeddings.tag_vectors(tagged, tag_table(t, known), DIMS)
    recs = embeddings.score_topk(users, t.item_vectors, 20)
    return metrics.multi_truth_metrics(recs, test, model="Hybrid", notes="split=C")


@query("coldstart_cold_metrics", COLD_SQL)
def _(t):
    return cold_hybrid(t)


FACTOR_SPLITS = (1, 3, 5)


def cold_factors(t: Tables):
    """Hybrid and pure collaborative vectors of known users on the three seed splits, both from the seeds alone."""
    tagged = features.profile_tags(t.users, AS_OF)
    runs, truths = {}, {}
    for n in FACTOR_SPLITS:
        seeds, truths[n] = seed_pairs(t, n)
        runs[f"PureCF-{n}"] = (embeddings.warm_vectors(seeds, None, t.item_vectors, DIMS), seeds)
        runs[f"Hybrid-{n}"] = (embeddings.hybrid_vectors(seeds, tagged, tag_table(t, tagged, seeds), t.item_vectors, DIMS), seeds)
    recs = embeddings.score_topk_runs(runs, t.item_vectors, 20)
    return metrics.combine(
        *[
            metrics.multi_truth_metrics(recs.filter(F.col("run") == f"{model}-{n}").drop("run"), truths[n], model=model, notes=f"split=A_N{n}")
            for n in FACTOR_SPLITS
            for model in ("Hybrid", "PureCF")
        ]
    )


def _factor_sql(n: int) -> tuple[dict[str, str], str]:
    unfolded = "unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim"
    p = f"f{n}_"
    parts = seed_sql(n) | {
        "ptg": f"SELECT user_id, unnest(string_split(tags, ',')) AS tag FROM ({PROFILE_TAGS})",
        f"{p}w": f"SELECT user_id, dim, avg(x) AS v FROM (SELECT user_id, {unfolded} FROM sd{n} JOIN items_v USING (item_id)) GROUP BY 1, 2",
        f"{p}t": f"SELECT tag, dim, avg(x) AS v FROM (SELECT tag, {unfolded} FROM ptg JOIN sd{n} USING (user_id) JOIN items_v USING (item_id)) WHERE tag <> 'gender_unknown' GROUP BY 1, 2",
        f"{p}f": f"SELECT user_id, dim, avg(v) AS v FROM ptg JOIN {p}t USING (tag) GROUP BY 1, 2",
        f"{p}PureCF": f"SELECT user_id, list(v ORDER BY dim) AS u FROM {p}w GROUP BY 1",
        f"{p}Hybrid": f"SELECT w.user_id, list(w.v + coalesce(f.v, 0) ORDER BY w.dim) AS u FROM {p}w w LEFT JOIN {p}f f ON f.user_id = w.user_id AND f.dim = w.dim GROUP BY 1",
    }
    bodies = []
    for model in ("Hybrid", "PureCF"):
        parts[f"{p}r{model}"] = f"""SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM
            (SELECT m.user_id, i.item_id, round(list_dot_product(u, embedding) + 0.3::DOUBLE * bias, 6) AS score FROM {p}{model} m, items_v i
             LEFT JOIN sd{n} x ON x.user_id = m.user_id AND x.item_id = i.item_id WHERE x.user_id IS NULL) QUALIFY rank <= 20"""
        bodies.append(_multi_sql(f"{p}r{model}", f"te{n}", f"{p}r{model}", model, f"split=A_N{n}"))
    return parts, " UNION ALL ".join(bodies)


_factor_tables, _factor_body = _union_sql([_factor_sql(n) for n in FACTOR_SPLITS])


@query("coldstart_factor_metrics", f"WITH {_sql(_factor_tables)} {_factor_body}")
def _(t):
    return cold_factors(t)


# --- grid -----------------------------------------------------------------------------


def grid(t: Tables):
    train, test = loo(t)
    lists = itemknn.neighbor_lists(train, max(metrics.GRID_K), popularity=itemknn.item_popularity(train))
    return metrics.knn_grid(test, train, lists)


def shared_grid(t: Tables):
    """The full grid, computed once for all reports of a run."""
    return once(t.spark, ("grid", t.sf_dir), lambda: grid(t))


def grid_sql(item_ks, thresholds, modes) -> dict[str, str]:
    cells = [(k, t) for k in item_ks for t in thresholds]
    value = {
        "baseline": "floor(s / 1000.0::DOUBLE + 0.5)",
        "sim2": "floor(q / 1000.0::DOUBLE + 0.5)",
        "normalize_seed": "floor(s / (1000.0::DOUBLE * n_seeds) + 0.5)",
        "pop_pow": "floor(s / (1000.0::DOUBLE * pow(n::DOUBLE, 0.5)) + 0.5)",
        "pop_log": "floor(s / (1000.0::DOUBLE * pow(ln(1 + n::DOUBLE), 0.5)) + 0.5)",
    }
    scores = ", ".join(f"{value[m]} AS {m}" for m in modes)
    ahead = ", ".join(f"1 + count(*) FILTER (WHERE s.{m} > t.{m} OR (s.{m} = t.{m} AND s.item_id < t.item_id)) AS {m}" for m in modes)
    sums = ", ".join(
        f"coalesce(count(*) FILTER (WHERE rank <= {q}), 0) AS h{q}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {q}), 0) AS g{q}" for q in metrics.KS
    )
    out = ", ".join(
        f"round(coalesce(h{q}, 0) / users, 5) AS recall_{q}, round(coalesce(h{q}, 0) / (users * {q}), 5) AS precision_{q}, round(coalesce(g{q}, 0) / users, 5) AS ndcg_{q}"
        for q in metrics.KS
    )
    cell_rows = ", ".join(f"({i}, {k}, {t}::DOUBLE)" for i, (k, t) in enumerate(cells))
    return knn("loo_train", max(item_ks), "grid_") | {
        "ce": f"SELECT * FROM (VALUES {cell_rows}) v(cell, item_k, sim_threshold)",
        "gt": "SELECT * FROM loo_test WHERE item_id IN (SELECT item_id FROM loo_train)",
        "ga": """SELECT s.user_id, neighbor_id AS item_id, cell, sum(floor(sim * 1e9 + 0.5)::BIGINT)::DOUBLE AS s, sum(floor(sim * sim * 1e9 + 0.5)::BIGINT)::DOUBLE AS q
            FROM loo_train s JOIN grid_nb b ON b.item_id = s.item_id JOIN ce ON rank <= item_k AND sim > sim_threshold GROUP BY 1, 2, 3""",
        "gs": f"""SELECT ga.user_id, ga.item_id, cell, {scores} FROM ga ANTI JOIN loo_train x USING (user_id, item_id) JOIN grid_cnt USING (item_id)
            JOIN (SELECT user_id, count(*) AS n_seeds FROM loo_train GROUP BY 1) USING (user_id)""",
        "gr": f"SELECT s.user_id, cell, {ahead} FROM gs s JOIN (SELECT gs.* FROM gs SEMI JOIN gt USING (user_id, item_id)) t USING (user_id, cell) GROUP BY 1, 2",
        "gl": " UNION ALL ".join(f"SELECT cell, '{m}' AS agg, {m} AS rank FROM gr" for m in modes),
        "gf": f"SELECT cell, agg, {sums} FROM gl GROUP BY 1, 2",
        "gm": f"""SELECT agg, item_k, sim_threshold, users, {out} FROM (SELECT ce.*, agg, users FROM ce, (SELECT unnest({list(modes)}) AS agg) m, (SELECT count(*) AS users FROM gt) u) c
            LEFT JOIN gf USING (cell, agg)""",
    }


FULL_GRID = grid_sql(metrics.GRID_K, metrics.GRID_THRESHOLD, metrics.GRID_MODE)


@query("itemknn_grid", f"WITH {_sql(FULL_GRID)} SELECT * FROM gm")
def _(t):
    return grid(t)


@query(
    "grid_best",
    f"""WITH {_sql(FULL_GRID)} SELECT agg, item_k, sim_threshold, recall_10, ndcg_10 FROM gm
        QUALIFY row_number() OVER (PARTITION BY agg ORDER BY recall_10 DESC, ndcg_10 DESC, item_k, sim_threshold) = 1""",
)
def _(t):
    order = [F.desc("recall_10"), F.desc("ndcg_10"), F.col("item_k"), F.col("sim_threshold")]
    return metrics.best_per(shared_grid(t), "agg", order).select("agg", "item_k", "sim_threshold", "recall_10", "ndcg_10")


@query(
    "grid_ranked",
    f"""WITH {_sql(FULL_GRID)} SELECT row_number() OVER (ORDER BY recall_10 DESC, ndcg_10 DESC, agg, item_k, sim_threshold) AS place, agg, item_k, sim_threshold,
        recall_10, precision_10, ndcg_10, recall_20, precision_20, ndcg_20 FROM gm""",
)
def _(t):
    """All configurations, best first; there are as many rows as the grid has cells."""
    order = [F.desc("recall_10"), F.desc("ndcg_10"), F.col("agg"), F.col("item_k"), F.col("sim_threshold")]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return shared_grid(t).withColumn("place", place).drop("users")


@query(
    "grid_matrix",
    f"""WITH {_sql(FULL_GRID)} SELECT sim_threshold, {", ".join(f"round(avg(recall_10) FILTER (WHERE item_k = {k}), 5) AS k_{k}" for k in metrics.GRID_K)} FROM gm GROUP BY 1""",
)
def _(t):
    out = metrics.grid_matrix(shared_grid(t), metrics.GRID_K)
    return out.select("sim_threshold", *[F.col(str(k)).alias(f"k_{k}") for k in metrics.GRID_K])


BEST = "best AS (SELECT * FROM gm ORDER BY ndcg_20 DESC, recall_20 DESC, agg, item_k, sim_threshold LIMIT 1)"


def best_config(t: Tables):
    order = [F.desc("ndcg_20"), F.desc("recall_20"), "agg", "item_k", "sim_threshold"]
    return shared_grid(t).orderBy(*order).limit(1)


MELT = " UNION ALL ".join(f"SELECT agg, {k} AS k, recall_{k} AS recall, precision_{k} AS precision, ndcg_{k} AS ndcg FROM gm" for k in metrics.KS)


@query("metrics_melt", f"WITH {_sql(FULL_GRID)}, m AS ({MELT}) SELECT agg, k, recall, precision, ndcg FROM m")
def _(t):
    return metrics.melt(shared_grid(t), ["agg"])


@query(
    "model_comparison",
    f"""WITH {_sql(FULL_GRID)}, {BEST}, {EMB_LOO}, {POP_LOO}
        {" UNION ALL ".join(f"SELECT 'ItemKNN(' || agg || ')' AS model, {k} AS k, recall_{k} AS recall, precision_{k} AS precision, ndcg_{k} AS ndcg FROM best" for k in metrics.KS)}
        UNION ALL SELECT model, k, recall, precision, ndcg FROM ({_loo_sql("rk", "items_v", "Embedding")})
        UNION ALL SELECT 'Popularity', 20, round(count(p.item_id) / count(*), 5), NULL, NULL FROM loo_test LEFT JOIN pl_top p USING (item_id)""",
)
def _(t):
    train, test = loo(t)
    knn_rows = metrics.melt(best_config(t), ["agg"]).withColumn("model", F.concat(F.lit("ItemKNN("), F.col("agg"), F.lit(")"))).drop("agg")
    recs = embeddings.score_topk(embeddings.warm_vectors(train, None, t.item_vectors, DIMS), t.item_vectors, 20, train)
    emb_rows = metrics.loo_metrics(test, recs, t.item_vectors, model="Embedding").drop("users_evaluated")
    pop_rows = metrics.hit_rate(test, metrics.popular(train, 20)).select(
        F.lit("Popularity").alias("model"), F.lit(20).alias("k"), "recall"
    )
    both = metrics.combine(knn_rows, emb_rows, pop_rows)
    return both.orderBy("k", F.desc_nulls_last("ndcg"), F.desc_nulls_last("recall")).select("model", "k", "recall", "precision", "ndcg")


# --- metric log -----------------------------------------------------------------------


MODELS = ("Hybrid", "ItemKNN", "Popularity", "PureCF")


def metric_log(t: Tables):
    """The cold-start runs of all four models as a log; ItemKNN was run twice.

    Once the splits are written the runs do not depend on each other. Each is a
    chain of small jobs, so they are made side by side.
    """
    held_out(t)
    for n in SEED_SPLITS:
        seed_pairs(t, n)
    knn_runs = [(n, k) for k in (20, 10) for n in SEED_SPLITS]
    made = side_by_side(
        t.spark, [lambda: cold_popularity(t), lambda: cold_factors(t), lambda: cold_hybrid(t), *[lambda n=n, k=k: cold_itemknn(t, n, k) for n, k in knn_runs]]
    )
    popularity, factor, cold, *knn_made = made
    runs = [
        popularity.withColumn("date", F.lit("2025-01-01")),
        metrics.combine(*knn_made[: len(SEED_SPLITS)]).withColumn("date", F.lit("2025-01-02")),
        metrics.combine(*knn_made[len(SEED_SPLITS) :]).withColumn("date", F.lit("2025-01-03")),
        metrics.combine(factor, cold).withColumn("date", F.lit("2025-01-04")),
    ]
    return metrics.with_split(metrics.combine(*runs))


_log_parts = []
for _date, _runs in (("2025-01-02", ((1, 20), (3, 20), (5, 20))), ("2025-01-03", ((1, 10), (3, 10), (5, 10)))):
    for _n, _k in _runs:
        _tables, _body = _cold_knn_sql(_n, _k)
        _log_parts.append((_tables, f"SELECT *, '{_date}' AS date FROM ({_body})"))
_log_parts.append((_pop_tables, f"SELECT *, '2025-01-01' AS date FROM ({_pop_body})"))
_log_parts.append((_factor_tables, f"SELECT *, '2025-01-04' AS date FROM ({_factor_body})"))
_log_parts.append(({}, f"SELECT *, '2025-01-04' AS date FROM ({COLD_SQL})"))
_log_tables, _log_body = _union_sql(_log_parts)
LATEST = f"""{_sql(_log_tables)}, lg AS (SELECT *, regexp_extract(notes, 'split=([A-Za-z0-9_]+)', 1) AS split FROM ({_log_body})),
lt AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY model, k, split ORDER BY date DESC) = 1)"""


def latest_metrics(t: Tables):
    log = once(t.spark, ("metric-log", t.sf_dir), lambda: metric_log(t))
    return metrics.latest(log, ["model", "k", "split"], ["date"])


@query("metrics_latest", f"WITH {LATEST} SELECT model, k, split, recall, precision, ndcg, users_evaluated, notes, date FROM lt")
def _(t):
    return latest_metrics(t)


@query("coldstart_comparison", f"WITH {LATEST} SELECT split, model, k, recall, precision, ndcg, users_evaluated FROM lt")
def _(t):
    return latest_metrics(t).orderBy("split", "k", F.desc("ndcg"), F.desc("recall")).select(
        "split", "model", "k", "recall", "precision", "ndcg", "users_evaluated"
    )


@query(
    "metrics_pivot",
    f"""WITH {LATEST} SELECT split, {", ".join(f"max(ndcg) FILTER (WHERE model = '{m}') AS {m.lower()}" for m in MODELS)} FROM lt WHERE k = 20 GROUP BY 1""",
)
def _(t):
    wide = latest_metrics(t).filter("k = 20").groupBy("split").pivot("model", list(MODELS)).agg(F.first("ndcg"))
    return wide.select("split", *[F.col(m).alias(m.lower()) for m in MODELS])


@query(
    "ablation_gap",
    f"""WITH {LATEST} SELECT a.split, a.k, round(a.ndcg - b.ndcg, 5) AS ndcg_gap, round(a.recall - b.recall, 5) AS recall_gap FROM lt a JOIN lt b USING (split, k)
        WHERE a.model = 'Hybrid' AND b.model = 'PureCF'""",
)
def _(t):
    """What the features add: hybrid minus pure collaborative, on the splits that both can serve."""
    rows = latest_metrics(t)
    part = lambda m: rows.filter(F.col("model") == m).select("split", "k", F.col("ndcg").alias(f"ndcg_{m}"), F.col("recall").alias(f"recall_{m}"))
    gap = lambda c: F.round(F.col(f"{c}_Hybrid") - F.col(f"{c}_PureCF"), 5).alias(f"{c}_gap")
    return part("Hybrid").join(part("PureCF"), ["split", "k"]).select("split", "k", gap("ndcg"), gap("recall"))


@query(
    "metrics_log_append",
    f"""WITH {_sql(_pop_tables)}, m AS ({_pop_body}) SELECT date, model, k, recall, precision, ndcg, users_evaluated, notes
        FROM m, (SELECT unnest(['2025-01-01', '2025-01-02']) AS date)""",
)
def _(t):
    path = run_dir(t.spark, "metrics-log")
    rows = materialize(cold_popularity(t), "popularity-metrics")
    for date in ("2025-01-01", "2025-01-02"):
        tables.append_metrics(rows.withColumn("date", F.lit(date)), path, METRICS)
    return t.spark.read.schema(METRICS).parquet(path)


# --- classifier report ---------------------------------------------------------------


@query(
    "confusion_report",
    """WITH u AS (SELECT user_id, sum(target) / count(*) AS us FROM labelled GROUP BY 1), i AS (SELECT item_id, sum(target) / count(*) AS its FROM labelled GROUP BY 1),
       p AS (SELECT target AS label, ((us + its) / 2.0::DOUBLE >= 0.67)::INT AS pred FROM labelled JOIN u USING (user_id) JOIN i USING (item_id)),
       c AS (SELECT l AS label, count(*) FILTER (WHERE label = l) AS support, count(*) FILTER (WHERE pred = l) AS predicted, count(*) FILTER (WHERE label = l AND pred = l) AS tp
             FROM p, (SELECT unnest([0, 1]) AS l) GROUP BY 1)
       SELECT label, support, round(coalesce(tp / nullif(predicted, 0), 0), 5) AS precision, round(coalesce(tp / nullif(support, 0), 0), 5) AS recall,
       round(coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0), 5) AS f1 FROM c""",
)
def _(t):
    labelled = t.labelled_pairs
    share = F.sum("target") / F.count(F.lit(1))
    users = labelled.groupBy("user_id").agg(share.alias("us"))
    items = labelled.groupBy("item_id").agg(share.alias("its"))
    scored = labelled.join(users, "user_id").join(items, "item_id")
    score = (F.col("us") + F.col("its")) / F.lit(2.0)
    return metrics.confusion(scored.select(F.col("target").alias("label"), score.alias("score")), 0.67)




# --- hybrid model trained from tags: outputs that SQL can state ----------------------------

HYBRID_RANK, HYBRID_ITERATIONS, HYBRID_REG = 8, 3, 2.0


def item_tags(t: Tables):
    """(item_id, tags): language and artist."""
    named = [F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in ("language", "artist_id")]
    return t.catalogue.select("item_id", F.array(*named).alias("tags"))


def _hybrid(t: Tables) -> hybrid.Hybrid:
    """One model per run, fitted on all labelled pairs but those of the held-out users."""
    made: dict = {}

    def build(name: str):
        if not made:
            train, _ = held_out(t)
            model = hybrid.train_hybrid(train, features.profile_tags(t.users, AS_OF), item_tags(t), HYBRID_RANK, HYBRID_ITERATIONS, HYBRID_REG)
            made.update(vars(model))
        return made[name]

    names = ("users", "items", "user_tags", "item_tags")
    return hybrid.Hybrid(**{n: once(t.spark, (f"hybrid-{n}", t.sf_dir), lambda n=n: build(n)) for n in names})


def hybrid_unseen_recs(t: Tables, k: int):
    """Lists for the held-out users, whom the model knows by their tags alone."""
    model, (_, test) = _hybrid(t), held_out(t)
    tagged = features.profile_tags(t.users, AS_OF).join(test.select("user_id").distinct(), "user_id", "left_semi")
    users = hybrid.from_tags(tagged, "user_id", model.user_tags, HYBRID_RANK)
    return embeddings.score_topk(users, model.items, k, beta=1.0)


@query(
    "hybrid_unseen_checks",
    f"""WITH {_sql(HELD_SQL)} SELECT user_id, least(10, n) AS n_listed, least(10, n) AS n_known, 1 AS is_ordered
        FROM (SELECT DISTINCT user_id FROM hte), (SELECT count(DISTINCT item_id) AS n FROM htr)""",
)
def _(t):
    """Per held-out user: rows listed, distinct known items among them, and whether scores fall with the rank."""
    recs = hybrid_unseen_recs(t, 10).join(_hybrid(t).items.select("item_id"), "item_id")
    falls = F.max_by("score", -F.col("rank")) >= F.max_by("score", "rank")
    return recs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_listed"), F.count_distinct("item_id").alias("n_known"), falls.cast("int").alias("is_ordered")
    )


@query(
    "hybrid_model_checks",
    f"""WITH {_sql(HELD_SQL)} SELECT
        (SELECT count(DISTINCT tag) FROM (SELECT user_id, unnest(string_split(tags, ',')) AS tag FROM ({PROFILE_TAGS})) SEMI JOIN htr USING (user_id)) AS n_user_tags,
        (SELECT count(DISTINCT language) + count(DISTINCT artist_id) FROM catalogue SEMI JOIN htr USING (item_id)) AS n_item_tags,
        (SELECT count(DISTINCT user_id) FROM htr) AS n_users, (SELECT count(DISTINCT item_id) FROM htr) AS n_items, 1 AS below_constant, 1 AS has_biases""",
)
def _(t):
    """Sizes of the four tables, whether the loss on the rows learned from is below that of a constant, and whether tags have biases."""
    model, (train, _) = _hybrid(t), held_out(t)
    n = lambda df, c: df.agg(F.count_distinct(c)).scalar()
    biases = model.user_tags.unionByName(model.item_tags).agg((F.max(F.abs("bias")) > 0).cast("int")).scalar()
    return factors.fit_report(train, model).select(
        n(model.user_tags, "tag").alias("n_user_tags"), n(model.item_tags, "tag").alias("n_item_tags"), n(model.users, "user_id").alias("n_users"),
        n(model.items, "item_id").alias("n_items"), (F.col("log_loss") < F.col("constant_loss")).cast("int").alias("below_constant"), biases.alias("has_biases"),
    )
