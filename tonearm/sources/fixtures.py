"""The supplied tables seen as a listening site.

``Tables`` maps orders to interactions, parts to songs, customers to members,
and events to plays, likes and playlists. Everything is lazy; each property is
a plan over the Parquet files and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.splits import labelled
from ..session import materialize, tune

# Play sources by event type, members' gender and languages by segment.
SOURCES = {
    "view": "RECOMMENDATION",
    "click": "SEARCH",
    "purchase": "PLAYLIST",
    "signup": "ONBOARDING",
    "error": "FRIEND",
}
GENDERS = {"HOUSEHOLD": "female", "FURNITURE": "female", "MACHINERY": "male", "BUILDING": "male"}
PREFERRED = {
    "BUILDING": "Chinese, English",
    "MACHINERY": "Japanese",
    "FURNITURE": "English,,Korean",
    "AUTOMOBILE": "Chinese",
}
ARCHIVE = "archive"


def _pick(col: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def _every(col: str, n: int, r: int = 0) -> Column:
    return F.col(col) % n == r


def _isrc() -> Column:
    code = F.concat(
        F.upper(F.substring("p_type", 1, 2)),
        F.lit("X"),
        F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"),
        F.lpad(F.col("p_size").cast("string"), 2, "0"),
        F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"),
    )
    return (
        F.when(_every("p_partkey", 5), None)
        .when(_every("p_partkey", 7), F.concat(F.lit("BAD-"), F.col("p_partkey").cast("string")))
        .otherwise(code)
    )


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``build`` makes, written when it is first asked for and read from then on."""
        kept = self.__dict__.setdefault("_kept", {})
        if name not in kept:
            kept[name] = materialize(build(), name)
        return kept[name]

    # --- interactions -------------------------------------------------------

    @cached_property
    def interactions(self) -> DataFrame:
        """(user_id, item_id, target, ts, order_id, line_no): one row per listen."""
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_partkey").alias("item_id"),
            (F.col("l_returnflag") != "R").cast("int").alias("target"),
            F.col("l_linenumber").alias("line_no"),
        )
        orders = self.raw("orders").select(
            "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
        )
        return lines.join(orders, "o_orderkey").select(
            "user_id", "item_id", "target", "ts", F.col("o_orderkey").alias("order_id"), "line_no"
        )

    @cached_property
    def positive_pairs(self) -> DataFrame:
        """Distinct positive (user_id, item_id), written once: most queries read them several times."""
        rows = self.interactions.filter("target = 1").select("user_id", "item_id")
        return materialize(rows.distinct(), "positive-pairs")

    @cached_property
    def labelled_pairs(self) -> DataFrame:
        """Distinct (user_id, item_id, target) of all listens, written once."""
        return materialize(labelled(self.interactions), "labelled-pairs")

    @cached_property
    def train_raw(self) -> DataFrame:
        """The interaction log with string keys and source columns."""
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.concat(F.lit("S"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("song_id"),
            F.col("l_linestatus").alias("source_type"),
            (F.col("l_returnflag") != "R").cast("int").alias("target"),
            "l_linenumber",
        )
        orders = self.raw("orders").select(
            "o_orderkey",
            F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("msno"),
            "o_orderstatus",
            F.col("o_orderpriority").alias("source_screen_name"),
        )
        return lines.join(orders, "o_orderkey").select(
            "msno",
            "song_id",
            F.when(F.col("l_linenumber") != 7, F.col("o_orderstatus")).alias("source_system_tab"),
            "source_screen_name",
            "source_type",
            "target",
        )

    # --- catalogue ----------------------------------------------------------

    @cached_property
    def songs_raw(self) -> DataFrame:
        size = F.col("p_size")
        codes = F.array(*[F.lit(float(c)) for c in (3, 52, 17, 31, 24, 10)])
        first_word = F.substring_index("p_name", " ", 1)
        return self.raw("part").select(
            F.concat(F.lit("S"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("song_id"),
            F.when(~_every("p_partkey", 17), ((F.col("p_partkey") * 7919) % 600000).cast("double")).alias("song_length"),
            F.when(_every("p_partkey", 13), None)
            .when(F.col("p_type") == "PROMO", F.col("p_type"))
            .otherwise(F.concat_ws("|", "p_type", first_word))
            .alias("genre_ids"),
            F.when(~_every("p_partkey", 23), F.col("p_brand")).alias("artist_name"),
            F.when(size % 4 == 0, None)
            .when(size % 4 == 1, F.col("p_brand"))
            .otherwise(F.concat(F.lit("Composer "), size.cast("string")))
            .alias("composer"),
            F.when(size % 5 == 0, None)
            .when(size % 5 == 1, F.col("p_brand"))
            .otherwise(F.concat(F.lit("Lyricist "), (size % 7).cast("string")))
            .alias("lyricist"),
            F.when(~_every("p_partkey", 19), F.get(codes, (size % 6).cast("int"))).alias("language"),
        )

    @cached_property
    def song_extra(self) -> DataFrame:
        return (
            self.raw("part")
            .filter("p_size <> 50")
            .select(
                F.concat(F.lit("S"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("song_id"),
                F.when(~_every("p_partkey", 11), F.col("p_name")).alias("name"),
                _isrc().alias("isrc"),
            )
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        """The site's song table, keyed by the numeric id."""
        codes = F.array(*[F.lit(c) for c in (3, 52, 17, 31, 24, 10)])
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.when(~_every("p_partkey", 23), F.col("p_brand")).alias("artist_name"),
            F.get(codes, (F.col("p_size") % 6).cast("int")).alias("language"),
            F.col("p_type").alias("album_name"),
            F.substring_index("p_brand", "#", -1).cast("bigint").alias("artist_id"),
        )

    @cached_property
    def artists(self) -> DataFrame:
        return self.raw("part").select(
            F.substring_index("p_brand", "#", -1).cast("bigint").alias("artist_id"), F.col("p_brand").alias("artist_name")
        ).distinct()

    # --- members ------------------------------------------------------------

    @cached_property
    def order_span(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").cast("timestamp").alias("first_ts"), F.max("o_orderdate").cast("timestamp").alias("last_ts"))
        )

    @cached_property
    def members_raw(self) -> DataFrame:
        """(msno, city, bd, gender, registered_via, registration_init_time, expiration_date) plus the numeric user id."""
        ymd = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
        return (
            self.raw("customer")
            .join(self.order_span, "c_custkey", "left")
            .select(
                F.col("c_custkey").alias("user_id"),
                F.col("c_name").alias("msno"),
                F.col("c_nationkey").alias("city"),
                (F.col("c_custkey") % 95).cast("int").alias("bd"),
                _pick(F.col("c_mktsegment"), GENDERS).alias("gender"),
                (F.col("c_custkey") % 10).cast("int").alias("registered_via"),
                F.when(_every("c_custkey", 37), 99999999).otherwise(ymd("first_ts")).alias("registration_init_time"),
                ymd("last_ts").alias("expiration_date"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        """The site's user table."""
        segment = F.col("c_mktsegment")
        key = F.col("c_custkey")
        gender = _pick(segment, GENDERS)
        return (
            self.raw("customer")
            .join(self.order_span, "c_custkey", "left")
            .select(
                key.alias("user_id"),
                F.concat(F.when(key % 10 == 0, "dev_").otherwise("g"), key.cast("string")).alias("google_id"),
                F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.org")).alias("email"),
                F.when(key % 3 == 0, None).when(key % 3 == 1, "").otherwise(F.concat(F.lit("nick"), key.cast("string"))).alias("nickname"),
                F.when(key % 41 != 0, (key % 95).cast("int")).alias("age"),
                F.when(gender == "male", "M").when(gender == "female", "F").when(key % 2 == 0, "O").alias("gender"),
                _pick(segment, PREFERRED).alias("preferred_languages"),
                (key % 4 != 0).cast("int").alias("profile_completed"),
                F.col("c_name").alias("google_name"),
                F.col("first_ts").alias("created_at"),
            )
        )

    # --- site events --------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
            "event_type",
            F.floor("value").cast("int").alias("seconds"),
        ).withColumns(
            {
                "is_hidden": (F.col("event_type") == "error") & (F.col("seconds") < 20),
                "playlist_name": F.when(F.col("item_id") % 4 == 0, ARCHIVE).otherwise(
                    F.concat(F.lit("list-"), (F.col("item_id") % 4).cast("string"))
                ),
            }
        )

    @cached_property
    def history(self) -> DataFrame:
        """(id, user_id, item_id, played_at, watch_seconds, source, is_hidden)."""
        return self.events.select(
            F.col("event_id").alias("id"),
            "user_id",
            "item_id",
            F.col("ts").alias("played_at"),
            F.col("seconds").alias("watch_seconds"),
            _pick(F.col("event_type"), SOURCES).alias("source"),
            "is_hidden",
        )

    @cached_property
    def visible(self) -> DataFrame:
        return self.history.filter(~F.col("is_hidden"))

    @cached_property
    def like_log(self) -> DataFrame:
        """Like (true) and dislike (false) requests in time order."""
        return self.events.filter(F.col("event_type").isin("purchase", "error")).select(
            "event_id", "user_id", "item_id", "ts", (F.col("event_type") == "purchase").alias("intent")
        )

    @cached_property
    def playlist_songs(self) -> DataFrame:
        """(playlist_id, user_id, playlist_name, item_id, added_at, event_id)."""
        slot = F.col("item_id") % 4
        return self.events.filter(F.col("event_type") == "signup").select(
            (F.col("user_id") * 10 + slot).alias("playlist_id"),
            "user_id",
            "playlist_name",
            "item_id",
            F.col("ts").alias("added_at"),
            "event_id",
        )

    @cached_property
    def playlists(self) -> DataFrame:
        """Five lists per active user; the last one is always empty."""
        slot = F.explode(F.sequence(F.lit(0), F.lit(4)))
        return (
            self.events.select("user_id").distinct().select("user_id", slot.alias("slot")).select(
                (F.col("user_id") * 10 + F.col("slot")).alias("playlist_id"),
                "user_id",
                F.when(F.col("slot") == 0, ARCHIVE)
                .otherwise(F.concat(F.lit("list-"), F.col("slot").cast("string")))
                .alias("playlist_name"),
            )
        )

    @cached_property
    def play_requests(self) -> DataFrame:
        """Play requests as they arrive, some of them broken."""
        e = F.col("event_id")
        return self.events.select(
            "event_id",
            "user_id",
            "ts",
            F.when(e % 13 == 0, None).when(e % 31 == 0, F.col("item_id") + 100000000).otherwise(F.col("item_id")).alias("item_id"),
            F.when(e % 23 == 0, None)
            .when(e % 29 == 0, "-5")
            .when(e % 37 == 0, "soon")
            .otherwise(F.col("seconds").cast("string"))
            .alias("watch_seconds"),
            F.when(e % 17 == 0, "").when(e % 19 == 0, "RADIO").otherwise(_pick(F.col("event_type"), SOURCES)).alias("source"),
        )

    @cached_property
    def friendships(self) -> DataFrame:
        """Directed edges to the customers 1, 7 and 25 places further, where they exist."""
        ids = self.raw("customer").select(F.col("c_custkey").alias("friend_id"))
        steps = F.explode(F.array(F.lit(1), F.lit(7), F.lit(25)))
        out = self.raw("customer").select(F.col("c_custkey").alias("user_id"), steps.alias("step"))
        edges = out.select("user_id", (F.col("user_id") + F.col("step")).alias("friend_id"))
        kept = edges.join(ids, "friend_id", "left_semi").select("user_id", "friend_id")
        return kept.unionByName(kept.select(F.col("friend_id").alias("user_id"), F.col("user_id").alias("friend_id")))

    @cached_property
    def batches(self) -> DataFrame:
        """Stored recommendation batches: one per order."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("batch_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("timestamp").alias("generated_at"),
        )

    @cached_property
    def batch_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("batch_id"),
            F.col("l_linenumber").alias("rank"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_extendedprice").alias("score"),
        )

    # --- vectors ------------------------------------------------------------

    @cached_property
    def item_vectors(self) -> DataFrame:
        """(item_id, embedding, bias)."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("item_id"), "embedding", (F.col("label") / F.lit(10.0)).alias("bias")
        )

    @cached_property
    def external(self) -> DataFrame:
        """Fetched external metadata, several rows per recording code."""
        docs = self.raw("documents").select(
            "doc_id", "lang", "source", "text", F.floor(F.col("doc_id") / 3).alias("p_partkey")
        )
        codes = self.raw("part").select("p_partkey", _isrc().alias("code"))
        kinds = {"en": "single", "fr": "music track with vocals", "de": "song", "es": "Single release"}
        return docs.join(codes, "p_partkey").select(
            "doc_id",
            F.concat(F.lit(" "), F.lower("code"), F.lit(" ")).alias("isrc"),
            F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Q"), (F.col("doc_id") % 700).cast("string"))).alias("wd_qid"),
            F.col("source").alias("label_en"),
            F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("desc_en"),
            _pick(F.col("lang"), kinds).alias("type_label"),
        )
