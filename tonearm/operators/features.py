"""Member, song and tag features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import buckets, languages, text
from . import quantiles
from .ids import dense_ids


# --- members --------------------------------------------------------------------


def member_features(members: DataFrame) -> DataFrame:
    """Age and tenure groups, gender flags, registration year and size of the city.

    Expects complete members; the city count joins an aggregate, not a window,
    so a city holding a third of the members is counted before any shuffle.
    """
    as_date = lambda c: F.try_to_date(F.col(c).cast("string"), "yyyyMMdd")
    days = F.greatest(F.datediff(as_date("expiration_date"), as_date("registration_init_time")), F.lit(0))
    shaped = members.select(
        "user_id",
        "msno",
        "city",
        "registered_via",
        buckets.age_group(F.col("bd")).alias("bd_group"),
        (F.col("gender") == "female").cast("int").alias("gender_female"),
        (F.col("gender") == "male").cast("int").alias("gender_male"),
        F.year(as_date("registration_init_time")).alias("registration_year"),
        F.coalesce(days, F.lit(0)).alias("membership_days"),
    ).withColumn("membership_group", buckets.tenure_group(F.col("membership_days")))
    return shaped.join(city_count(members), "city", "left")


def city_count(members: DataFrame) -> DataFrame:
    return members.groupBy("city").agg(F.count(F.lit(1)).alias("city_count"))


def member_activity(members: DataFrame, interactions: DataFrame) -> DataFrame:
    plays = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("play_count"))
    counted = members.join(plays, "user_id", "left").fillna(0, ["play_count"])
    per_day = F.col("play_count") / F.greatest(F.col("membership_days"), F.lit(1))
    return counted.withColumn("songs_per_day", per_day)


def user_tags(members: DataFrame) -> DataFrame:
    gender = (
        F.when(F.col("gender_female") == 1, "gender_female")
        .when(F.col("gender_male") == 1, "gender_male")
        .otherwise("gender_unknown")
    )
    return members.select(
        "user_id",
        F.array(
            F.concat(F.lit("bd_"), F.col("bd_group").cast("string")),
            gender,
            F.concat(F.lit("ms_"), F.col("membership_group").cast("string")),
        ).alias("tags"),
    )


def profile_tags(users: DataFrame, as_of: str) -> DataFrame:
    """Tags of site users from their profile; ages outside 10..80 count as group 3."""
    age = F.col("age")
    group = F.when(age.between(10, 80), buckets.age_group(age)).otherwise(3)
    gender = (
        F.when(F.col("gender") == "F", "gender_female").when(F.col("gender") == "M", "gender_male").otherwise("gender_unknown")
    )
    elapsed = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / F.lit(86400)
    days = F.greatest(F.floor(elapsed), F.lit(0))
    tenure = F.coalesce(buckets.tenure_group(days), F.lit(0))
    codes = F.transform(languages.names(F.col("preferred_languages")), lambda n: languages.tag_code(n))
    lang = F.transform(
        F.filter(codes, lambda c: c.isNotNull()), lambda c: F.concat(F.lit("lang_pref_"), c.cast("string"))
    )
    base = F.array(
        F.concat(F.lit("bd_"), group.cast("string")), gender, F.concat(F.lit("ms_"), tenure.cast("string"))
    )
    return users.select("user_id", F.concat(base, lang).alias("tags"))


def language_shares(positives: DataFrame, song_languages: DataFrame) -> DataFrame:
    """(user_id, language, n, share) over the recognised languages."""
    counted = (
        positives.join(song_languages.select("item_id", "language"), "item_id")
        .filter(F.col("language").isin(*languages.TAG_CODES))
        .groupBy("user_id", "language")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per recognised language reaches a user's window.
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


def language_tags(positives: DataFrame, song_languages: DataFrame) -> DataFrame:
    kept = language_shares(positives, song_languages).filter(F.col("share") >= languages.MIN_SHARE)
    return kept.withColumn("tag", F.concat(F.lit("lang_pref_"), F.col("language").cast("string")))


def preferred_languages(positives: DataFrame, song_languages: DataFrame) -> DataFrame:
    """(user_id, preferred_languages) for every user with a positive."""
    known = positives.join(song_languages.select("item_id", "language"), "item_id", "left")
    counts = {
        name: F.count_if(F.col("language") == spec["tag"]).alias(name) for name, spec in languages.LANGUAGES.items()
    }
    wide = known.groupBy("user_id").agg(*counts.values())
    return wide.select(
        "user_id", languages.preferred_string({n: F.col(n) for n in counts}).alias("preferred_languages")
    )


def members_with_language(
    interactions: DataFrame, members: DataFrame, song_languages: DataFrame, top_n: int
) -> DataFrame:
    """The users with most positives, their member row and preferred languages."""
    liked = interactions.filter("target = 1")
    top = (
        liked.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("like_count"))
        .orderBy(F.desc("like_count"), "user_id")
        .limit(top_n)
    )
    chosen = liked.join(top, "user_id", "left_semi")
    return (
        top.join(members, "user_id", "left")
        .join(preferred_languages(chosen, song_languages), "user_id", "left")
    )


# --- songs ------------------------------------------------------------------------


def isrc_features(songs: DataFrame, current_year: int) -> DataFrame:
    code = F.col("isrc")
    return songs.withColumns(
        {
            "has_valid_isrc": text.isrc_valid(code),
            "isrc_country": text.isrc_part(code, 1, 2),
            "isrc_registrant": text.isrc_part(code, 3, 3),
            "isrc_year": text.isrc_part(code, 6, 2),
            "isrc_item_id": text.isrc_part(code, 8, 5),
            "isrc_year_full": text.isrc_year(code),
            "song_age": F.lit(current_year) - text.isrc_year(code),
        }
    )


def artist_popularity(songs: DataFrame) -> DataFrame:
    return songs.groupBy("artist_name").agg(F.count(F.lit(1)).alias("artist_popularity")).withColumn(
        "artist_popularity_log", F.log1p("artist_popularity")
    )


def artist_table(songs: DataFrame) -> DataFrame:
    """One row per artist with a 1-based id in name order."""
    popularity = artist_popularity(songs)
    return popularity.join(dense_ids(popularity, "artist_name", "artist_id", start=1), "artist_name")


def artist_indie_ratio(songs: DataFrame) -> DataFrame:
    def differs(col: str) -> Column:
        return ((F.col(col) != text.UNKNOWN) & (F.col(col) != F.col("artist_name"))).cast("int")

    return songs.groupBy("artist_name").agg(
        F.avg(differs("composer")).alias("composer_diff_ratio"), F.avg(differs("lyricist")).alias("lyricist_diff_ratio")
    )


def genre_vocabulary(songs: DataFrame) -> DataFrame:
    """(position, genre): the sorted genre codes in use; one row per code of the catalogue."""
    used = songs.select(F.explode(text.genres(F.col("genre_ids"))).alias("genre"))
    return dense_ids(used, "genre", "position")


def genre_features(songs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Genre list, count, and a 0/1 vector over the vocabulary.

    The vocabulary is read once as one array (as long as the number of genre
    codes, not of songs).
    """
    listed = songs.withColumn("genre_list", text.genres(F.col("genre_ids")))
    codes = vocabulary.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "genre"))), lambda s: s["genre"])
    ).scalar()
    flag = lambda g: F.array_contains("genre_list", g).cast("int")
    return (
        listed.withColumn("_vocab", codes)
        .withColumn("genre_count", F.size("genre_list"))
        .withColumn("genre_vector", F.transform("_vocab", flag))
        .drop("_vocab")
    )


BASIC = ("has_name", "has_genre", "has_composer", "has_lyricist", "has_isrc", "has_song_extra")
STRICT = tuple("has_valid_isrc" if c == "has_isrc" else c for c in BASIC)


def metadata_scores(songs: DataFrame) -> DataFrame:
    """Filled-field counts; needs the indicators and the validity flag of the code."""
    total = lambda cols: reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return songs.withColumns({"metadata_score": total(BASIC), "metadata_score_strict": total(STRICT)})


def song_features(songs: DataFrame, current_year: int) -> DataFrame:
    """All song features of an imputed song table."""
    coded = metadata_scores(isrc_features(songs, current_year))
    with_genres = genre_features(coded, genre_vocabulary(songs))
    return with_genres.join(artist_popularity(songs), "artist_name", "left")


def length_edges(songs: DataFrame, buckets_n: int = 5) -> tuple[float | None, list[float | None]]:
    """The median length, and the exact quantile edges with missing lengths taken as the median."""
    counts = quantiles.counted(songs, "song_length")
    middle = quantiles.quantiles(counts, "song_length", [0.5])[0]
    missing = songs.filter(F.col("song_length").isNull()).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.select(F.col("song_length").cast("double").alias("song_length"), "n").unionByName(
        missing.select(F.lit(middle).cast("double").alias("song_length"), "n").filter("n > 0 and song_length is not null")
    )
    merged = filled.groupBy("song_length").agg(F.sum("n").alias("n"))
    return middle, quantiles.quantiles(merged, "song_length", [i / buckets_n for i in range(buckets_n + 1)])


def length_bucket(songs: DataFrame, buckets_n: int = 5) -> DataFrame:
    """Right-closed quantile bucket of the length; one bucket for all when edges repeat or there is no length."""
    middle, edges = length_edges(songs, buckets_n)
    if len(set(edges)) < len(edges):
        return songs.withColumn("length_tag", F.lit("len_0"))
    value, label = F.coalesce("song_length", F.lit(middle)), F.lit(None).cast("string")
    for i in range(buckets_n, 0, -1):
        label = F.when(value <= F.lit(edges[i]), f"len_{i - 1}").otherwise(label)
    return songs.withColumn("length_tag", label)


def item_tags(songs: DataFrame, key: str = "song_id", top_artists: int = 5000) -> DataFrame:
    """Language, artist, length and genre tags of every song."""
    top = (
        songs.filter(F.col("artist_name").isNotNull())
        .groupBy("artist_name")
        .count()
        .orderBy(F.desc("count"), "artist_name")
        .limit(top_artists)
        .select("artist_name", F.concat(F.lit("artist_"), F.col("artist_name")).alias("artist_tag"))
    )
    codes = F.filter(F.split("genre_ids", r"\|"), lambda g: g != "")
    genre = F.when(
        F.col("genre_ids").isNull() | (F.col("genre_ids") == text.UNKNOWN), F.array(F.lit("genre_unknown"))
    ).otherwise(F.transform(codes, lambda g: F.concat(F.lit("genre_"), g)))
    lang = F.concat(F.lit("lang_"), F.coalesce(F.col("language").cast("int"), F.lit(-1)).cast("string"))
    return (
        length_bucket(songs)
        .join(top, "artist_name", "left")
        .select(
            key,
            F.concat(F.array(lang, F.coalesce("artist_tag", F.lit("artist_other")), F.col("length_tag")), genre).alias("tags"),
        )
    )


def default_item_tags(items: DataFrame, tagged: DataFrame, key: str = "song_id") -> DataFrame:
    """Tags for every item; those without metadata get the default set."""
    fixed = F.array(*[F.lit(t) for t in ("lang_-1", "artist_other", "len_0", "genre_unknown")])
    return items.select(key).distinct().join(tagged, key, "left").withColumn("tags", F.coalesce("tags", fixed))


def tag_vocabulary(*tagged: DataFrame) -> DataFrame:
    """(tag, tag_id) over all given tag tables, in tag order."""
    tags = [t.select(F.explode("tags").alias("tag")).distinct() for t in tagged]
    return dense_ids(reduce(DataFrame.unionByName, tags), "tag", "tag_id")


def profile_backfill(
    mapping: DataFrame, members: DataFrame, positives: DataFrame, catalogue: DataFrame, limit: int = 100
) -> DataFrame:
    """Site users filled from a historical member, with the number of liked catalogue songs taken over.

    ``mapping`` is (site_user, user_id); members carry the group, the gender
    flags and the preferred languages. The first ``limit`` distinct liked songs
    (by id) are looked up in the catalogue.
    """
    # Representative age of each age group.
    ages = {1: 10, 2: 16, 3: 22, 4: 30, 5: 43, 6: 60}
    age = F.try_element_at(F.create_map(*[F.lit(x) for kv in ages.items() for x in kv]), F.col("bd_group"))
    gender = F.when(F.col("gender_male") == 1, "M").when(F.col("gender_female") == 1, "F").otherwise("O")
    order = Window.partitionBy("user_id").orderBy("item_id")
    first = (
        positives.join(mapping, "user_id", "left_semi")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= limit)
    )
    taken = first.join(catalogue.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_songs")
    )
    return (
        mapping.join(members, "user_id", "left")
        .join(taken, "user_id", "left")
        .select(
            "site_user",
            "user_id",
            age.alias("age"),
            F.when(F.col("bd_group").isNotNull(), gender).alias("gender"),
            "preferred_languages",
            F.coalesce("n_songs", F.lit(0)).alias("n_songs"),
        )
    )
