"""WARC as a content-addressed archive.

Two tables make an archive: ``payloads`` holds every distinct payload once
under its SHA-256, ``headers`` holds the exact header bytes of every record and
the address of its payload.  A record is put together again by joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are eight times 20, each five hex digits or four base-32 digits."""
    digest = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), HEX32, BASE32)


def _record_id(page_id: Column, url: Column, address: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), address))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = DATE, min_dedup_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8 (null: empty).  Of records with equal
    payloads of at least ``min_dedup_bytes``, those with the smallest page_id
    are responses and the others revisits of it; a null page_id counts as
    larger than any other.  Repeated rows stay records of their own, of the
    same type.  Line breaks in an url are percent-encoded in the header.  An
    empty table gives an empty archive; further columns are ignored.

    Equal digests are checked against equal lengths and a second digest before
    a payload is stored once.  Copies meet after a partial aggregate per task.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select(
        "*", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("bigint").alias("bytes")
    )
    check = F.concat(F.col("bytes").cast("string"), F.lit(":"), base32_sha1(F.col("payload")))
    kept = rows.groupBy("address").agg(
        F.first("payload").alias("payload"), F.min(check).alias("_low"), F.max(check).alias("_high"),
    )
    kept.select(
        "address", F.when(F.col("_low") == F.col("_high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads under one digest"))).alias("payload")
    ).write.parquet(f"{path}/payloads")
    heads = rows.select("page_id", "url", "address", "bytes", base32_sha1(F.col("payload")).alias("digest"))
    first = heads.groupBy("address").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("origin")
    )
    joined = heads.join(first, "address")
    origin = F.col("origin.page_id")
    revisit = (F.col("bytes") >= min_dedup_bytes) & origin.isNotNull() & ~F.col("page_id").eqNullSafe(origin)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("address"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", _record_id(origin, F.nullif(F.col("origin.url"), F.lit("")), F.col("address"))),
                line("WARC-Refers-To-Page", origin.cast("string")),
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    joined.select("page_id", F.encode(header, "UTF-8").alias("header"), "address").write.parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload) of every record: headers joined with payloads, each payload checked against its address."""
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select(
        "address",
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("damaged payload"))).alias("payload"),
    )
    return spark.read.parquet(f"{path}/headers").join(payloads, "address").select("page_id", F.decode("header", "UTF-8").alias("header"), "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each record as a WARC file holds them; revisits have no block."""
    own = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), own, F.lit(b"\r\n\r\n")).alias("record"))


def field(name: str, header: str | Column = "header") -> Column:
    """A header field's value, null where the record lacks it."""
    pattern = rf"\r\n{name}: ([^\r\n]*)\r\n"
    return F.when(F.regexp_like(header, F.lit(pattern)), F.regexp_extract(header, pattern, 1))


def index(records: DataFrame) -> DataFrame:
    """What the archive says of each record, sizes and digests taken from the restored payload and held against the header."""
    digest = base32_sha1(F.col("payload"))
    stated = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    return records.select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), digest.alias("_digest"), stated.alias("_stated"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page").cast("bigint").alias("refers_to"),
    ).select(
        "page_id", "payload_bytes",
        F.when(F.col("_digest") == F.col("_stated"), F.col("_digest")).otherwise(F.raise_error(F.lit("payload doesn't match its header"))).alias("payload_digest"),
        "record_type", "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = run_dir(spark, "warc")
    write_archive(pages, path)
    return index(read_records(spark, path))
