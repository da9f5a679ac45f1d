"""Op 3: content-addressed WARC archive, DataFrame functions only.

``write_archive`` stores two tables in one folder: ``payloads`` (address, payload) holds every distinct payload
once under its SHA-256, ``headers`` (page_id, address, header) the exact header bytes of every record. Of the
records with one payload (of at least ``dedup_from`` bytes) the one with the smallest page_id is a response,
the others are revisits that refer to it. ``reconstruct`` joins them into whole records, byte for byte;
``read_headers`` takes its columns from these and verifies payloads, lengths and references of every record.

Only one row per distinct payload is moved with its bytes: grouping and record types use digests alone.

Defined results: null html is the empty payload; a null url leaves out the target line; rows repeated with the
same page_id and html are each a record of the same type; several null page_ids with one payload count as its
smallest only if it has no other; an empty table gives an empty archive; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:x-page:"
# Digits of base 32 as Spark's conv writes them, and the alphabet of RFC 4648.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


def _records(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("n_bytes"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """WARC/1.1 header lines and the HTTP header of the record's block, CRLF ended."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(http + "Content-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("response_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(block) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block), "UTF-8")


def write_archive(pages: DataFrame, path: str, dedup_from: int = 0, date: str = DATE) -> None:
    recs = _records(pages)
    first = recs.groupBy("address").agg(F.min("page_id").alias("response_id"))
    heads = recs.drop("payload").join(first, "address")
    again = (F.col("n_bytes") >= dedup_from) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    heads = heads.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    heads.select("page_id", "address", _header(date).alias("header")).write.parquet(f"{path}/headers")
    # One string key serves the join and the removal of repeated rows, so payloads are moved once.
    key = lambda i: F.concat_ws(":", "address", F.coalesce(F.col(i).cast("string"), F.lit("none")))
    once = recs.withColumn("key", key("page_id")).join(first.select(key("response_id").alias("key")), "key", "left_semi")
    once.select("key", "address", "payload").dropDuplicates(["key"]).select("address", "payload").write.parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: <?([^>\r\n]*)>?\r?$", 1)


def _rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its payload: a revisit's from the response whose record id and digest it names, a response's
    (``source``: the address found so) from itself."""
    heads = spark.read.parquet(f"{path}/headers").select(
        "page_id", "address", "header", _field("WARC-Record-ID").alias("rid"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("digest"))
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("address").alias("source"), "payload")
    revisit = F.col("record_type") == "revisit"
    responses = heads.where(~revisit).groupBy(F.col("rid").alias("target"), "digest").agg(F.min("address").alias("source"))
    found = heads.withColumn("target", F.when(revisit, F.col("refers")).otherwise(F.col("rid"))).join(responses, ["target", "digest"], "left")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return found.join(stored, "source", "left").withColumn("record", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, from the rebuilt records.
    Payloads are verified against address and digest, the lengths of record and payload against both headers."""
    text = F.decode("header", "UTF-8")
    lines = F.substring_index(text, "\r\n\r\n", 1)  # the WARC header; the HTTP header follows
    stated = lambda c: F.expr(rf"try_cast(regexp_extract({c}, '(?m)^Content-Length: (\\d+)\r?$', 1) as bigint)")
    r = _rebuilt(spark, path).select(
        "rid", "refers", "record_type", "address", "source", "digest", lines.alias("lines"), F.substring(text, F.length(lines) + 5, F.length(text)).alias("http"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.octet_length("record").alias("record_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.sha2("payload", 256).alias("found"))
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(RECORD) + 1}), '') as bigint)")
    sound = (F.col("found") == F.col("address")) & (F.col("source") == F.col("address")) & (F.col("digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    fits = (stated("lines") + F.octet_length("lines") + 8 == F.col("record_bytes")) & (stated("http") == F.col("payload_bytes"))
    broken = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce("rid", F.lit("")), F.lit(" "), F.coalesce("address", F.lit("")))).cast("string")
    checked = F.when(F.col("source").isNull(), broken("record refers to no response")).when(~F.coalesce(sound, F.lit(False)), broken("payload differs from its digest"))
    checked = checked.when(~F.coalesce(fits, F.lit(False)), broken("length differs from the header")).otherwise(F.col("payload_digest"))
    return r.select(number("rid").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", number("refers").alias("refers_to"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, header, payload, record``: whole records, a revisit's payload from the response it refers to."""
    return _rebuilt(spark, path).select("page_id", "header", "payload", "record")
