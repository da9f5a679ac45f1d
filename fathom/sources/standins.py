"""Inputs in the reference's shapes, built from the driver's test tables.

These only render rows into the formats the jobs read (log lines, packet
bodies, rating and title lines); they do no part of any job. Every job below
parses and processes them through the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits_from_events(events: DataFrame) -> DataFrame:
    """Web hits: ip = user id, uri = '/' + event type, event time, stable id."""
    return events.select(
        F.col("event_id").alias("hit_id"),
        F.col("user_id").cast("string").alias("ip"),
        F.concat(F.lit("/"), F.col("event_type")).alias("uri"),
        F.col("ts"),
    )


def access_log_lines(events: DataFrame, offset_hours: int = -4, damaged: bool = False) -> DataFrame:
    """Combined-log-format lines with a non-UTC offset (local time + zone). ``damaged``: lines of type ``error``
    lose the protocol and uri, of type ``signup`` have no such month, of type ``purchase`` lose the last quote."""
    sign = "-" if offset_hours < 0 else "+"
    zone = f"{sign}{abs(offset_hours):02d}00"
    local = F.timestamp_add("HOUR", F.lit(offset_hours), F.col("ts"))
    line = F.format_string(
        '%s - - [%s %s] "GET /%s HTTP/1.1" %d %d "-" "fathom-test/1.0"',
        F.col("user_id").cast("string"),
        F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(zone),
        F.col("event_type"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)),
        F.round(F.col("value") * 100).cast("long"),
    )
    if damaged:
        kind = F.col("event_type")
        line = (F.when(kind == "error", F.regexp_replace(line, '"GET [^"]*"', '"GET"'))
                .when(kind == "signup", F.regexp_replace(line, "/[A-Z][a-z]{2}/", "/Foo/"))
                .when(kind == "purchase", F.regexp_replace(line, '"$', "")).otherwise(line))
    return events.select(F.col("event_id").alias("line_id"), line.alias("line"))


PACKET_DIMS = {"src": "user_id", "app": "event_type", "rs": "value"}
HEAVY_PACKET_DIMS = {"src": "event_type", "dst": "user_id", "rs": "value"}


def packet_bodies(events: DataFrame, dims: dict | None = None, damaged: bool = False) -> DataFrame:
    """Packet records as event bodies: a JSON object per line, single-quoted
    as in the reference's data files, followed by the fields of ``props``.
    ``dims`` maps packet field -> events column (default: src = user,
    app = event type, rs = value). ``damaged``: bodies of type ``error`` end
    with a second line that is no object."""
    dims = dims or PACKET_DIMS
    props_fields = F.regexp_replace(F.col("props"), r"^\s*\{|\}\s*$", "")
    head = F.concat(F.lit("{"), F.concat_ws(", ", *[
        F.concat(F.lit(f"'{k}': '"), F.col(c).cast("string"), F.lit("'")) for k, c in dims.items()]))
    body = F.when(F.length(F.trim(props_fields)) > 0, F.concat(head, F.lit(", "), props_fields, F.lit("}"))) \
        .otherwise(F.concat(head, F.lit("}")))
    if damaged:
        body = F.when(F.col("event_type") == "error", F.concat(body, F.lit("\njunk "), F.col("event_id").cast("string"))).otherwise(body)
    return events.select(F.col("ts"), body.alias("body"))


def rating_lines(orders: DataFrame, lineitem: DataFrame, damaged: bool = False) -> DataFrame:
    """``user::item::rating::order`` lines from order lines; the trailing field
    is an extra one (ignored by the parser) and ``seq`` is the write order.
    ``damaged``: first lines of an order have a user that is no number, second ones end after the item."""
    j = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    rating = F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("l_quantity") / 10))).cast("int")
    line = F.concat_ws("::", F.col("o_custkey").cast("string"), F.col("l_partkey").cast("string"),
                       rating.cast("string"), F.col("l_orderkey").cast("string"))
    if damaged:
        user, item = F.col("o_custkey").cast("string"), F.col("l_partkey").cast("string")
        line = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("u"), line))
                .when(F.col("l_linenumber") == 2, F.concat_ws("::", user, item)).otherwise(line))
    seq = F.struct(F.col("o_orderdate"), F.col("l_orderkey"), F.col("l_linenumber"))
    return j.select(line.alias("line"), seq.alias("seq"))


def item_texts(part: DataFrame, damaged: bool = False) -> DataFrame:
    """Title uploads: ``id::title`` lines with CRLF endings. ``damaged``: small parts' uploads get a second line
    without an id and a third without a title."""
    if damaged:
        key = F.col("p_partkey").cast("string")
        more = F.when(F.col("p_size") < 10, F.concat(F.lit("::"), F.col("p_name"), F.lit("\n"), key, F.lit("::\r\n"))).otherwise(F.lit(""))
        return part.select(F.concat(key, F.lit("::"), F.col("p_name"), F.lit("\r\n"), more).alias("text"))
    return part.select(F.concat(F.col("p_partkey").cast("string"), F.lit("::"), F.col("p_name"), F.lit("\r\n")).alias("text"))


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a sentiment class from the labels: toxic -> negative,
    good quality and not toxic -> positive, else neutral."""
    cls = (F.when(F.col("toxic") == 1, F.lit("negative"))
           .when(F.col("quality") == 1, F.lit("positive"))
           .otherwise(F.lit("neutral")))
    return documents.join(labels, "doc_id").select("doc_id", "text", "lang", cls.alias("sentiment"))


def scored_from_events(events: DataFrame) -> DataFrame:
    """A scored-text stream: class = event type, text = props, event time."""
    return events.select(F.col("event_id").alias("id"), F.col("props").alias("text"),
                         F.col("event_type").alias("sentiment"), F.col("ts"))


def raw_texts(events: DataFrame) -> DataFrame:
    """Raw records of a text feed: the text is missing in records of type ``error``."""
    return events.select(F.when(F.col("event_type") != "error", F.col("props")).alias("text"), "ts")
