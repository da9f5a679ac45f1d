"""Web-log analytics (W1-W11): hits, page views, bounces.

A *hit* frame has ``ip STRING, uri STRING, ts TIMESTAMP_NTZ`` and a stable
tie-break column (``hit_id``) that orders hits with equal timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.time import bucket_index, bucket_start, epoch_us, ensure_ntz, from_epoch_us, micros_of

# The combined access-log line layout and its date format.
# ip, identity, user, [date], "request", status (3 digits), size, "referrer", "agent"
ACCESS_LOG_PATTERN = r'^([\d.]+) (\S+) (\S+) \[([^\]]+)\] "([^"]+)" (\d{3}) (\d+) "([^"]+)" "([^"]+)"\z'
ACCESS_LOG_DATE = "dd/MMM/yyyy:HH:mm:ss Z"


_SEP = "\u0001"


def _parsed(lines: DataFrame, line_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All nine groups from one regex evaluation per line: the matched line is rewritten to its groups joined by a
    control character, then split. Both happen inside a generator, so that Catalyst cannot copy the expression
    into the filters and columns above."""
    line = F.col(line_col)
    joined = F.regexp_replace(line, ACCESS_LOG_PATTERN, _SEP.join(f"${i}" for i in range(1, 10)))
    groups = F.when(line.isNull() | line.contains(_SEP), F.array().cast("array<string>")).otherwise(F.split(joined, _SEP))
    p = lines.select(*keep, line_col, F.inline(F.array(F.struct(groups.alias("_g")))))
    g = lambda i: F.try_element_at(F.col("_g"), F.lit(i))
    req = F.split(g(5), " ", -1)
    ts = F.try_to_timestamp(g(4), F.lit(ACCESS_LOG_DATE))
    reason = (F.when(F.size("_g") != 9, F.lit("no_match"))
              .when(F.size(req) < 3, F.lit("bad_request"))
              .when(ts.isNull(), F.lit("bad_date")))
    return p.select(
        *keep, line_col,
        g(1).alias("ip"),
        F.try_element_at(req, F.lit(2)).alias("uri"),
        from_epoch_us(F.unix_micros(ts)).alias("ts"),
        F.try_element_at(req, F.lit(1)).alias("method"),
        F.expr("try_cast(try_element_at(_g, 6) AS INT)").alias("status"),
        F.expr("try_cast(try_element_at(_g, 7) AS BIGINT)").alias("bytes"),
        g(8).alias("referrer"),
        g(9).alias("agent"),
        reason.alias("_reject"),
    )


HIT_COLUMNS = ["ip", "uri", "ts", "method", "status", "bytes", "referrer", "agent"]


def parse_access_log(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Full match of one combined-log line; unmatched or undatable lines are
    left out (see :func:`access_log_rejects`). ``uri`` is the text between the
    first and second blank of the request. Times are parsed on the 24-hour clock
    with their zone offset and returned as UTC ``TIMESTAMP_NTZ``."""
    p = _parsed(lines, line_col, keep)
    return p.where(F.col("_reject").isNull()).select(*keep, *HIT_COLUMNS)


def access_log_rejects(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """The lines :func:`parse_access_log` leaves out, with the reason."""
    p = _parsed(lines, line_col, keep)
    return p.where(F.col("_reject").isNotNull()).select(*keep, line_col, F.col("_reject").alias("reason"))


def page_views(hits: DataFrame, ip: str = "ip", uri: str = "uri") -> DataFrame:
    """Number of hits per (ip, uri)."""
    return hits.groupBy(ip, uri).agg(F.count(F.lit(1)).alias("views"))


def page_view_map(hits: DataFrame, ip: str = "ip", uri: str = "uri") -> DataFrame:
    """One row per ip: ``key`` = ip, ``value`` = map uri -> views. The long form is :func:`page_views`; a map
    holds one entry per distinct uri of its ip, which the reference's result asks for as one value."""
    pv = page_views(hits, ip, uri)
    return pv.groupBy(F.col(ip).alias("key")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(uri), F.col("views"))))).alias("value"))


def ip_page_view_map(hits: DataFrame, ip_value, ip: str = "ip", uri: str = "uri") -> DataFrame:
    """W3 for one ip: its row of :func:`page_view_map`, from that ip's hits alone; no row for an unknown ip. The table
    to store for all ips is :func:`page_views`, whose rows are as many however crowded an ip is."""
    return page_view_map(hits.where(F.col(ip) == F.lit(ip_value)), ip, uri)


def ip_visit_total(hits: DataFrame, ip_value=None, ip: str = "ip") -> DataFrame:
    """Total hits per ip; with ``ip_value`` one row, 0 for an unknown ip."""
    if ip_value is None:
        return hits.groupBy(ip).agg(F.count(F.lit(1)).alias("visits"))
    return hits.where(F.col(ip) == F.lit(ip_value)).agg(F.count(F.lit(1)).alias("visits")) \
        .select(F.lit(ip_value).alias(ip), "visits")


def ip_page_views(hits: DataFrame, ip_value, uri_value, ip: str = "ip", uri: str = "uri") -> DataFrame:
    """Hits of one (ip, uri); 0 when unknown."""
    return (hits.where((F.col(ip) == F.lit(ip_value)) & (F.col(uri) == F.lit(uri_value)))
            .agg(F.count(F.lit(1)).alias("views"))
            .select(F.lit(ip_value).alias(ip), F.lit(uri_value).alias(uri), "views"))


def bounce_flags(hits: DataFrame, timeout="10 minutes", ip: str = "ip", ts: str = "ts", order: str = "hit_id",
                 session_cut: list[str] | None = None, chunk="1 hour") -> DataFrame:
    """Each hit with ``bounce``: the ip has no later hit, or the next one is
    strictly more than ``timeout`` later. ``session_cut`` columns (e.g. a slice
    id) end a session at their boundary.

    Skew-safe: hits are ordered within (ip, time chunk), so one hot ip is
    spread over many tasks. With the chunk width ``W >= timeout``, a chunk's
    last hit only needs the first hit of the *next* chunk: if that chunk is
    empty, the next hit is more than ``W`` away, which is a bounce anyway. So
    each chunk's first time (a small partial aggregate) is added as a sentinel
    row to the chunk before it, and one ``lead`` over (ip, chunk) decides.
    """
    hits = ensure_ntz(hits, ts)
    keys = [ip, *(session_cut or [])]
    t = micros_of(timeout)
    width = max(micros_of(chunk), t)
    h = hits.withColumn("ts_us", epoch_us(ts))
    h = h.withColumn("_chunk", F.expr(f"(ts_us - pmod(ts_us, {width})) div {width}")).withColumn("_sentinel", F.lit(False))
    firsts = h.groupBy(*keys, "_chunk").agg(F.min("ts_us").alias("ts_us")) \
        .select(*keys, "ts_us", (F.col("_chunk") - 1).alias("_chunk"), F.lit(True).alias("_sentinel"))
    u = h.unionByName(firsts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts_us", "_sentinel", order)
    u = u.withColumn("_next", F.lead("ts_us").over(w)).where(~F.col("_sentinel"))
    return u.withColumn("bounce", F.col("_next").isNull() | (F.col("ts_us") + F.lit(t) < F.col("_next"))) \
        .drop("_chunk", "_sentinel", "_next")


def bounce_counts(hits: DataFrame, timeout="10 minutes", ip: str = "ip", uri: str = "uri", ts: str = "ts",
                  order: str = "hit_id", chunk="1 hour") -> DataFrame:
    """Visits and bounces per uri (every hit counted; ties ordered by ``order``)."""
    f = bounce_flags(hits, timeout, ip, ts, order, chunk=chunk)
    return f.groupBy(uri).agg(F.count(F.lit(1)).alias("total_visits"),
                              F.sum(F.col("bounce").cast("long")).alias("bounces"))


def bounce_increments(hits: DataFrame, slice_width="10 minutes", timeout="10 minutes", ip: str = "ip",
                      uri: str = "uri", ts: str = "ts", order: str = "hit_id", chunk="1 hour") -> DataFrame:
    """W7 increments of many slices at once: per epoch-aligned slice ``[start, start + width)``, bounce counts of
    the hits in it; a session that crosses a slice edge is cut there. Rows are keyed by ``batch``, the slice's
    start, so a rerun replaces, not doubles."""
    hits = ensure_ntz(hits, ts).withColumn("batch", bucket_start(bucket_index(ts, slice_width), slice_width))
    f = bounce_flags(hits, timeout, ip, ts, order, session_cut=["batch"], chunk=chunk)
    return f.groupBy("batch", uri).agg(F.count(F.lit(1)).alias("total_visits"),
                                       F.sum(F.col("bounce").cast("long")).alias("bounces"))


def bounce_counts_slice(hits: DataFrame, slice_start, slice_end, store: DataFrame | None = None,
                        timeout="10 minutes", ip: str = "ip", uri: str = "uri", ts: str = "ts", order: str = "hit_id",
                        chunk="1 hour") -> DataFrame:
    """Count the bounces of one slice ``[slice_start, slice_end)``, wherever it starts, and put them into a store
    keyed by ``batch = slice_start`` (see :mod:`fathom.sources.stores`). A rerun replaces the slice's rows, also
    when none are left; sessions are cut at the slice's ends and nowhere else."""
    from fathom.functions.time import ntz_literal
    from fathom.sources.stores import add_counters

    start = ntz_literal(slice_start)
    part = ensure_ntz(hits, ts).where((F.col(ts) >= start) & (F.col(ts) < ntz_literal(slice_end)))
    delta = bounce_counts(part, timeout, ip, uri, ts, order, chunk).withColumn("batch", start)
    return add_counters(store, delta, [uri], ["total_visits", "bounces"], batches=[start])


def bounce_store_totals(store: DataFrame, uri: str = "uri") -> DataFrame:
    from fathom.sources.stores import counter_totals

    return counter_totals(store, [uri], ["total_visits", "bounces"])


def high_bounce_pages(bounces: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Uris where ``bounces > ratio * total_visits``."""
    return bounces.where(F.col("bounces") > F.lit(ratio) * F.col("total_visits"))


def visitors_of_page(views: DataFrame, uri_value, ip: str = "ip", uri: str = "uri") -> DataFrame:
    """Ips with a hit of ``uri_value``, from the (ip, uri) pairs of hits or of :func:`page_views`; the filter
    reaches the scan and no ip's map is built."""
    return views.where(F.col(uri) == F.lit(uri_value)).select(F.col(ip).alias("key")).distinct()


def bounce_lookup(spark: SparkSession, bounces: DataFrame, uri_value, uri: str = "uri") -> DataFrame:
    """One uri's (visits, bounces); a missing uri gives (uri, 0, 0)."""
    probe = spark.createDataFrame([(uri_value,)], f"{uri} string")
    return probe.join(bounces, uri, "left").select(
        uri, F.coalesce("total_visits", F.lit(0)).cast("long").alias("total_visits"),
        F.coalesce("bounces", F.lit(0)).cast("long").alias("bounces"))


def bounce_report(bounces: DataFrame, uri: str = "uri") -> DataFrame:
    """All rows as ``uri, totalvisits, bounces`` ordered by uri."""
    return bounces.select(uri, F.col("total_visits").alias("totalvisits"), "bounces").orderBy(uri)
