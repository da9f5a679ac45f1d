"""Registered web-log queries: hits are events (ip = user, uri = '/' + type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import weblog as W
from fathom.plans.registry import query
from fathom.sources import standins
from fathom.sources.tables import load

HITS_SQL = """hits AS (SELECT event_id AS hit_id, CAST(user_id AS VARCHAR) AS ip, '/' || event_type AS uri, ts,
                      epoch_us(ts) AS ts_us FROM events)"""


def _hits(spark, sf):
    return standins.hits_from_events(load(spark, sf, "events"))


def _flags_sql(timeout_us: int, cut: str = "") -> str:
    part = "ip" + (f", {cut}" if cut else "")
    return f"""flags AS (SELECT *, (nxt IS NULL OR ts_us + {timeout_us} < nxt) AS bounce FROM (
      SELECT *, lead(ts_us) OVER (PARTITION BY {part} ORDER BY ts_us, hit_id) AS nxt FROM hits2))"""


def _bounce_sql(timeout_us: int) -> str:
    return f"""WITH {HITS_SQL}, hits2 AS (SELECT * FROM hits), {_flags_sql(timeout_us)}
    SELECT uri, count(*) AS total_visits, CAST(sum(CAST(bounce AS INT)) AS BIGINT) AS bounces FROM flags GROUP BY uri"""


@query("web_parse_access_log", sql="""
SELECT event_id AS line_id, CAST(user_id AS VARCHAR) AS ip, '/' || event_type AS uri,
       date_trunc('second', ts) AS ts, 'GET' AS method,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       CAST(round(value * 100) AS BIGINT) AS bytes, '-' AS referrer, 'fathom-test/1.0' AS agent
FROM events""")
def parse_access_log(spark, sf):
    lines = standins.access_log_lines(load(spark, sf, "events"))
    return W.parse_access_log(lines, keep=("line_id",))


@query("web_access_log_rejects", sql="""SELECT event_id AS line_id, CASE event_type WHEN 'error' THEN 'bad_request'
  WHEN 'signup' THEN 'bad_date' ELSE 'no_match' END AS reason FROM events WHERE event_type IN ('error', 'signup', 'purchase')""")
def access_log_rejects(spark, sf):
    lines = standins.access_log_lines(load(spark, sf, "events"), damaged=True)
    return W.access_log_rejects(lines, keep=("line_id",)).select("line_id", "reason")


@query("web_page_views", sql=f"WITH {HITS_SQL} SELECT ip, uri, count(*) AS views FROM hits GROUP BY ip, uri")
def page_views(spark, sf):
    return W.page_views(_hits(spark, sf))


@query("web_page_view_map", sql=f"""WITH {HITS_SQL}, pv AS (SELECT ip, uri, count(*) AS n FROM hits GROUP BY ip, uri)
SELECT ip AS key, string_agg(uri || '=' || CAST(n AS VARCHAR), ',' ORDER BY uri) AS value FROM pv GROUP BY ip""")
def page_view_map(spark, sf):
    m = W.page_view_map(_hits(spark, sf))
    rendered = F.array_join(F.transform(F.sort_array(F.map_entries("value")),
                                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("key", rendered.alias("value"))


@query("web_ip_page_view_map", sql=f"""WITH {HITS_SQL}, pv AS (SELECT ip, uri, count(*) AS n FROM hits WHERE ip = (SELECT min(ip) FROM hits) GROUP BY ip, uri)
SELECT ip AS key, string_agg(uri || '=' || CAST(n AS VARCHAR), ',' ORDER BY uri) AS value FROM pv GROUP BY ip""")
def ip_page_view_map(spark, sf):
    hits = _hits(spark, sf)
    m = W.ip_page_view_map(hits, hits.agg(F.min("ip")).first()[0])
    rendered = F.array_join(F.transform(F.sort_array(F.map_entries("value")),
                                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("key", rendered.alias("value"))


@query("web_ip_visit_total", sql=f"WITH {HITS_SQL} SELECT ip, count(*) AS visits FROM hits GROUP BY ip")
def ip_visit_total(spark, sf):
    return W.ip_visit_total(_hits(spark, sf))


@query("web_ip_visit_total_point", sql=f"""WITH {HITS_SQL}
SELECT '8' AS ip, count(*) AS visits FROM hits WHERE ip = '8'
UNION ALL SELECT 'no-such-ip' AS ip, count(*) AS visits FROM hits WHERE ip = 'no-such-ip'""")
def ip_visit_total_point(spark, sf):
    h = _hits(spark, sf)
    return W.ip_visit_total(h, "8").unionByName(W.ip_visit_total(h, "no-such-ip"))


@query("web_ip_page_views", sql=f"""WITH {HITS_SQL}
SELECT '8' AS ip, '/error' AS uri, count(*) AS views FROM hits WHERE ip = '8' AND uri = '/error'
UNION ALL SELECT '8' AS ip, '/nowhere' AS uri, count(*) AS views FROM hits WHERE ip = '8' AND uri = '/nowhere'""")
def ip_page_views(spark, sf):
    h = _hits(spark, sf)
    return W.ip_page_views(h, "8", "/error").unionByName(W.ip_page_views(h, "8", "/nowhere"))


@query("web_bounce_counts", sql=_bounce_sql(600_000_000))
def bounce_counts(spark, sf):
    return W.bounce_counts(_hits(spark, sf), "10 minutes")


@query("web_bounce_counts_12h", sql=_bounce_sql(12 * 3600_000_000))
def bounce_counts_12h(spark, sf):
    return W.bounce_counts(_hits(spark, sf), "12 hours")


@query("web_bounce_slices", sql=f"""WITH {HITS_SQL},
hits2 AS (SELECT *, ts_us // 86400000000 AS batch FROM hits), {_flags_sql(12 * 3600_000_000, 'batch')}
SELECT uri, CAST(count(*) AS BIGINT) AS total_visits, CAST(sum(CAST(bounce AS INT)) AS BIGINT) AS bounces
FROM flags GROUP BY uri""")
def bounce_slices(spark, sf):
    inc = W.bounce_increments(_hits(spark, sf), slice_width="1 day", timeout="12 hours")
    return W.bounce_store_totals(inc)


SLICES = (("2024-01-03 00:05:00", "2024-01-05 07:30:00"), ("2024-01-05 07:30:00", "2024-01-09 12:00:01"),
          ("2024-01-10 00:00:00", "2024-01-12 00:00:00"))


def _slice_sql(start: str, end: str) -> str:
    part = f"hits2 AS (SELECT * FROM hits WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}')"
    return f"""(WITH {part}, {_flags_sql(12 * 3600_000_000)} SELECT TIMESTAMP '{start}' AS batch, uri, count(*) AS total_visits,
      CAST(sum(CAST(bounce AS INT)) AS BIGINT) AS bounces FROM flags GROUP BY uri)"""


@query("web_bounce_slice_runs", sql=f"WITH {HITS_SQL} " + " UNION ALL ".join(_slice_sql(*x) for x in SLICES[:2]))
def bounce_slice_runs(spark, sf):
    """Unaligned slices in a store; then the first runs again unchanged, and the third again without any hit left."""
    hits, store = _hits(spark, sf), None
    for start, end in SLICES:
        store = W.bounce_counts_slice(hits, start, end, store, "12 hours")
    store = W.bounce_counts_slice(hits, *SLICES[0], store, "12 hours")
    return W.bounce_counts_slice(hits.where("false"), *SLICES[2], store, "12 hours")


@query("web_high_bounce_pages", sql=f"""WITH b AS ({_bounce_sql(12 * 3600_000_000)})
SELECT * FROM b WHERE bounces > 0.1 * total_visits""")
def high_bounce_pages(spark, sf):
    return W.high_bounce_pages(W.bounce_counts(_hits(spark, sf), "12 hours"), 0.1)


@query("web_visitors_of_page", sql=f"WITH {HITS_SQL} SELECT DISTINCT ip AS key FROM hits WHERE uri = '/purchase'")
def visitors_of_page(spark, sf):
    return W.visitors_of_page(_hits(spark, sf), "/purchase")


@query("web_bounce_lookup", sql=f"""WITH b AS ({_bounce_sql(600_000_000)})
SELECT uri, total_visits, bounces FROM b WHERE uri = '/view'
UNION ALL SELECT '/nowhere' AS uri, CAST(0 AS BIGINT) AS total_visits, CAST(0 AS BIGINT) AS bounces""")
def bounce_lookup(spark, sf):
    b = W.bounce_counts(_hits(spark, sf), "10 minutes")
    return W.bounce_lookup(spark, b, "/view").unionByName(W.bounce_lookup(spark, b, "/nowhere"))


@query("web_bounce_report", sql=f"""WITH b AS ({_bounce_sql(600_000_000)})
SELECT uri, total_visits AS totalvisits, bounces FROM b ORDER BY uri""")
def bounce_report(spark, sf):
    return W.bounce_report(W.bounce_counts(_hits(spark, sf), "10 minutes"))
