"""Registered network-analytics queries.

Packet facts come from ``events``: one body per event with dims
``src = user_id, app = event_type, rs = value`` and the fields of ``props``.
Flagship pipeline: parse -> categorise ``rs`` -> fan-out (src required,
subsets of size <= 2) -> 1-day counts per series -> anomalies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.maps import render_map
from fathom.functions.time import bucket_index, bucket_start
from fathom.operators import anomaly as A
from fathom.operators import facts as FA
from fathom.operators import series as S
from fathom.plans.registry import query
from fathom.session import scratch_path
from fathom.sources import standins
from fathom.sources.stores import write_dated
from fathom.sources.tables import load

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


# --- Spark side -------------------------------------------------------------

def _facts(spark, sf, dims=None):
    return FA.parse_facts(standins.packet_bodies(load(spark, sf, "events"), dims))


def _categorized(spark, sf, dims=None):
    return FA.categorize_numbers(_facts(spark, sf, dims), fields=("rl", "rs"))


def _fanned(spark, sf, dims=None):
    return FA.fanout_dimensions(_categorized(spark, sf, dims), required=("src",), max_size=2)


def _counts(spark, sf, dims=None, interval="1 day"):
    """Stored bucket counts, by date."""
    counts = FA.fanned_counts(_categorized(spark, sf, dims), interval, required=("src",), max_size=2)
    return write_dated(counts.withColumn("ts", bucket_start("bucket", interval)), scratch_path(spark, "counts"))


def _detected(spark, sf, dims=None, interval="1 day"):
    counts = FA.entry_counts(_categorized(spark, sf, dims), interval, required=("src",), max_size=2)
    return A.detect_anomalies(FA.keyed_counts(A.series_that_could_flag(counts, "entries")), interval)


def _anomalies(spark, sf, dims=None, interval="1 day"):
    """Stored anomalies, by date: what the queries by time read."""
    return write_dated(_detected(spark, sf, dims, interval), scratch_path(spark, "anomalies"))


HEAVY = standins.HEAVY_PACKET_DIMS


def _flat(df, dims="dims", names=("src", "app", "k", "rs")):
    d = F.col(dims)
    return df.select("ts", *[d.getItem(n).alias(n) for n in names])


# --- oracle side ------------------------------------------------------------

class Spec:
    """The oracle's restatement of one packet stand-in: string dims taken from
    events columns, ``rs`` numeric, ``k`` from props, counted per bucket."""

    def __init__(self, cols: dict, bucket_us: int):
        self.cols = cols  # dim -> SQL over events (besides rs and k)
        self.bucket_us = bucket_us
        self.all = sorted([*cols, "rs", "k"])
        self.opt = [c for c in self.all if c != "src"]


DEFAULT = Spec({"src": "CAST(user_id AS VARCHAR)", "app": "event_type"}, DAY_US)
HEAVY_SPEC = Spec({"src": "event_type", "dst": "CAST(user_id AS VARCHAR)"}, HOUR_US)


def facts_sql(sp: Spec) -> str:
    cols = ", ".join(f"{e} AS {d}" for d, e in sp.cols.items())
    return f"""facts AS (SELECT ts, {cols}, value AS rs_num, CAST(value AS VARCHAR) AS rs_raw,
                  json_extract_string(props, '$.k') AS k FROM events)"""


BOUNDS = """rsn AS (SELECT count(rs_num) AS n FROM facts),
ranked AS (SELECT rs_num, row_number() OVER (ORDER BY rs_num) AS rn FROM facts WHERE rs_num IS NOT NULL),
par AS (SELECT n, CAST(floor(n / 3) AS BIGINT) AS o1, CAST(floor(2 * n / 3) AS BIGINT) AS o2 FROM rsn),
bounds AS (SELECT (max(CASE WHEN rn = o1 THEN rs_num END) + max(CASE WHEN rn = o1 + 1 THEN rs_num END)) / 2 AS b0,
                  (max(CASE WHEN rn = o2 THEN rs_num END) + max(CASE WHEN rn = o2 + 1 THEN rs_num END)) / 2 AS b1,
                  any_value(n) AS n
           FROM ranked, par)"""


def cat_sql(sp: Spec) -> str:
    cols = ", ".join([*sp.cols, "k"])
    return f"""cat AS (SELECT ts, {cols},
  CASE WHEN rs_num IS NULL THEN NULL
       WHEN rs_num < (SELECT b0 FROM bounds) THEN 'low'
       WHEN rs_num < (SELECT b1 FROM bounds) THEN 'medium' ELSE 'high' END AS rs FROM facts)"""


def fan_sql(sp: Spec) -> str:
    from itertools import combinations

    parts = []
    for size in range(3):
        for s in combinations(sp.opt, size):
            cols = ", ".join(c if c in s else f"CAST(NULL AS VARCHAR) AS {c}" for c in sp.opt)
            cond = " AND ".join(f"{c} IS NOT NULL" for c in s) or "TRUE"
            parts.append(f"SELECT ts, src, {cols} FROM cat WHERE src IS NOT NULL AND {cond}")
    return "fan AS (" + "\nUNION ALL ".join(parts) + ")"


def _key_sql(cols) -> str:
    return " || ".join(
        f"CASE WHEN {c} IS NULL THEN '' ELSE '{len(c)}{c}' || CAST(length({c}) AS VARCHAR) || {c} END" for c in cols)


def _render_sql(cols) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}=' || {c} END" for c in cols) + ")"


def counts_sql(sp: Spec) -> str:
    carry = ", ".join(f"any_value({c}) AS {c}" for c in sp.all)
    return f"""keyed AS (SELECT *, {_key_sql(sp.all)} AS series_key, epoch_us(ts) // {sp.bucket_us} AS bucket FROM fan),
counts AS (SELECT series_key, bucket, count(*) AS n, {carry} FROM keyed GROUP BY series_key, bucket)"""


def anom_sql(sp: Spec) -> str:
    return f"""flags AS (SELECT *, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS S,
                         CAST(coalesce(sum(n * n) OVER w, 0) AS BIGINT) AS Q FROM counts
   WINDOW w AS (PARTITION BY series_key ORDER BY bucket RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
anomalies AS (SELECT *, make_timestamp(bucket * {sp.bucket_us}) AS ts FROM flags
   WHERE CAST(S + n - 1 AS DOUBLE) / CAST(11 AS DOUBLE) > CAST(2 AS DOUBLE)
     AND CAST(10 * (n - 1) - S AS DOUBLE) / CAST(11 AS DOUBLE)
         > CAST(2 AS DOUBLE) * sqrt(CAST(10 * Q - S * S AS DOUBLE)) / CAST(10 AS DOUBLE))"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def pipe(sp: Spec):
    return (facts_sql(sp), BOUNDS, cat_sql(sp), fan_sql(sp), counts_sql(sp), anom_sql(sp))


FACTS = facts_sql(DEFAULT)
CAT = cat_sql(DEFAULT)
PIPE = pipe(DEFAULT)
HPIPE = pipe(HEAVY_SPEC)
DCOLS = DEFAULT.all
HCOLS = HEAVY_SPEC.all


# --- queries ----------------------------------------------------------------

@query("net_parse_facts", sql=W(FACTS) + "SELECT ts, src, app, rs_num AS rs, k, CAST(4 AS INT) AS n_dims FROM facts")
def parse_facts(spark, sf):
    d = F.col("dims")
    return _facts(spark, sf).select("ts", d.getItem("src").alias("src"), d.getItem("app").alias("app"),
                                    F.expr("try_cast(dims['rs'] AS DOUBLE)").alias("rs"), d.getItem("k").alias("k"),
                                    F.size("dims").alias("n_dims"))


@query("net_fact_rejects", sql="SELECT ts, 'junk ' || event_id AS line FROM events WHERE event_type = 'error'")
def fact_rejects(spark, sf):
    return FA.fact_rejects(standins.packet_bodies(load(spark, sf, "events"), damaged=True))


@query("net_series_key", sql=W(FACTS) + f"""SELECT {_key_sql(('app', 'k', 'rs_raw', 'src')).replace("'6rs_raw'", "'2rs'")}
  AS series_key, count(*) AS n FROM facts GROUP BY ALL""")
def series_key(spark, sf):
    return FA.with_series_key(_facts(spark, sf)).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))


@query("net_categorize", sql=W(FACTS, BOUNDS, CAT) + "SELECT ts, src, app, k, rs FROM cat")
def categorize(spark, sf):
    return _flat(_categorized(spark, sf))


DECAY = f"""h AS (SELECT epoch_us(ts) // {DAY_US} AS tb, CAST(floor(rs_num / 5.0) AS BIGINT) AS bin FROM facts
             WHERE rs_num IS NOT NULL),
hc AS (SELECT tb, bin, count(*) AS c FROM h GROUP BY tb, bin),
sp AS (SELECT tb + d AS tb, bin, c * pow(2.0, -d / 1.0) AS w FROM hc, range(1, 11) t(d)),
grid AS (SELECT tb, bin, sum(w) AS w FROM sp GROUP BY tb, bin),
cw AS (SELECT tb, bin, sum(w) OVER (PARTITION BY tb ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              sum(w) OVER (PARTITION BY tb) AS total FROM grid),
bd AS (SELECT tb, (min(CASE WHEN cum * 3 >= total * 1 THEN bin END) + 1) * 5.0 AS b0,
                  (min(CASE WHEN cum * 3 >= total * 2 THEN bin END) + 1) * 5.0 AS b1 FROM cw GROUP BY tb),
dc AS (SELECT f.ts, f.src, f.app, f.k, epoch_us(f.ts) // {DAY_US} AS tb,
              CASE WHEN bd.b0 IS NULL OR f.rs_num IS NULL THEN NULL WHEN f.rs_num < bd.b0 THEN 'low'
                   WHEN f.rs_num < bd.b1 THEN 'medium' ELSE 'high' END AS rs
       FROM facts f LEFT JOIN bd ON bd.tb = epoch_us(f.ts) // {DAY_US})"""


def _decayed(spark, sf):
    return FA.decayed_categorize(_facts(spark, sf), "rs", bucket="1 day", half_life_buckets=1.0, lookback=10,
                                 bin_width=5.0)


@query("net_decayed_categorize", sql=W(FACTS, DECAY) + "SELECT ts, src, app, k, rs FROM dc")
def decayed_categorize(spark, sf):
    return _flat(_decayed(spark, sf))


@query("net_bucket_skew", sql=W(FACTS, DECAY) + """, c AS (SELECT tb,
    CAST(sum(CASE WHEN rs = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS n_low,
    CAST(sum(CASE WHEN rs = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium,
    CAST(sum(CASE WHEN rs = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM dc WHERE rs IS NOT NULL GROUP BY tb),
e AS (SELECT *, CAST(n_low + n_medium + n_high AS DOUBLE) / 3.0 AS e FROM c)
SELECT tb, n_low, n_medium, n_high,
  round(0.0 + (n_low - e) * (n_low - e) / e + (n_medium - e) * (n_medium - e) / e + (n_high - e) * (n_high - e) / e, 6) AS chi2,
  (0.0 + (n_low - e) * (n_low - e) / e + (n_medium - e) * (n_medium - e) / e + (n_high - e) * (n_high - e) / e) > 5.991 AS is_skewed
FROM e""")
def bucket_skew(spark, sf):
    d = _decayed(spark, sf).withColumn("tb", bucket_index("ts", "1 day"))
    out = FA.bucket_skew(d, "rs", by=["tb"])
    return out.withColumn("chi2", F.round("chi2", 6))


@query("net_fanout", sql=W(FACTS, BOUNDS, CAT, fan_sql(DEFAULT)) + f"SELECT {_key_sql(DCOLS)} AS series_key, count(*) AS n FROM fan GROUP BY ALL")
def fanout(spark, sf):
    return FA.with_series_key(_fanned(spark, sf)).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))


@query("net_interval_counts", sql=W(*PIPE[:5]) + "SELECT series_key, bucket, n FROM counts")
def interval_counts(spark, sf):
    return FA.fanned_counts(_categorized(spark, sf), "1 day").select("series_key", "bucket", "n")


@query("net_anomalies", sql=W(*PIPE) + "SELECT series_key, bucket, n FROM anomalies")
def anomalies(spark, sf):
    return _detected(spark, sf).select("series_key", "bucket", "n")


@query("net_anomaly_facts", sql=W(*PIPE) + f"SELECT series_key, ts, n, {_render_sql(DCOLS)} AS dims FROM anomalies")
def anomaly_facts(spark, sf):
    return A.render(_detected(spark, sf)).select("series_key", "ts", "n", "dims")


RANGE = ("2024-01-08 00:00:00", "2024-01-20 00:00:00")


@query("net_anomalies_in_range", sql=W(*PIPE) + f"""SELECT series_key, ts, {_render_sql(DCOLS)} AS dims FROM anomalies
  WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts <= TIMESTAMP '{RANGE[1]}'""")
def anomalies_in_range(spark, sf):
    a = A.anomalies_in_range(_anomalies(spark, sf), *RANGE)
    return A.render(a).select("series_key", "ts", "dims")


@query("net_heavy_anomalies", sql=W(*HPIPE) + f"SELECT series_key, bucket, n, {_render_sql(HCOLS)} AS dims FROM anomalies")
def heavy_detected(spark, sf):
    a = _detected(spark, sf, HEAVY, "1 hour")
    return A.render(a).select("series_key", "bucket", "n", "dims")


@query("net_anomalies_in_range_src", sql=W(*HPIPE) + f"""SELECT series_key, ts, {_render_sql(HCOLS)} AS dims FROM anomalies
  WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts <= TIMESTAMP '{RANGE[1]}' AND src = 'click'""")
def anomalies_in_range_src(spark, sf):
    a = A.anomalies_in_range(_anomalies(spark, sf, HEAVY, "1 hour"), *RANGE, src="click")
    return A.render(a).select("series_key", "ts", "dims")


def _grouped_sql(g: str, cols) -> str:
    def part(c):
        if c == g:
            return f"'{c}=' || {c}"
        return (f"CASE WHEN min({c}) IS NULL THEN NULL WHEN min({c}) = max({c}) THEN '{c}=' || min({c}) "
                f"ELSE '{c}=[grouped]' END")
    dims = "concat_ws(';', " + ", ".join(part(c) for c in cols) + ")"
    return f"SELECT ts, {g} AS \"group\", min(series_key) AS series_key, {dims} AS dims FROM anomalies " \
           f"WHERE {g} IS NOT NULL GROUP BY ts, {g}"


@query("net_group_anomalies", sql=W(*HPIPE) + _grouped_sql("src", HCOLS))
def group_anomalies(spark, sf):
    g = A.group_anomalies(_anomalies(spark, sf, HEAVY, "1 hour"), "src")
    return g.select("ts", "group", "series_key", render_map("dims").alias("dims"))


GRID = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("net_anomaly_counts", sql=W(*PIPE) + f""", obs AS (SELECT bucket, count(DISTINCT series_key) AS value FROM anomalies
   GROUP BY bucket), b0 AS (SELECT epoch_us(TIMESTAMP '{GRID[0]}') // {DAY_US} AS b0),
grid AS (SELECT b0 + i AS bucket FROM b0, range(0, 30) t(i)),
o2 AS (SELECT * FROM obs WHERE bucket >= (SELECT b0 FROM b0) AND make_timestamp(bucket * {DAY_US}) <= TIMESTAMP '{GRID[1]}')
SELECT make_timestamp(coalesce(grid.bucket, o2.bucket) * {DAY_US}) AS ts, CAST(coalesce(o2.value, 0) AS BIGINT) AS value
FROM grid FULL OUTER JOIN o2 ON grid.bucket = o2.bucket""")
def anomaly_counts(spark, sf):
    return A.anomaly_counts(spark, _anomalies(spark, sf), *GRID, "1 day")


@query("net_anomaly_counts_one_src", sql=W(*PIPE) + f""", obs AS (SELECT bucket, count(DISTINCT series_key) AS value FROM anomalies
   WHERE src = '60' GROUP BY bucket), b0 AS (SELECT epoch_us(TIMESTAMP '{GRID[0]}') // {DAY_US} AS b0),
grid AS (SELECT b0 + i AS bucket FROM b0, range(0, 30) t(i)),
o2 AS (SELECT * FROM obs WHERE bucket >= (SELECT b0 FROM b0) AND make_timestamp(bucket * {DAY_US}) <= TIMESTAMP '{GRID[1]}')
SELECT make_timestamp(coalesce(grid.bucket, o2.bucket) * {DAY_US}) AS ts, CAST(coalesce(o2.value, 0) AS BIGINT) AS value
FROM grid FULL OUTER JOIN o2 ON grid.bucket = o2.bucket""")
def anomaly_counts_one_src(spark, sf):
    return A.anomaly_counts_by_src(spark, _anomalies(spark, sf), *GRID, "1 day", src="60")


@query("net_anomaly_counts_by_src", sql=W(*PIPE) + f"""SELECT src, ts, count(DISTINCT series_key) AS value FROM anomalies
  WHERE ts >= TIMESTAMP '{GRID[0]}' AND ts <= TIMESTAMP '{GRID[1]}' GROUP BY src, ts""")
def anomaly_counts_by_src(spark, sf):
    return A.anomaly_counts_by_src(spark, _anomalies(spark, sf), *GRID, "1 day")


@query("net_unique_srcs", sql=W(*PIPE) + f"""SELECT ts, count(DISTINCT src) AS value FROM anomalies
  WHERE ts >= TIMESTAMP '{GRID[0]}' AND ts < TIMESTAMP '{GRID[1]}' GROUP BY ts""")
def unique_srcs(spark, sf):
    return A.unique_srcs_with_anomalies(_anomalies(spark, sf), *GRID)


TRAFFIC = ("2024-01-03 00:30:00", "2024-01-20 00:00:00")


@query("net_traffic_counts", sql=W(FACTS) + f"""SELECT make_timestamp(b * {HOUR_US}) AS ts, count(*) AS value FROM
  (SELECT epoch_us(ts) // {HOUR_US} AS b FROM facts) WHERE b >= epoch_us(TIMESTAMP '{TRAFFIC[0]}') // {HOUR_US}
  AND make_timestamp(b * {HOUR_US}) < TIMESTAMP '{TRAFFIC[1]}' GROUP BY b""")
def traffic_counts(spark, sf):
    return S.traffic_counts(_facts(spark, sf), "1 hour", *TRAFFIC)


@query("net_series_counts", sql=W(*PIPE[:5]) + f"""SELECT make_timestamp(bucket * {DAY_US}) AS ts, n AS value FROM counts
  WHERE series_key = '3src217' AND bucket >= epoch_us(TIMESTAMP '{TRAFFIC[0]}') // {DAY_US}
  AND make_timestamp(bucket * {DAY_US}) <= TIMESTAMP '{TRAFFIC[1]}'""")
def series_counts(spark, sf):
    return S.series_counts(_counts(spark, sf), "3src217", "1 day", *TRAFFIC)


def _top_sql(src_cte: str, unit_us: int, m: int, limit: int) -> str:
    return f"""pre AS (SELECT src AS value, epoch_us(ts) // {unit_us} AS u, count(*) AS c FROM {src_cte}
   WHERE src IS NOT NULL GROUP BY ALL),
sp AS (SELECT value, c, u - d AS ws FROM pre, range(0, {m}) t(d)),
cnt AS (SELECT ws, value, CAST(sum(c) AS BIGINT) AS count FROM sp GROUP BY ws, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count DESC, value ASC) AS rank FROM cnt)
SELECT make_timestamp(ws * {unit_us}) AS window_start, value, count, rank FROM rk WHERE rank <= {limit}"""


@query("net_top_sources", sql=W(FACTS, _top_sql("facts", HOUR_US, 10, 10)))
def top_sources(spark, sf):
    f = _facts(spark, sf).select("ts", F.col("dims").getItem("src").alias("src"))
    return S.sliding_top(f, "src", "ts", "10 hours", "1 hour", 10).withColumn("rank", F.col("rank").cast("long"))


TOP_AT = "2024-01-10 04:20:00"


@query("net_top_sources_at", sql=W(FACTS) + f"""SELECT date_trunc('hour', TIMESTAMP '{TOP_AT}') AS window_start, * FROM (
  SELECT src AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, src ASC) AS rank FROM facts
  WHERE src IS NOT NULL AND ts >= date_trunc('hour', TIMESTAMP '{TOP_AT}')
    AND ts < date_trunc('hour', TIMESTAMP '{TOP_AT}') + INTERVAL 10 HOUR GROUP BY src) WHERE rank <= 10""")
def top_sources_at(spark, sf):
    f = _facts(spark, sf).select("ts", F.col("dims").getItem("src").alias("src"))
    return S.sliding_top(f, "src", "ts", "10 hours", "1 hour", 10, start=TOP_AT).withColumn("rank", F.col("rank").cast("long"))


@query("net_top_anomalous_sources", sql=W(*PIPE, _top_sql("anomalies", DAY_US, 10, 10)))
def top_anomalous_sources(spark, sf):
    return A.top_anomalous_sources(_anomalies(spark, sf), "10 days", "1 day", 10).withColumn("rank", F.col("rank").cast("long"))


@query("net_explain_anomalies", sql=W(*PIPE) + """SELECT a.series_key, a.bucket AS anomaly_bucket, c.bucket, c.n
  FROM anomalies a JOIN counts c ON a.series_key = c.series_key AND c.bucket BETWEEN a.bucket - 10 AND a.bucket + 10""")
def explain_anomalies(spark, sf):
    counts = _counts(spark, sf)  # stored once; detection and drill-down read the table
    return A.explain_anomalies(A.detect_anomalies(counts, "1 day"), counts, span=10)


@query("net_explain_range", sql=W(*PIPE) + f"""SELECT a.series_key, a.bucket AS anomaly_bucket, c.bucket, c.n
  FROM anomalies a JOIN counts c ON a.series_key = c.series_key AND c.bucket BETWEEN a.bucket - 10 AND a.bucket + 10
  WHERE a.ts >= TIMESTAMP '{RANGE[0]}' AND a.ts <= TIMESTAMP '{RANGE[1]}'""")
def explain_range(spark, sf):
    """The anomalies of a range of time, from the tables stored by date: dates outside it are not opened."""
    counts = _counts(spark, sf)
    found = write_dated(A.detect_anomalies(counts, "1 day"), scratch_path(spark, "anomalies"))
    return A.explain_anomalies(found, counts, 10, *RANGE, interval="1 day")
