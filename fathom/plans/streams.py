"""Registered streaming queries: the events arrive as files in parts, with late
rows; the stream runs after each part (``availableNow``, one checkpoint), results
are written under the checkpoint folder and read back. Each equals the batch
query over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.time import bucket_start
from fathom.operators import anomaly as A
from fathom.operators import text as T
from fathom.plans.registry import query
from fathom.sources import standins
from fathom.sources.stores import CounterStore
from fathom.sources.tables import table_path
from fathom.streaming import metrics as FM
from fathom.streaming import streams as ST

HOUR = "1 hour"


def _feed(spark, sf, run, base: str, last: bool, last_user: int | None = None) -> None:
    """The events arrive in two parts, in files of their own, some rows up to 30 minutes late and out of order; after
    each part the stream runs on what is new and stops. ``last`` adds one far later event, after which every
    bucket of the events is closed."""
    events = spark.read.parquet(table_path(sf, "events"))
    edge = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = edge["lo"] + (edge["hi"] - edge["lo"]) / 2
    late = F.when(F.pmod("event_id", F.lit(7)) == 0, F.col("ts") + F.expr("interval 30 minutes")).otherwise(F.col("ts"))
    second = late >= F.lit(middle)
    for part in (~second, second):
        events.where(part).write.mode("append").parquet(base)
        run(spark.readStream.schema(events.schema).parquet(base))
    if last:
        end = events.limit(1).withColumn("ts", F.lit(edge["hi"]) + F.expr("interval 3 days")).withColumn("event_type", F.lit("end"))
        end.withColumn("user_id", F.lit(last_user).cast("bigint")).write.mode("append").parquet(base)
        run(spark.readStream.schema(events.schema).parquet(base))


def _streamed(spark, sf, name, run, last=False, last_user=None):
    """Paths of a stream that has run over all parts of the feed; ``run(stream, paths)`` starts it."""
    p = ST.fresh_paths(spark, name)
    _feed(spark, sf, lambda stream: run(stream, p), p["aux"] + "-feed", last, last_user)
    return p


@query("stream_page_views", sql="""SELECT CAST(user_id AS VARCHAR) AS ip, '/' || event_type AS uri, count(*) AS n
FROM events GROUP BY ALL""")
def page_views(spark, sf):
    p = _streamed(spark, sf, "page-views", lambda s, p: ST.stream_counter_store(standins.hits_from_events(s), ["ip", "uri"], p["out"], p["ckpt"], "page_views"))
    return ST.read_counter_totals(spark, p["out"], ["ip", "uri"])


@query("stream_compacted_page_views", sql="""SELECT CAST(user_id AS VARCHAR) AS ip, '/' || event_type AS uri, count(*) AS n
FROM events GROUP BY ALL""")
def compacted_page_views(spark, sf):
    """Page views in a counter table that folds its closed micro-batches into a snapshot."""
    stores = {}

    def run(s, p):
        stores[p["out"]] = store = CounterStore(spark, p["out"], {"ip": "string", "uri": "string"})
        ST.stream_compacted_counters(standins.hits_from_events(s), store, p["ckpt"], 1, "compacted")

    return stores[_streamed(spark, sf, "compacted", run)["out"]].totals()


COUNTS = "c AS (SELECT event_type AS series_key, epoch_us(ts) // 3600000000 AS bucket, count(*) AS n FROM events GROUP BY ALL)"
ANOMALIES = f"""{COUNTS},
f AS (SELECT *, coalesce(sum(n) OVER w, 0) AS S, coalesce(sum(n * n) OVER w, 0) AS Q FROM c
      WINDOW w AS (PARTITION BY series_key ORDER BY bucket RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
a AS (SELECT series_key, bucket, n FROM f
WHERE CAST(S + n - 1 AS DOUBLE) / CAST(11 AS DOUBLE) > CAST(2 AS DOUBLE)
  AND CAST(10 * (n - 1) - S AS DOUBLE) / CAST(11 AS DOUBLE) > CAST(2 AS DOUBLE) * sqrt(CAST(10 * Q - S * S AS DOUBLE)) / CAST(10 AS DOUBLE))"""


def _append(counts, p, name):
    ST.run_available_now(counts.writeStream.outputMode("append").format("parquet").option("path", p["out"])
                         .option("checkpointLocation", p["ckpt"]), name)


@query("stream_interval_counts", sql=f"WITH {COUNTS} SELECT series_key, bucket, n FROM c")
def interval_counts(spark, sf):
    p = _streamed(spark, sf, "interval-counts", lambda s, p: _append(ST.stream_interval_counts(s, "event_type", HOUR, HOUR), p, "interval_counts"), last=True)
    return spark.read.parquet(p["out"])


@query("stream_traffic_counts", sql="SELECT epoch_us(ts) // 3600000000 AS bucket, count(*) AS value FROM events GROUP BY ALL")
def traffic_counts(spark, sf):
    p = _streamed(spark, sf, "traffic", lambda s, p: _append(ST.stream_traffic_counts(s, HOUR, HOUR), p, "traffic"), last=True)
    return spark.read.parquet(p["out"])


def _anomalies(spark, sf):
    def run(s, p):
        counts = ST.stream_interval_counts(s, "event_type", HOUR, HOUR)
        ST.stream_anomalies(counts, p["aux"], p["out"], p["ckpt"], HOUR, counters_path=p["out"] + "-counters")

    return _streamed(spark, sf, "anomalies", run, last=True)


@query("stream_anomalies", sql=f"WITH {ANOMALIES} SELECT series_key, bucket, n FROM a")
def anomalies(spark, sf):
    return ST.read_anomalies(spark, _anomalies(spark, sf)["out"]).select("series_key", "bucket", "n")


@query("stream_anomaly_counts", sql=f"WITH {ANOMALIES} SELECT bucket, count(DISTINCT series_key) AS n FROM a GROUP BY bucket")
def anomaly_counts(spark, sf):
    return ST.read_counter_totals(spark, _anomalies(spark, sf)["out"] + "-counters", ["bucket"], ["bigint"])


@query("stream_unique_srcs", sql=f"""WITH {ANOMALIES} SELECT make_timestamp(bucket * 3600000000) AS ts, count(DISTINCT series_key) AS value FROM a
  WHERE make_timestamp(bucket * 3600000000) >= TIMESTAMP '2024-01-05' AND make_timestamp(bucket * 3600000000) < TIMESTAMP '2024-01-20' GROUP BY bucket""")
def unique_srcs(spark, sf):
    return A.unique_srcs_with_anomalies(_as_facts(spark, sf), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("stream_top_anomalous_sources", sql=f"""WITH {ANOMALIES}, sp AS (SELECT series_key AS value, bucket - d AS ws FROM a, range(0, 24) t(d)),
cnt AS (SELECT ws, value, count(*) AS count FROM sp GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count DESC, value ASC) AS rank FROM cnt)
SELECT make_timestamp(ws * 3600000000) AS window_start, value, count, rank FROM rk WHERE rank <= 3""")
def top_anomalous_sources(spark, sf):
    return A.top_anomalous_sources(_as_facts(spark, sf), "24 hours", HOUR, 3).withColumn("rank", F.col("rank").cast("long"))


def _as_facts(spark, sf):
    """Streamed anomalies with ``ts`` and ``dims``, as N10 to N18 read them."""
    a = ST.read_anomalies(spark, _anomalies(spark, sf)["out"])
    return a.withColumn("ts", bucket_start("bucket", HOUR)).withColumn("dims", F.create_map(F.lit("src"), F.col("series_key")))


@query("stream_text_metrics", sql="""WITH edge AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
fed AS (SELECT CASE WHEN event_type <> 'error' THEN props END AS text,
  epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 1800000000 ELSE 0 END >= lo + (hi - lo) / 2.0 AS part FROM events, edge)
SELECT CAST(CAST(part AS INT) AS BIGINT) AS batch, count(text) AS accepted, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars,
  count(*) - count(text) AS ignored FROM fed GROUP BY part""")
def text_metrics(spark, sf):
    """What the stream itself counted of each part of the feed, while it moved the texts."""
    metrics = FM.FeedMetrics()
    _streamed(spark, sf, "texts", lambda s, p: FM.stream_text_events(standins.raw_texts(s), p["out"], p["ckpt"], metrics))
    return FM.as_table(spark, metrics)


@query("stream_text_events", sql="SELECT text, ts AS created_at FROM (SELECT CASE WHEN event_type <> 'error' THEN props END AS text, ts FROM events) WHERE text IS NOT NULL")
def text_events(spark, sf):
    p = _streamed(spark, sf, "texts", lambda s, p: FM.stream_text_events(standins.raw_texts(s), p["out"], p["ckpt"], FM.FeedMetrics()))
    return spark.read.parquet(p["out"])


@query("stream_sentiment_totals", sql="SELECT event_type AS sentiment, count(*) AS n FROM events GROUP BY ALL")
def sentiment_totals(spark, sf):
    p = _streamed(spark, sf, "sentiment-totals", lambda s, p: ST.stream_counter_store(standins.scored_from_events(s), ["sentiment"], p["out"], p["ckpt"], "sentiment_totals"))
    return ST.read_counter_totals(spark, p["out"], ["sentiment"])


@query("stream_top_sources", sql="""WITH pre AS (SELECT CAST(user_id AS VARCHAR) AS value, epoch_us(ts) // 3600000000 AS u,
   count(*) AS c FROM events GROUP BY ALL),
sp AS (SELECT value, c, u - d AS ws FROM pre, range(0, 10) t(d)),
cnt AS (SELECT ws, value, CAST(sum(c) AS BIGINT) AS count FROM sp GROUP BY ws, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count DESC, value ASC) AS rank FROM cnt)
SELECT make_timestamp(ws * 3600000000) AS window_start, value, count, rank FROM rk WHERE rank <= 10""")
def top_sources(spark, sf):
    def run(s, p):
        # the last event moves the watermark but has no source: null values are skipped after it
        ev = s.select("ts", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("src"))
        ST.stream_sliding_top(ev, "src", "10 hours", HOUR, 10, HOUR, p["out"], p["ckpt"])

    p = _streamed(spark, sf, "top-sources", run, last=True)
    return spark.read.parquet(p["out"]).select("window_start", "value", "count", "rank")


@query("stream_recent_counts", sql="""WITH ev AS (SELECT event_type AS sentiment, ts FROM events),
k AS (SELECT * FROM (VALUES ('click'), ('purchase'), ('view'), ('signup'), ('error'), ('unknown')) v(sentiment)),
x AS (SELECT sentiment, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 86400 SECOND
      AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY sentiment)
SELECT k.sentiment, CAST(coalesce(x.n, 0) AS BIGINT) AS n, coalesce(x.n, 0) / 20.0 AS rate FROM k LEFT JOIN x USING (sentiment)""")
def recent_counts(spark, sf):
    p = _streamed(spark, sf, "sentiment-series", lambda s, p: ST.stream_sentiment_series(standins.scored_from_events(s), p["out"], p["ckpt"]))
    return T.recent_counts(spark.read.parquet(p["out"]), ["click", "purchase", "view", "signup", "error", "unknown"], "2024-01-15 12:00:00", 86400)


@query("stream_recent_texts", sql="""SELECT text, max(ts) AS ts FROM (SELECT props AS text, ts, event_id FROM events WHERE event_type = 'view'
  AND ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 86400 SECOND AND ts <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts, event_id LIMIT 10) GROUP BY text""")
def recent_texts(spark, sf):
    p = _streamed(spark, sf, "sentiment-series", lambda s, p: ST.stream_sentiment_series(standins.scored_from_events(s), p["out"], p["ckpt"]))
    return T.recent_texts(spark.read.parquet(p["out"]), "view", "2024-01-15 12:00:00", 86400, 10)
