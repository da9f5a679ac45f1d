"""Registered source / store / SQL-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.time import bucket_index
from fathom.operators import recommend as M
from fathom.operators import weblog as W
from fathom.plans.registry import query
from fathom.session import scratch_path
from fathom.sources import standins, stores
from fathom.sources.tables import load, read_keyed, read_series, read_slice, register_views, scan_prefix, table_path, write_keyed

SLICE = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")


@query("src_read_slice", sql=f"""SELECT * FROM events WHERE ts >= TIMESTAMP '{SLICE[0]}' AND ts < TIMESTAMP '{SLICE[1]}'""")
def slice_(spark, sf):
    return read_slice(spark, table_path(sf, "events"), "ts", *SLICE)


@query("src_read_series", sql=f"""SELECT event_id, ts, value FROM events WHERE event_type = 'click'
  AND ts >= TIMESTAMP '{SLICE[0]}' AND ts <= TIMESTAMP '{SLICE[1]}'""")
def series_(spark, sf):
    return read_series(load(spark, sf, "events"), "event_type", "click", "ts", *SLICE).select("event_id", "ts", "value")


@query("src_add_counters", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def add_counters(spark, sf):
    ev = load(spark, sf, "events").withColumn("batch", bucket_index("ts", "1 day"))
    deltas = ev.groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("n"))
    store = stores.add_counters(None, deltas, ["event_type"], ["n"])
    # replay of one day's batch: replaces its rows instead of adding them again
    replay = deltas.where(F.col("batch") == F.lit(19730))
    store = stores.add_counters(store, replay, ["event_type"], ["n"])
    return stores.counter_totals(store, ["event_type"], ["n"])


@query("src_counter_snapshots", sql="SELECT event_type, user_id % 100 AS user_group, count(*) AS n FROM events GROUP BY ALL")
def counter_snapshots(spark, sf):
    """A stored counter table fed once per week, folded twice, with replays before and after a fold and a fold that
    stopped before its manifest row."""
    ev = load(spark, sf, "events").withColumn("user_group", F.col("user_id") % 100).withColumn("batch", bucket_index("ts", "7 days"))
    store = stores.CounterStore(spark, scratch_path(spark, "counters"), {"event_type": "string", "user_group": "bigint"})
    deltas = ev.groupBy("batch", "event_type", "user_group").agg(F.count(F.lit(1)).alias("n"))
    weeks = [r[0] for r in deltas.select("batch").distinct().orderBy("batch").collect()]
    for i, week in enumerate(weeks):
        store.add(week, deltas.where(F.col("batch") == F.lit(week)))
        if i == 1:
            store.compact(weeks[0])
            store.add(weeks[0], deltas.where(F.col("batch") == F.lit(weeks[0])))  # replay of a folded batch
        if i == 2:
            store.fold(weeks[1])
            store.add(week, deltas.where(F.col("batch") == F.lit(week)))  # replay of an open one
    store.compact(weeks[-2])
    return store.totals()


@query("src_scan_keyed", sql="""WITH r AS (SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
   CAST(least(5, greatest(1, ceil(l_quantity / 10))) AS INT) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, item_id, rating FROM r WHERE user_id = (SELECT max(user_id) FROM r)""")
def scan_keyed(spark, sf):
    """One user's ratings from a table bucketed and sorted by user: one bucket is opened."""
    ratings = M.parse_ratings(standins.rating_lines(load(spark, sf, "orders"), load(spark, sf, "lineitem")))
    table = write_keyed(ratings, ["user_id", "item_id"], scratch_path(spark, "keyed"), 16)
    return read_keyed(spark, table, user_id=spark.table(table).agg(F.max("user_id")).first()[0])


@query("src_scan_prefix", sql="""WITH r AS (SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
   CAST(least(5, greatest(1, ceil(l_quantity / 10))) AS INT) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, item_id, rating FROM r WHERE user_id = 565""")
def scan_prefix_(spark, sf):
    lines = standins.rating_lines(load(spark, sf, "orders"), load(spark, sf, "lineitem"))
    return scan_prefix(M.parse_ratings(lines), user_id=565)


@query("src_sql_views", sql="""WITH h AS (SELECT event_id AS hit_id, CAST(user_id AS VARCHAR) AS ip, '/' || event_type AS uri,
   epoch_us(ts) AS us FROM events),
f AS (SELECT uri, (lead(us) OVER (PARTITION BY ip ORDER BY us, hit_id) IS NULL
       OR us + 43200000000 < lead(us) OVER (PARTITION BY ip ORDER BY us, hit_id)) AS b FROM h),
bounces AS (SELECT uri, count(*) AS totalvisits, sum(CAST(b AS INT)) AS bounces FROM f GROUP BY uri)
SELECT uri FROM bounces WHERE bounces > 0.3 * totalvisits""")
def sql_views(spark, sf):
    hits = standins.hits_from_events(load(spark, sf, "events"))
    register_views({"bounces": W.bounce_report(W.bounce_counts(hits, "12 hours")),
                    "pageviews": W.page_view_map(hits)})
    return spark.sql("SELECT uri FROM bounces WHERE bounces > 0.3 * totalvisits")
