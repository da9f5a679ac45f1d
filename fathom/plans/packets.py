"""Registered streaming queries from raw packet lines (see :mod:`fathom.plans.streams` for the feed: two parts, late
rows, one checkpoint). Each equals its SQL over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.time import bucket_index, bucket_start
from fathom.operators import facts as FA
from fathom.plans import net
from fathom.plans.registry import query
from fathom.plans.streams import ANOMALIES, HOUR, _anomalies, _streamed
from fathom.sources import standins
from fathom.sources.tables import load
from fathom.streaming import packets as PK
from fathom.streaming import streams as ST

DAY = "1 day"


def _packet_anomalies(spark, sf):
    """Bounds over all facts are stored first; the stream starts with the newest ones after every part of the feed."""
    facts = FA.parse_facts(standins.packet_bodies(load(spark, sf, "events")))
    found = FA.tertile_bounds_all(facts, ("rl", "rs"))
    folder = ST.fresh_paths(spark, "bounds")["out"]
    PK.write_bounds(spark, folder, {f: [] for f in found}, 0)
    PK.write_bounds(spark, folder, {f: b for f, (_, b) in found.items()}, 1)

    def run(s, p):
        counts = PK.packet_counts(standins.packet_bodies(s), PK.read_bounds(spark, folder), DAY, HOUR)
        ST.stream_anomalies(counts, p["aux"], p["out"], p["ckpt"], DAY, carry=("src",), name="packets")

    return _streamed(spark, sf, "packets", run, last=True, last_user=-1)


@query("stream_packet_counts", sql=net.W(*net.PIPE[:5]) + "SELECT series_key, bucket, n FROM counts")
def packet_counts(spark, sf):
    return spark.read.schema("series_key string, bucket long, n long, batch long, date date").parquet(_packet_anomalies(spark, sf)["aux"]).drop("batch", "date")


@query("stream_packet_anomalies", sql=net.W(*net.PIPE) + "SELECT series_key, src, bucket, n FROM anomalies")
def packet_anomalies(spark, sf):
    return ST.read_anomalies(spark, _packet_anomalies(spark, sf)["out"], carry=("src",)).select("series_key", "src", "bucket", "n")


@query("stream_unique_srcs_last_seen", sql=net.W(*net.PIPE) + "SELECT ts, count(DISTINCT src) AS value FROM anomalies GROUP BY ts")
def unique_srcs_last_seen(spark, sf):
    """The anomalies of the packet stream, read as a stream: in order, so every source counts once per time."""
    found = _packet_anomalies(spark, sf)["out"]
    a = spark.readStream.schema("series_key string, bucket long, n long, src string, batch long, date date").parquet(found)
    a = a.withColumn("ts", bucket_start("bucket", DAY)).withColumn("arrival", F.col("bucket"))
    p = ST.fresh_paths(spark, "last-seen")
    PK.stream_unique_sources(a, p["out"], p["ckpt"], "60 days")
    return PK.read_unique_sources(spark, p["out"])


# Arrival of the feed: the part, and within it the time with the delay.
ARRIVAL = """edge AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
fed AS (SELECT *, epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 1800000000 ELSE 0 END AS late FROM events),
parts AS (SELECT fed.*, late >= lo + (hi - lo) / 2.0 AS part FROM fed, edge)"""


@query("stream_srcs_out_of_order", sql=f"""WITH {ARRIVAL},
s AS (SELECT event_type AS src, epoch_us(ts) // 3600000000 AS b, part, late, event_id FROM parts),
m AS (SELECT b, max(b) OVER (PARTITION BY src ORDER BY part, late, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s)
SELECT make_timestamp(b * 3600000000) AS ts, count(*) AS value FROM m WHERE seen IS NULL OR seen < b GROUP BY b""")
def srcs_out_of_order(spark, sf):
    """Every event as an anomaly of its hour, in order of arrival: sources seen at a later hour are not counted."""
    def run(s, p):
        late = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.pmod("event_id", F.lit(7)) == 0, 1_800_000_000).otherwise(0)
        # arrival in one number: ties of the time are broken by the id
        a = s.select(F.col("event_type").alias("src"), bucket_start(bucket_index("ts", HOUR), HOUR).alias("ts"),
                     ((late - 1_600_000_000_000_000) * 10_000 + F.pmod("event_id", F.lit(10_000))).alias("arrival"))
        PK.stream_unique_sources(a, p["out"], p["ckpt"], "60 days")

    return PK.read_unique_sources(spark, _streamed(spark, sf, "sightings", run)["out"])


@query("stream_distinct_anomalies", sql=f"WITH {ANOMALIES} SELECT series_key, bucket, n FROM a")
def distinct_anomalies(spark, sf):
    """Anomalies that a source delivers twice, the second time in a later run: each comes out once."""
    found = ST.read_anomalies(spark, _anomalies(spark, sf)["out"]).select("series_key", "bucket", "n")
    p = ST.fresh_paths(spark, "distinct")
    feed = p["aux"] + "-feed"
    for part in (found, found):
        part.write.mode("append").parquet(feed)
        s = PK.distinct_anomalies(spark.readStream.schema(found.schema).parquet(feed), HOUR, "60 days")
        ST.run_available_now(s.select("series_key", "bucket", "n").writeStream.outputMode("append").format("parquet")
                             .option("path", p["out"]).option("checkpointLocation", p["ckpt"]), "distinct")
    return spark.read.schema(found.schema).parquet(p["out"])


HALF_LIFE, WIDTH, LEAST = 100, 5.0, 300
DECAYED = f"""{ARRIVAL},
p AS (SELECT ts, CAST(user_id AS VARCHAR) AS src, event_type AS app, json_extract_string(props, '$.k') AS k, value AS v, row_number() OVER (ORDER BY part, ts,
   event_type, json_extract_string(props, '$.k'), CAST(value AS VARCHAR), CAST(user_id AS VARCHAR)) - 1 AS pos FROM parts),
w AS (SELECT pos // {HALF_LIFE} AS block, CAST(floor(v / {WIDTH}) AS BIGINT) AS bin, sum(pow(2.0, (pos % {HALF_LIFE} - {HALF_LIFE - 1}) / {HALF_LIFE}.0)) AS w FROM p GROUP BY ALL),
whole AS (SELECT unnest(range(0, (SELECT count(*) // {HALF_LIFE} FROM p))) AS block),
h AS (SELECT whole.block, w.bin, sum(w.w * pow(0.5, whole.block - w.block)) AS w FROM w JOIN whole ON w.block <= whole.block GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY block ORDER BY bin) AS cum, sum(w) OVER (PARTITION BY block) AS total FROM h),
cut AS (SELECT block AS made, (min(CASE WHEN cum * 3 >= total THEN bin END) + 1) * {WIDTH} AS b0, (min(CASE WHEN cum * 3 >= total * 2 THEN bin END) + 1) * {WIDTH} AS b1
   FROM c GROUP BY block),
seen AS (SELECT block, made, b0, b1, sum(CASE WHEN (bin + 0.5) * {WIDTH} < b0 THEN w ELSE 0 END) AS lo,
   sum(CASE WHEN (bin + 0.5) * {WIDTH} >= b0 AND (bin + 0.5) * {WIDTH} < b1 THEN w ELSE 0 END) AS mid, sum(w) AS total FROM h JOIN cut ON made < block GROUP BY ALL),
chi AS (SELECT block, made, ((lo - total / 3) * (lo - total / 3) + (mid - total / 3) * (mid - total / 3)
   + (total - lo - mid - total / 3) * (total - lo - mid - total / 3)) / (total / 3) AS chi2 FROM seen),
run(block, made) AS (SELECT min(block), min(block) FROM whole WHERE (block + 1) * {HALF_LIFE} >= {LEAST}
   UNION ALL SELECT run.block + 1, CASE WHEN chi2 > 5.991 THEN run.block + 1 ELSE run.made END FROM run JOIN chi ON chi.block = run.block + 1 AND chi.made = run.made),
force AS (SELECT run.block + 1 AS block, made, b0, b1 FROM run JOIN cut USING (made))"""


def _decayed(spark, sf):
    def run(s, p):
        PK.decayed_categories(standins.packet_bodies(s), p["out"], p["aux"], p["ckpt"], ("rl", "rs"), HALF_LIFE, WIDTH, LEAST)

    return _streamed(spark, sf, "decayed", run)


@query("stream_decayed_categories", sql=f"""WITH RECURSIVE {DECAYED}
SELECT ts, src, app, k, CASE WHEN b0 IS NULL THEN NULL WHEN v < b0 THEN 'low' WHEN v < b1 THEN 'medium' ELSE 'high' END AS rs
FROM p LEFT JOIN force ON force.block = pos // {HALF_LIFE}""")
def decayed_categories(spark, sf):
    facts = spark.read.schema("ts timestamp_ntz, dims map<string,string>, batch long").parquet(_decayed(spark, sf)["out"])
    return facts.select("ts", *[F.col("dims").getItem(c).alias(c) for c in ("src", "app", "k", "rs")])


@query("stream_category_skew", sql=f"""WITH RECURSIVE {DECAYED}
SELECT block, b0, b1, round(chi2, 6) AS chi2, chi2 > 5.991 AS is_skewed FROM force JOIN chi USING (block, made)""")
def category_skew(spark, sf):
    t = PK.read_skew(spark, _decayed(spark, sf)["aux"]).where("field = 'rs'")
    return t.select("block", F.col("bounds")[0].alias("b0"), F.col("bounds")[1].alias("b1"), F.round("chi2", 6).alias("chi2"), F.col("skewed").alias("is_skewed"))
