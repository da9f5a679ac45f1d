"""Streams over files in parts, with late rows, restarts and a replayed batch, equal the batch results."""

import datetime as dt
import os
import random
import shutil

from pyspark.sql import functions as F

from fathom.operators import anomaly as A
from fathom.operators import series as S
from fathom.sources import stores
from fathom.streaming import streams as ST

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def _parts(n=600, seed=3):
    rng = random.Random(seed)
    rows = sorted((START + dt.timedelta(minutes=rng.randrange(0, 60 * 40)), rng.choice("aaab")) for _ in range(n))
    rows += [(START + dt.timedelta(hours=30, seconds=i), "b") for i in range(120)]  # an anomaly
    rows = [(i, t, i % 9, k) for i, (t, k) in enumerate(sorted(rows))]
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=25 if r[0] % 5 == 0 else 0))  # some arrive late
    third = len(rows) // 3
    end = (10**6, START + dt.timedelta(days=9), None, "end")
    return rows, [arrival[:third], arrival[third:2 * third], arrival[2 * third:], [end]]


def _run(spark, tmp_path, parts, start):
    feed = str(tmp_path / "feed")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        start(spark.readStream.schema(SCHEMA).parquet(feed))


def test_stream_equals_batch(spark, tmp_path):
    rows, parts = _parts()
    batch = spark.createDataFrame(rows, SCHEMA)
    out = str(tmp_path / "out")

    def start(stream):
        counts = ST.stream_interval_counts(stream, "event_type", "1 hour", "1 hour")
        ST.stream_anomalies(counts, str(tmp_path / "counts"), out, str(tmp_path / "ckpt"), "1 hour", counters_path=out + "-n")

    _run(spark, tmp_path, parts, start)
    counts = S.interval_counts(batch, "1 hour", key="event_type").withColumnRenamed("event_type", "series_key")
    want = sorted(map(tuple, A.detect_anomalies(counts, "1 hour").select("series_key", "bucket", "n").collect()))
    got = ST.read_anomalies(spark, out)
    assert want and sorted(map(tuple, got.select("series_key", "bucket", "n").collect())) == want
    stored = spark.read.parquet(str(tmp_path / "counts")).select("series_key", "bucket", "n")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, counts.select("series_key", "bucket", "n").collect()))
    totals = {r["bucket"]: r["n"] for r in ST.read_counter_totals(spark, out + "-n", ["bucket"], ["long"]).collect()}
    assert totals == {b: sum(1 for w in want if w[1] == b) for b in {w[1] for w in want}}


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    rows, parts = _parts()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    _run(spark, tmp_path, parts[:3], lambda s: ST.stream_counter_store(s, ["event_type"], out, ckpt))
    want = {k: sum(1 for r in rows if r[3] == k) for k in "ab"}
    totals = lambda: {r["event_type"]: r["n"] for r in ST.read_counter_totals(spark, out, ["event_type"]).collect()}
    assert totals() == want
    # the same checkpoint as if the last batch had written its rows but not finished
    last = max((x for x in os.listdir(f"{ckpt}/commits") if x.isdigit()), key=int)
    again = str(tmp_path / "again")
    shutil.copytree(ckpt, again, ignore=lambda d, names: [x for x in names if os.path.basename(d) == "commits" and last in x])
    ST.stream_counter_store(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "feed")), ["event_type"], out, again)
    assert totals() == want


def test_counter_store_rerun_without_rows(spark):
    store = stores.add_counters(None, spark.createDataFrame([(1, "x", 2), (2, "x", 5)], "batch long, k string, n long"), ["k"], ["n"])
    empty = spark.createDataFrame([], "batch long, k string, n long")
    left = stores.add_counters(store, empty, ["k"], ["n"], batches=[1])
    assert [r["n"] for r in stores.counter_totals(left, ["k"], ["n"]).collect()] == [5]


def test_sliding_top_keeps_a_row_per_value_and_hour(spark, tmp_path):
    """Late rows count in the windows still open to them and in no other; a replayed batch changes nothing."""
    rng, hour = random.Random(9), dt.timedelta(hours=1)
    at = lambda lo, hi: START + dt.timedelta(seconds=rng.randrange(int(lo * 3600), int(hi * 3600)))
    parts = [[(0, at(0, 12), u, "x") for u in range(6) for _ in range(15)], [(0, at(2, 20), u, "x") for u in range(8) for _ in range(9)],
             [(0, at(0, 30), u, "x") for u in range(8) for _ in range(9)] + [(0, None, 3, "x"), (0, at(0, 30), None, "x")], [(0, START + 90 * hour, 0, "x")]]
    want, open_, seen, closed = {}, {}, None, START - 99 * hour
    for rows in parts:
        rows = [r for r in rows if r[1] is not None and r[2] is not None]
        for _, t, u, _ in rows:
            h = t.replace(minute=0, second=0)
            for w in (h - i * hour for i in range(6)):
                if w + 6 * hour > closed and (w - START) // hour % 2 == 0:
                    open_.setdefault(w, {}).setdefault(u, []).append(t)
        seen = max([t for _, t, _, _ in rows] + ([seen] if seen else []))
        closed = seen - hour
        for w in [w for w in open_ if w + 6 * hour <= closed]:
            ranked = sorted((-len(ts), u) for u, ts in open_.pop(w).items())[:3]
            want |= {(w, u): (-n, i + 1) for i, (n, u) in enumerate(ranked)}
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    start = lambda s, c=ckpt: ST.stream_sliding_top(s, "user_id", "6 hours", "2 hours", 3, "1 hour", out, c)
    got = lambda: {(r["window_start"], r["value"]): (r["count"], r["rank"]) for r in spark.read.parquet(out).collect()}
    _run(spark, tmp_path, parts, start)
    assert len(want) > 30 and got() == want
    kept = {(i, u, (t - START) // (2 * hour)) for i, p in enumerate(parts) for _, t, u, _ in p if t and u is not None}
    assert spark.read.parquet(out + "-units").count() == len(kept)
    again = str(tmp_path / "again")  # the last batch had written its rows but not finished
    last = max((x for x in os.listdir(f"{ckpt}/commits") if x.isdigit()), key=int)
    shutil.copytree(ckpt, again, ignore=lambda d, names: [x for x in names if os.path.basename(d) == "commits" and last in x])
    start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "feed")), again)
    assert got() == want


def test_counter_snapshots(spark, tmp_path):
    """Totals read the snapshot and the open batches only; a fold that stops half-way and replays change nothing."""
    store = stores.CounterStore(spark, str(tmp_path / "c"), {"k": "string"})
    assert store.totals().count() == 0
    want = {}
    delta = lambda b: spark.createDataFrame([("a", b), (f"x{b % 3}", 1)], "k string, n long").coalesce(1)
    totals = lambda: {r["k"]: r["n"] for r in store.totals().collect()}
    for b in range(24):
        store.add(b, delta(b))
        for k, n in (("a", b), (f"x{b % 3}", 1)):
            want[k] = want.get(k, 0) + n
        if b in (8, 16):
            store.compact(b - 2)
            assert totals() == want
        if b == 20:
            store.fold(18)  # as if stopped before the manifest row
            assert totals() == want
            store.add(20, delta(20))
            store.add(3, delta(3))  # folded long ago
    assert totals() == want
    opened = [f for f in store.totals().inputFiles() if "batch=" in f and "batch=-1" not in f]
    assert {int(f.split("batch=")[1].split("/")[0]) for f in opened} == set(range(15, 24))
    store.compact(18)
    store.compact(18)
    assert totals() == want


def test_live_metrics(spark, tmp_path):
    from fathom.streaming import metrics as FM

    feed, told = str(tmp_path / "feed"), []
    m = FM.FeedMetrics(report=lambda batch, seen: told.append(batch))
    for rows in ([("ab", START), (None, START)], [("é", START)], [(None, START)]):
        spark.createDataFrame(rows, "text string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(feed)
        FM.stream_text_events(spark.readStream.schema("text string, ts timestamp_ntz").parquet(feed), str(tmp_path / "out"), str(tmp_path / "ckpt"), m)
    assert list(map(tuple, FM.as_table(spark, m).collect())) == [(0, 1, 2, 1), (1, 1, 1, 0), (2, 0, 0, 1)] and told == [0, 1, 2]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_dated_table_opens_only_the_dates_asked_for(spark, tmp_path):
    rows = [(f"k{i}", START + dt.timedelta(days=i), i) for i in range(10)]
    t = stores.write_dated(spark.createDataFrame(rows, "series_key string, ts timestamp_ntz, bucket long"), str(tmp_path / "t"))
    part = A.anomalies_in_range(t.withColumn("dims", F.create_map(F.lit("src"), F.lit("s"))), "2024-01-03 00:00:00", "2024-01-05 00:00:00")
    assert sorted(r["bucket"] for r in part.collect()) == [2, 3, 4]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_stored_counts_open_only_the_dates_asked_for(spark, tmp_path):
    rows = [(k, d, 1 + d % 3, START + dt.timedelta(days=d)) for k in "ab" for d in range(60)]
    base = dt.datetime(1970, 1, 1)
    rows = [(k, (t - base).days, n, t) for k, _, n, t in rows]
    counts = stores.write_dated(spark.createDataFrame(rows, "series_key string, bucket long, n long, ts timestamp_ntz"), str(tmp_path / "c"))
    found = stores.write_dated(spark.createDataFrame([r for r in rows if r[0] == "a" and r[3].day == 15], counts.drop("date").schema), str(tmp_path / "a"))
    one = S.series_counts(counts, "a", "1 day", "2024-01-10 05:00:00", "2024-01-12 00:00:00")
    assert [r["ts"].day for r in one.collect()] == [10, 11, 12]
    some = A.explain_anomalies(found, counts, 2, "2024-01-10 00:00:00", "2024-01-20 00:00:00", interval="1 day")
    assert sorted(r["bucket"] - r["anomaly_bucket"] for r in some.collect()) == [-2, -1, 0, 1, 2]
    for df in (one, some):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "date#" in plan and ">= 2024-01-" in plan
