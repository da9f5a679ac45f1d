"""The streamed packet chain: bounds, decayed histograms, detection, last-seen sources, repeated anomalies."""

import datetime as dt
import os
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.operators import anomaly as A
from fathom.operators import facts as FA
from fathom.streaming import packets as PK
from fathom.streaming import streams as ST

START = dt.datetime(2024, 1, 1)
BODY = "ts timestamp_ntz, body string"


def _unfinished(ckpt, again):
    """A copy of a checkpoint as if its last micro-batch had written its rows but not finished."""
    last = max((x for x in os.listdir(f"{ckpt}/commits") if x.isdigit()), key=int)
    shutil.copytree(ckpt, again, ignore=lambda d, names: [x for x in names if os.path.basename(d) == "commits" and last in x])
    return again


def _simulate(values, half_life, width, min_points, k=3):
    """One value after the other: the bounds in force for each, and (block, chi2) of every test."""
    weights, bounds, force, tests = {}, None, [], []
    for i, v in enumerate(values):
        force.append(bounds)
        weights = {b: w * 2 ** (-1 / half_life) for b, w in weights.items()}
        b = int(v // width)
        weights[b] = weights.get(b, 0) + 1
        if (i + 1) % half_life:
            continue
        total, chi2 = sum(weights.values()), None
        if bounds:
            parts = [0.0] * k
            for b, w in weights.items():
                parts[sum((b + 0.5) * width >= x for x in bounds)] += w
            chi2 = sum((p - total / k) ** 2 / (total / k) for p in parts)
            tests.append((i // half_life, chi2))
        if i + 1 >= min_points and (chi2 is None or chi2 > 5.991):
            bounds, cum = [], 0.0
            for b in sorted(weights):
                cum += weights[b]
                while len(bounds) < k - 1 and cum * k >= total * (len(bounds) + 1):
                    bounds.append((b + 1) * width)
    return force, tests


def _label(v, bounds):
    return None if not bounds else "low" if v < bounds[0] else "medium" if v < bounds[1] else "high"


def test_decayed_categories_equal_a_sequential_simulation(spark, tmp_path):
    rng = random.Random(6)
    parts, values = [], []
    for part, n in enumerate((130, 1, 257, 40)):  # blocks end inside, at the edge of and across micro-batches
        rows = []
        for i in range(n):
            t = START + dt.timedelta(days=part, seconds=i)
            v = round(rng.gauss(20 * (part + 1) + i / 20, 9), 3)  # drifts
            rows.append((t, f"{{'src': 's{i % 3}', 'rs': '{v}'}}"))
            values.append(v)
        rows += [(START + dt.timedelta(days=part, seconds=7), "{'src': 'none'}"), (START, "{'src': 'x', 'rs': 'word'}")]
        rng.shuffle(rows)
        parts.append(rows)
    feed, out, state, ckpt = (str(tmp_path / x) for x in ("feed", "out", "state", "ckpt"))
    run = lambda c: PK.decayed_categories(spark.readStream.schema(BODY).parquet(feed), out, state, c, ("rl", "rs"), 20, 2.0, 60)
    for rows in parts:
        spark.createDataFrame(rows, BODY).repartition(3).write.mode("append").parquet(feed)
        run(ckpt)

    def check():
        facts = spark.read.schema("ts timestamp_ntz, dims map<string,string>, batch long").parquet(out).collect()
        assert len(facts) == len(values) + 8
        force, tests = _simulate(values, 20, 2.0, 60)
        order = sorted((r for r in facts if r["dims"]["src"].startswith("s")), key=lambda r: r["ts"])
        assert [r["dims"].get("rs") for r in order] == [_label(v, b) for v, b in zip(values, force)]
        assert all("rs" not in r["dims"] for r in facts if not r["dims"]["src"].startswith("s"))
        got = {r["block"]: r for r in PK.read_skew(spark, state).where("field = 'rs'").collect()}
        assert sorted(got) == [b for b, _ in tests]
        assert all(abs(got[b]["chi2"] - c) < 1e-6 and got[b]["skewed"] == (c > 5.991) for b, c in tests)
        assert any(r["skewed"] for r in got.values()) and not all(r["skewed"] for r in got.values())

    check()
    run(_unfinished(ckpt, str(tmp_path / "again")))  # the last micro-batch is replayed
    check()


def test_packet_stream_equals_batch_detection(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        t = START + dt.timedelta(minutes=rng.randrange(60 * 30))
        rows.append((t, f"{{'src': '{rng.randrange(3)}', 'app': '{rng.choice('ab')}', 'rs': '{rng.randrange(900)}'}}"))
    rows += [(START + dt.timedelta(hours=20, seconds=i), "{'src': '9', 'app': 'z', 'rs': '5'}") for i in range(90)] + [(START, "junk")]
    facts = FA.parse_facts(spark.createDataFrame(rows, BODY))
    counts = FA.fanned_counts(FA.categorize_numbers(facts, ("rs",)), "1 hour")
    want = sorted(map(tuple, A.detect_anomalies(counts, "1 hour").select("series_key", "bucket", "n").collect()))
    folder = str(tmp_path / "bounds")
    PK.write_bounds(spark, folder, {"rs": [1.0, 2.0], "rl": []}, 0)
    PK.write_bounds(spark, folder, {"rs": FA.tertile_bounds(facts, "rs")[1], "rl": []}, 1)  # the newest ones count
    feed, out, kept, ckpt = (str(tmp_path / x) for x in ("feed", "out", "counts", "ckpt"))

    def run(c):
        s = PK.packet_counts(spark.readStream.schema(BODY).parquet(feed), PK.read_bounds(spark, folder), "1 hour", "1 hour")
        ST.stream_anomalies(s, kept, out, c, "1 hour", carry=("src",))

    arrival = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.choice([0, 0, 0, 25])))
    end = [(START + dt.timedelta(days=9), "{'src': 'end'}")]
    for part in (arrival[:300], arrival[300:], end):
        spark.createDataFrame(part, BODY).coalesce(1).write.mode("append").parquet(feed)
        run(ckpt)
    found = lambda: ST.read_anomalies(spark, out, carry=("src",))
    got = lambda: sorted(map(tuple, found().select("series_key", "bucket", "n").collect()))
    assert want and got() == want
    assert all(f"3src{len(r['src'])}{r['src']}" in r["series_key"] for r in found().collect())
    run(_unfinished(ckpt, str(tmp_path / "again")))
    assert got() == want
    assert PK.read_bounds(spark, folder)["rl"] == []


@pytest.mark.parametrize("keep", ["0 seconds", "3 hours"])
def test_last_seen_sources(spark, tmp_path, keep):
    rng = random.Random(1)
    parts, seen, want = [], {}, Counter()
    for part in range(4):
        rows = []
        for i in range(60):
            src = rng.choice(["a", "a", "a", "b", f"p{part}", None])
            ts = START + dt.timedelta(hours=10 * part + rng.randrange(6))
            rows.append((src, ts, i))
            if src and (src not in seen or seen[src] < ts):
                seen[src] = ts
                want[ts] += 1
        rng.shuffle(rows)
        parts.append(rows)
    feed, out, ckpt = (str(tmp_path / x) for x in ("feed", "out", "ckpt"))
    schema = "src string, ts timestamp_ntz, arrival long"
    for rows in parts:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(feed)
        q = PK.stream_unique_sources(spark.readStream.schema(schema).parquet(feed), out, ckpt, "12 hours", keep)
    got = {r["ts"]: r["value"] for r in PK.read_unique_sources(spark, out).collect()}
    assert got == dict(want)
    every = {(s, t) for rows in parts for s, t, _ in rows if s}
    assert sum(want.values()) < len(every)  # some came out of order
    # sources of the first parts have left the state: it follows the watermark, not the number of sources ever seen
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(seen)


def test_anomalies_delivered_again_come_once(spark, tmp_path):
    schema = "series_key string, bucket long, n long"
    rows = [("a", 1, 5), ("b", 1, 6), ("a", 2, 7)]
    feed, out, ckpt = (str(tmp_path / x) for x in ("feed", "out", "ckpt"))
    for part in (rows + rows[:1], rows, [("a", 3, 9), ("a", 2, 7)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(feed)
        s = PK.distinct_anomalies(spark.readStream.schema(schema).parquet(feed), "1 hour", "1 day").select("series_key", "bucket", "n")
        ST.run_available_now(s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt), "d")
    assert sorted(map(tuple, spark.read.schema(schema).parquet(out).collect())) == sorted(rows + [("a", 3, 9)])


def test_queries_on_empty_stored_tables(spark, tmp_path):
    """N10 to N19 on a detection that found nothing."""
    from fathom.operators import series as S
    from fathom.sources.stores import write_dated

    schema = "series_key string, bucket long, n long, ts timestamp_ntz, dims map<string,string>"
    a = write_dated(spark.createDataFrame([], schema), str(tmp_path / "a"))
    assert a.columns == ["series_key", "bucket", "n", "ts", "dims", "date"]
    span = ("2024-01-01 00:00:00", "2024-01-03 00:00:00")
    assert A.anomalies_in_range(a, *span, src="x").count() == 0
    assert A.group_anomalies(a, "src").count() == 0
    assert {r["value"] for r in A.anomaly_counts(spark, a, *span, "1 day").collect()} == {0}
    assert {r["value"] for r in A.anomaly_counts_by_src(spark, a, *span, "1 day", src="x").collect()} == {0}
    assert A.anomaly_counts_by_src(spark, a, *span, "1 day").count() == 0
    assert A.unique_srcs_with_anomalies(a, *span).count() == 0
    assert S.series_counts(a, "k", "1 day", *span).count() == 0
    assert A.top_anomalous_sources(a).count() == 0
    assert A.explain_anomalies(a, a).count() == 0
    assert ST.read_counter_totals(spark, str(tmp_path), ["k"]).count() == 0


def test_many_sources_share_a_state_row(spark, tmp_path):
    feed, out, ckpt = (str(tmp_path / x) for x in ("feed", "out", "ckpt"))
    schema = "src string, ts timestamp_ntz, arrival long"
    rng, seen, want = random.Random(4), {}, Counter()
    for part in range(2):
        rows = [(f"s{rng.randrange(40)}", START + dt.timedelta(hours=4 * part + rng.randrange(6)), i) for i in range(200)]
        for s, t, _ in rows:
            if s not in seen or seen[s] < t:
                seen[s] = t
                want[t] += 1
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        q = PK.stream_unique_sources(spark.readStream.schema(schema).parquet(feed), out, ckpt, "12 hours", groups=2)
    assert {r["ts"]: r["value"] for r in PK.read_unique_sources(spark, out).collect()} == dict(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


def test_packet_state_has_a_row_per_combination(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=i), f"{{'src': 's{i % 2}', 'app': 'a', 'dst': 'd', 'ipv': '4'}}") for i in range(30)]
    feed, ckpt = str(tmp_path / "feed"), str(tmp_path / "ckpt")
    spark.createDataFrame(rows, BODY).write.parquet(feed)
    s = PK.packet_counts(spark.readStream.schema(BODY).parquet(feed), {}, "1 hour", "1 hour")
    q = ST.run_available_now(s.writeStream.foreachBatch(lambda b, i: b.count()).option("checkpointLocation", ckpt), "state")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # not 2 x 7 subsets


def test_blocks_are_not_grouped_one_by_one(monkeypatch):
    import pandas as pd

    names = [c.split()[0] for c in PK.STATE.split(", ")]
    old = pd.DataFrame([("rs", "state", None, None, None, 3, [6.0, 10.0], None, None), ("rs", "hist", None, 1.0, 0.5, None, None, None, None),
                        ("rs", "part", None, 4.0, 1.0, None, None, None, None)], columns=names)
    new = pd.DataFrame([("rs", 2, 7, 1.0, 1), ("rs", 1, 4, 0.5, 1)], columns=["field", "block", "bin", "w", "c"])
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *a, **k: 1 / 0)
    rows = PK._advance("rs", old, new, 2, 3, 2.0, 100, 5.991)
    assert [r[:3] + (r[6],) for r in rows if r[1] == "bounds"] == [("rs", "bounds", 1, [6.0, 10.0]), ("rs", "bounds", 2, [6.0, 10.0])]
    assert [r[3:5] for r in rows if r[1] == "hist"] == [(1, 0.25), (4, 1.5)] and [r[3:5] for r in rows if r[1] == "part"] == [(7, 1.0)]
    assert [r[5] for r in rows if r[1] == "state"] == [5]
