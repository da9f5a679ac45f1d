import math
import random

from pyspark.sql import functions as F

from fathom.operators import anomaly as A


def _flag_last(spark, series, m, s):
    """Reference unit form: the last value is the current bucket's count as
    read before its increment, so the final count is last + 1."""
    rows = [("k", i, int(v)) for i, v in enumerate(series[:-1]) if v > 0] + [("k", len(series) - 1, series[-1] + 1)]
    df = spark.createDataFrame(rows, "series_key string, bucket long, n long")
    f = {r["bucket"]: r["flag"] for r in A.anomaly_flags(df, 10, m, s).collect()}
    return f[len(series) - 1]


def test_reference_rule_cases(spark):
    # Series and verdicts of the rule's own example.
    assert _flag_last(spark, [0, 1, 2, 3, 4, 5, 6, 5, 4, 3, 4], 1.0, 1.0) is False
    assert _flag_last(spark, [0, 1, 2, 3, 4, 5, 6, 5, 4, 3, 24], 1.0, 1.0) is True
    assert _flag_last(spark, [0] * 10 + [2], 1.0, 1.0) is False
    assert _flag_last(spark, [0] * 10 + [12], 1.0, 1.0) is True


def test_first_flag_without_history_is_24(spark):
    df = spark.createDataFrame([("a", 0, 23), ("b", 0, 24)], "series_key string, bucket long, n long")
    f = {r["series_key"]: r["flag"] for r in A.anomaly_flags(df).collect()}
    assert f == {"a": False, "b": True}


def _simulate(counts, L=10, m=2.0, s=2.0):
    """Event-by-event: each event reads the previous L buckets and the current
    bucket's count before incrementing it."""
    flagged = set()
    cur = {}
    for b in sorted(counts):
        for _ in range(counts[b]):
            arr = [cur.get(b - L + i, 0) for i in range(L)] + [cur.get(b, 0)]
            mean = sum(arr) / (L + 1)
            if mean > m:
                prev = arr[:L]
                mu = sum(prev) / L
                sd = math.sqrt(sum((x - mu) ** 2 for x in prev) / L)
                if arr[-1] - mean > s * sd:
                    flagged.add(b)
            cur[b] = cur.get(b, 0) + 1
    return flagged


def test_window_form_matches_event_simulation(spark):
    rnd = random.Random(3)
    rows, expect = [], set()
    for key in range(40):
        counts = {}
        for b in range(60):
            if rnd.random() < 0.6:
                counts[b] = rnd.choice([1, 2, 3, 5, 8, 13, 30])
        rows += [(f"k{key}", b, n) for b, n in counts.items()]
        expect |= {(f"k{key}", b) for b in _simulate(counts)}
    df = spark.createDataFrame(rows, "series_key string, bucket long, n long")
    got = {(r["series_key"], r["bucket"]) for r in A.anomaly_flags(df).where("flag").collect()}
    assert got == expect


def test_group_anomalies_merges_disagreeing_dims(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([
        ("k1", t, {"src": "1", "app": "web", "dst": "9"}),
        ("k0", t, {"src": "1", "app": "db"}),
        ("k2", t, {"src": "2", "app": "web"}),
        ("k3", t, {"app": "web"}),
    ], "series_key string, ts timestamp_ntz, dims map<string,string>")
    g = {r["group"]: (r["series_key"], r["dims"]) for r in A.group_anomalies(df, "src").collect()}
    assert g["1"] == ("k0", {"src": "1", "app": "[grouped]", "dst": "9"})
    assert g["2"] == ("k2", {"src": "2", "app": "web"})
    assert set(g) == {"1", "2"}


def test_large_counts_do_not_overflow(spark):
    from fathom.operators import anomaly as A

    rows = [("k", b, 400_000_000) for b in range(11)] + [("k", 11, 4_000_000_000)]
    got = A.anomaly_flags(spark.createDataFrame(rows, "series_key string, bucket long, n long")).where("flag").collect()
    assert [r["bucket"] for r in got][-1] == 11


def test_history_runs_do_not_change_flags(spark):
    import random

    from fathom.operators import anomaly as A

    rng = random.Random(2)
    rows = [(f"k{i % 3}", b, rng.choice([1, 2, 3, 50])) for i in range(3) for b in range(-40, 60) if rng.random() < 0.7]
    c = spark.createDataFrame(rows, "series_key string, bucket long, n long")
    whole = sorted(map(tuple, A.anomaly_flags(c).select("series_key", "bucket", "flag").collect()))
    for chunk in (10, 13, 25):
        assert sorted(map(tuple, A.anomaly_flags(c, chunk=chunk).select("series_key", "bucket", "flag").collect())) == whole


def test_only_counts_that_could_flag_are_flagged(spark):
    rnd = random.Random(9)
    rows = [(f"k{k}", b, rnd.choice([1, 1, 2, 3, 4, 5, 24, 30])) for k in range(60) for b in range(30) if rnd.random() < 0.3]
    df = spark.createDataFrame(rows, "series_key string, bucket long, n long")
    for t, s in ((2.0, 2.0), (0.5, 0.0), (1.0, -3.0)):
        flagged = A.anomaly_flags(df, 10, t, s).where("flag")
        assert flagged.count() and flagged.where(~A.could_flag(flagged["n"], t, s)).count() == 0
    assert df.where(A.could_flag(df["n"])).count() == sum(n > 3 for _, _, n in rows)


def test_only_series_that_could_flag_meet_their_history(spark):
    rnd = random.Random(4)
    rows = [(f"k{k}", b, rnd.choice([1, 2, 3] if k % 3 else [1, 2, 3, 4, 30])) for k in range(90) for b in range(30) if rnd.random() < 0.4]
    df = spark.createDataFrame([*rows, (None, 3, 40), (None, 4, 1)], "series_key string, bucket long, n long")
    flags = lambda d: sorted((str(r["series_key"]), r["bucket"]) for r in A.anomaly_flags(d).where("flag").collect())
    kept = A.series_that_could_flag(df)
    assert flags(df) and flags(kept) == flags(df)
    want = {None} | {k for k, _, n in rows if n > 3}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in map(tuple, df.collect()) if r[0] in want), key=str)
    # whatever shares a slot, nothing is lost
    assert kept.count() < A.series_that_could_flag(df, slots=1).count() == df.count()


def test_detection_sends_only_series_that_could_flag(spark):
    from fathom.operators import facts as FA

    rows = [("2024-01-01 00:00:00", {"src": "1", "app": "a"})] * 30 + [("2024-01-01 00:00:00", {"src": str(i), "app": "b"}) for i in range(2, 40)]
    facts = spark.createDataFrame(rows, "ts string, dims map<string,string>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    counts = FA.entry_counts(facts, "1 day")
    kept = FA.keyed_counts(A.series_that_could_flag(counts, "entries"))
    whole = FA.fanned_counts(facts, "1 day")
    assert (whole.count(), kept.count()) == (78, 2)
    rows_of = lambda d: sorted((r["series_key"], r["bucket"], r["n"], sorted(r["dims"].items())) for r in A.detect_anomalies(d, "1 day").collect())
    assert len(rows_of(kept)) == 2 and rows_of(kept) == rows_of(whole)
