import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fathom.functions.maps import series_key
from fathom.operators import facts as FA
from fathom.operators import series as S


def _fact_frame(spark, dims_list):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t, d) for d in dims_list], "ts timestamp_ntz, dims map<string,string>")


def test_subset_counts(spark):
    for n_other, max_size, expect in [(1, 1, 2), (2, 2, 4), (3, 2, 7), (9, 2, 46), (7, 2, 29), (3, 3, 8), (0, 2, 1)]:
        dims = {"src": "s", **{f"d{i}": str(i) for i in range(n_other)}}
        out = FA.fanout_dimensions(_fact_frame(spark, [dims]), max_size=max_size).collect()
        assert len(out) == expect, (n_other, max_size)
        assert all(r["dims"]["src"] == "s" for r in out)
        assert len({tuple(sorted(r["dims"].items())) for r in out}) == expect


def test_fanout_requires_src(spark):
    f = _fact_frame(spark, [{"app": "x"}, {"src": "1", "app": "x"}])
    assert FA.fanout_dimensions(f).count() == 2
    assert FA.fanout_rejects(f).count() == 1


def test_series_key_format(spark):
    f = _fact_frame(spark, [{"src": "10.0.0.1", "app": "http"}])
    assert f.select(series_key("dims").alias("k")).first()["k"] == "3app4http3src8" + "10.0.0.1"


def test_parse_facts_lines_and_rejects(spark):
    b = spark.createDataFrame([(dt.datetime(2024, 1, 1), "{'src': '1', 'rs': '5'}\n{\"src\": \"2\", \"n\": 7}\n\njunk")],
                              "ts timestamp_ntz, body string")
    got = sorted((r["dims"]["src"], r["dims"].get("n")) for r in FA.parse_facts(b).collect())
    assert got == [("1", None), ("2", "7")]
    assert [r["line"] for r in FA.fact_rejects(b).collect()] == ["junk"]


def test_categorize_bounds_match_order_statistics(spark):
    rng = np.random.default_rng(1)
    vals = rng.gamma(2.0, 20.0, 1000).round(2)
    f = _fact_frame(spark, [{"src": "1", "rs": str(v)} for v in vals])
    n, b = FA.tertile_bounds(f, "rs")
    x = np.sort(vals)
    o1, o2 = 1000 // 3, 2000 // 3
    assert n == 1000
    assert b == [(x[o1 - 1] + x[o1]) / 2, (x[o2 - 1] + x[o2]) / 2]
    cat = FA.categorize_numbers(f, fields=("rs",))
    counts = {r["c"]: r["n"] for r in cat.groupBy(F.col("dims")["rs"].alias("c")).agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {"low", "medium", "high"}
    one = _fact_frame(spark, [{"src": "1", "rs": "3"}])
    assert FA.categorize_numbers(one, fields=("rs",), min_points=900).first()["dims"] == {"src": "1"}  # warm-up on demand
    assert FA.categorize_numbers(one, fields=("rs",)).first()["dims"] == {"src": "1", "rs": "high"}


def test_sliding_windows_cover_event(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10, 30), "a")], "ts timestamp_ntz, src string")
    w = S.sliding_top(df, "src", "ts", "10 minutes", "1 minute", 10).orderBy("window_start").collect()
    assert len(w) == 10
    assert w[0]["window_start"] == dt.datetime(2024, 1, 1, 0, 1) and w[-1]["window_start"] == dt.datetime(2024, 1, 1, 0, 10)


def test_zero_filled_grid(spark):
    obs = spark.createDataFrame([(0, 5), (100, 2)], "bucket long, value long")
    g = S.zero_filled(spark, obs, "1970-01-01 00:00:00", "1970-01-01 00:00:17", "5 seconds").orderBy("ts").collect()
    assert [r["value"] for r in g] == [5, 0, 0]  # floor(17 / 5) = 3 points; bucket 100 is after the end


def test_bounds_of_many_distinct_values_are_exact(spark):
    n = 3_000_000
    f = spark.range(n).select(F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"),
                              F.create_map(F.lit("rs"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("string")).alias("dims"))
    assert FA.tertile_bounds(f, "rs") == (n, [999_999.5, 1_999_999.5])


def test_order_statistics_with_heavy_and_far_values(spark):
    vals = [0.0] * 5000 + [float(i) for i in range(6000)] + [1e300, -1e300, 1e-300]
    x = sorted(vals)
    far = sorted([k * 5e304 for k in range(-3000, 3000)])  # their range is no finite double
    both = spark.createDataFrame([(0, v) for v in vals] + [(1, v) for v in far], "field int, value double")
    c = both.groupBy("field", "value").agg(F.count("*").alias("c")).withColumn("key", FA.order_key("value"))
    ranks = [1, 2, 4000, 5001, 5003, 9000, len(x)]
    got = FA.order_statistics(c, {0: ranks, 1: [1, 2999, 3001, 6000]})
    assert got == {**{(0, r): x[r - 1] for r in ranks}, **{(1, r): far[r - 1] for r in [1, 2999, 3001, 6000]}}
    assert FA.order_statistics(c, {0: [], 1: []}) == {}


def test_order_keys_are_in_the_order_of_doubles(spark):
    vals = sorted([0.0, 1.5, -1.5, 1e-310, -1e-310, 1.7e308, -1.7e308, 2.0, 3.0, -7.25])
    rows = spark.createDataFrame([(v,) for v in vals], "value double").withColumn("key", FA.order_key("value")).collect()
    assert [r["value"] for r in sorted(rows, key=lambda r: r["key"])] == vals


def test_bounds_of_values_at_both_ends_of_the_range(spark):
    f = _fact_frame(spark, [{"src": "1", "rs": repr(v)} for v in (-1.7e308, -1.6e308, 1.0, 1.6e308, 1.7e308, 1.75e308)])
    n, b = FA.tertile_bounds(f, "rs")
    assert n == 6 and np.allclose(np.array(b) / 1e308, [-0.8, 1.65])


def test_fanned_counts_equal_counted_fanout(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=7 * i), {"src": str(i % 2), "app": "ab"[i % 2], "k": str(i % 3)} if i % 5 else {"app": "x"}) for i in range(60)]
    f = spark.createDataFrame(rows, "ts timestamp_ntz, dims map<string,string>")
    slow = S.interval_counts(FA.with_series_key(FA.fanout_dimensions(f)), "1 day").select("series_key", "bucket", "n")
    fast = FA.fanned_counts(f, "1 day")
    assert sorted(map(tuple, fast.select("series_key", "bucket", "n").collect())) == sorted(map(tuple, slow.collect()))
    assert fast.where(series_key("dims") != F.col("series_key")).count() == 0
