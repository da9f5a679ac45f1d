import datetime as dt
import random

from pyspark.sql import functions as F

from fathom.operators import weblog as W


def _hits(spark, rows):
    return spark.createDataFrame([(i, ip, uri, ts) for i, (ip, uri, ts) in enumerate(rows)],
                                 "hit_id long, ip string, uri string, ts timestamp_ntz")


def T(h, m, s):
    return dt.datetime(2024, 1, 2, h, m, s)


SMALL = [("A", "/product", T(2, 3, 43)), ("B", "/product", T(2, 28, 49)), ("C", "/career", T(22, 59, 12)),
         ("A", "/career", T(2, 11, 43)), ("A", "/product", T(2, 13, 43))]


def test_small_case_counts(spark):
    h = _hits(spark, SMALL)
    assert W.ip_visit_total(h, "A").first()["visits"] == 3
    assert W.ip_page_views(h, "A", "/career").first()["views"] == 1
    assert W.ip_page_views(h, "A", "/nowhere").first()["views"] == 0
    b = {r["uri"]: (r["total_visits"], r["bounces"]) for r in W.bounce_counts(h, "10 minutes").collect()}
    assert b == {"/product": (3, 2), "/career": (2, 1)}
    assert [r["uri"] for r in W.bounce_report(W.bounce_counts(h)).collect()] == ["/career", "/product"]
    missing = W.bounce_lookup(spark, W.bounce_counts(h), "/x").first()
    assert (missing["total_visits"], missing["bounces"]) == (0, 0)


def test_page_view_map_and_visitors(spark):
    h = _hits(spark, SMALL)
    m = {r["key"]: r["value"] for r in W.page_view_map(h).collect()}
    assert m["A"] == {"/career": 1, "/product": 2}
    assert sorted(r["key"] for r in W.visitors_of_page(h, "/career").collect()) == ["A", "C"]


def test_parse_access_log(spark):
    lines = spark.createDataFrame([
        ('10.0.0.1 - - [01/Jan/2024:11:45:38 -0400] "GET /home HTTP/1.1" 200 512 "-" "agent"',),
        ('10.0.0.1 - - [01/Jan/2024:22:45:38 -0400] "GET /docs HTTP/1.1" 401 7 "http://r" "agent x"',),
        ("not a log line",),
        ('10.0.0.1 - - [99/Foo/2024:11:45:38 -0400] "GET /home HTTP/1.1" 200 512 "-" "agent"',),
        ('10.0.0.1 - - [01/Jan/2024:11:45:38 -0400] "GET" 200 512 "-" "agent"',),
    ], "line string")
    got = W.parse_access_log(lines).orderBy("ts").collect()
    assert [(r.ip, r.uri, r.status, r.bytes) for r in got] == [("10.0.0.1", "/home", 200, 512), ("10.0.0.1", "/docs", 401, 7)]
    assert got[0].ts == dt.datetime(2024, 1, 1, 15, 45, 38)  # 24-hour clock, zone applied
    assert got[1].ts == dt.datetime(2024, 1, 2, 2, 45, 38)
    reasons = sorted(r.reason for r in W.access_log_rejects(lines).collect())
    assert reasons == ["bad_date", "bad_request", "no_match"]


def _brute_bounces(rows, timeout_s):
    by_ip = {}
    for i, (ip, uri, ts) in enumerate(rows):
        by_ip.setdefault(ip, []).append((ts, i, uri))
    out = {}
    for hs in by_ip.values():
        hs.sort()
        for j, (ts, i, uri) in enumerate(hs):
            nxt = hs[j + 1][0] if j + 1 < len(hs) else None
            b = nxt is None or (ts + dt.timedelta(seconds=timeout_s) < nxt)
            v, c = out.get(uri, (0, 0))
            out[uri] = (v + 1, c + int(b))
    return out


def test_bounces_match_sequential_scan(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(600):
        ip = rnd.choice(["hot"] * 6 + ["a", "b", "c"])  # one hot ip holds most hits
        rows.append((ip, rnd.choice(["/x", "/y", "/z"]), base + dt.timedelta(seconds=rnd.randrange(0, 3 * 86400))))
    rows += [("a", "/x", base), ("a", "/y", base)]  # equal timestamps
    h = _hits(spark, rows)
    for timeout, chunk in [(600, "1 hour"), (600, "1 minute"), (7200, "30 minutes"), (20, "1 day")]:
        got = {r["uri"]: (r["total_visits"], r["bounces"]) for r in W.bounce_counts(h, timeout, chunk=chunk).collect()}
        assert got == _brute_bounces(rows, timeout), (timeout, chunk)


def test_bounce_slices_cut_sessions(spark):
    h = _hits(spark, [("A", "/a", T(0, 9, 0)), ("A", "/b", T(0, 11, 0))])
    inc = W.bounce_increments(h, slice_width="10 minutes", timeout="10 minutes")
    tot = {r["uri"]: r["bounces"] for r in W.bounce_store_totals(inc).collect()}
    assert tot == {"/a": 1, "/b": 1}  # the session is cut at the slice edge
    assert W.bounce_counts(h).where(F.col("uri") == "/a").first()["bounces"] == 0


def test_slices_start_anywhere_and_reruns_replace(spark):
    # four hits a minute apart each; slices that are not aligned to their width
    h = _hits(spark, [("A", "/a", T(0, 8, 0)), ("A", "/b", T(0, 12, 0)), ("B", "/a", T(0, 16, 0)), ("B", "/b", T(0, 24, 0))])
    total = lambda s: {r["uri"]: (r["total_visits"], r["bounces"]) for r in W.bounce_store_totals(s).collect()}
    first, second = ("2024-01-02 00:05:00", "2024-01-02 00:15:00"), ("2024-01-02 00:15:00", "2024-01-02 00:25:00")
    store = W.bounce_counts_slice(h, *second, W.bounce_counts_slice(h, *first))
    assert total(store) == {"/a": (2, 0), "/b": (2, 2)}
    assert total(W.bounce_counts_slice(h, *first, store)) == total(store)
    empty = W.bounce_counts_slice(h.where("false"), *second, store)
    assert total(empty) == {"/a": (1, 0), "/b": (1, 1)}


def test_access_log_line_end(spark):
    line = '10.0.0.1 - - [01/Jan/2024:11:45:38 -0400] "GET /home HTTP/1.1" 200 512 "-" "agent"'
    df = spark.createDataFrame([(line + "\n",), (None,)], "line string")
    assert W.parse_access_log(df).count() == 0 and W.access_log_rejects(df).count() == 2
