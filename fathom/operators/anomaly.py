"""Per-key count anomalies.

Input: bucket counts ``series_key, bucket, n`` (see
:func:`fathom.operators.series.interval_counts`), optionally with ``dims``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.maps import render_map
from fathom.functions.time import bucket_start, micros_of, ntz_literal
from fathom.operators import series as S


def anomaly_flags(counts: DataFrame, lookback: int = 10, mean_threshold: float = 2.0, sensitivity: float = 2.0,
                  key: str = "series_key", bucket: str = "bucket", n: str = "n", chunk: int = 100_000) -> DataFrame:
    """Flag a bucket when, with ``v = n - 1`` (the count before its last
    event), ``S``/``Q`` the sum and sum of squares of the previous ``lookback``
    buckets (missing ones count 0):

    * mean of the ``lookback + 1`` points ``(S + v) / (L + 1) > mean_threshold``, and
    * ``v - mean > sensitivity * popstd(previous L)``, i.e.
      ``(L v - S) / (L + 1) > s * sqrt(L Q - S^2) / L``.

    Checking the last event is enough: both sides grow with v, so some event
    of the bucket met the rule exactly when its last one did. The trailing
    frame is a RANGE window on the bucket index, which supplies the zeros.
    Rows are one per (key, bucket), and a key's history is split into runs of
    ``chunk`` buckets; the last ``lookback`` buckets of a run also go to the
    next one as history, so a long history is spread over many tasks.
    """
    L = int(lookback)
    width = max(int(chunk), L)
    run = F.floor(F.col(bucket) / F.lit(width)).cast("long")
    runs = F.when(F.pmod(F.col(bucket), F.lit(width)) >= width - L, F.array(run, run + 1)).otherwise(F.array(run))
    counts = counts.select("*", F.posexplode(runs).alias("_old", "_run"))
    w = Window.partitionBy(key, "_run").orderBy(bucket).rangeBetween(-L, -1)
    square = F.col(n).cast("decimal(19,0)") * F.col(n).cast("decimal(19,0)")
    c = counts.withColumn("S", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long")) \
        .withColumn("Q", F.coalesce(F.sum(square).over(w), F.lit(0)).cast("decimal(38,0)"))
    v = (F.col(n) - 1).cast("long")
    mean_ok = (F.col("S") + v).cast("double") / F.lit(float(L + 1)) > F.lit(float(mean_threshold))
    # squares of counts pass 64 bits long before counts do: exact decimals, a double only for the root
    s = F.col("S").cast("decimal(19,0)")
    var = ((F.col("Q") * F.lit(L)).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")).cast("double")
    dev_ok = (F.lit(L) * v - F.col("S")).cast("double") / F.lit(float(L + 1)) > \
        F.lit(float(sensitivity)) * F.sqrt(var) / F.lit(float(L))
    return c.withColumn("flag", mean_ok & dev_ok).where("_old = 0").drop("_old", "_run")


def could_flag(n, mean_threshold: float = 2.0, sensitivity: float = 2.0) -> F.Column:
    """Whether :func:`anomaly_flags` can flag a bucket with this count, whatever its history: with ``v = n - 1`` a flag
    needs ``S + v > t (L + 1)`` and, as a deviation is not negative, ``L v > S``, hence ``v > t``. A negative
    ``sensitivity`` allows any count."""
    return n - 1 > F.lit(float(mean_threshold)) if sensitivity >= 0 else n.isNotNull()


SLOTS = 1 << 22  # of series by hash, a power of two; at most that many rows go to all tasks


def series_that_could_flag(counts: DataFrame, key: str = "series_key", mean_threshold: float = 2.0, sensitivity: float = 2.0,
                           slots: int = SLOTS) -> DataFrame:
    """The rows of ``counts`` (``n`` and ``key``) whose series may have a flagged bucket: those with a count that
    :func:`could_flag` allows, with their whole history, so :func:`anomaly_flags` flags the same buckets of them. Series
    are told apart by slots of their hash; one that shares a slot with another is kept needlessly, none is lost.
    The slots go to all tasks, so what is left out is never sorted or sent by series."""
    marked = counts.withColumn("_slot", F.xxhash64(key).bitwiseAND(F.lit(slots - 1)).cast("int"))
    some = marked.where(could_flag(F.col("n"), mean_threshold, sensitivity)).select("_slot").distinct()
    # distinct slots, so at most one match; unlike a semi-join it stays above the count, whose rows both sides read
    return marked.join(F.broadcast(some), "_slot").drop("_slot")


def detect_anomalies(counts: DataFrame, interval, lookback: int = 10, mean_threshold: float = 2.0,
                     sensitivity: float = 2.0) -> DataFrame:
    """N8 + N9: the flagged buckets, once per (series_key, bucket), as anomaly
    facts stamped with the bucket start: ``series_key, bucket, n, ts[, dims]``."""
    f = anomaly_flags(counts, lookback, mean_threshold, sensitivity).where("flag")
    cols = ["series_key", "bucket", "n", bucket_start("bucket", interval).alias("ts")]
    if "dims_json" in counts.columns:
        cols.append(F.from_json("dims_json", "map<string,string>").alias("dims"))
    elif "dims" in counts.columns:
        cols.append("dims")
    return f.select(*cols)


def _between(anomalies: DataFrame, start, end) -> DataFrame:
    """``start <= ts <= end``; on a table stored by date (see
    :func:`fathom.sources.stores.write_dated`) only those partitions are read."""
    a = anomalies.where((F.col("ts") >= ntz_literal(start)) & (F.col("ts") <= ntz_literal(end)))
    if "date" in anomalies.columns:
        a = a.where((F.col("date") >= F.to_date(ntz_literal(start))) & (F.col("date") <= F.to_date(ntz_literal(end))))
    return a


def anomalies_in_range(anomalies: DataFrame, start, end, src=None) -> DataFrame:
    """Anomalies with ``start <= ts <= end``, optionally of one ``src``,
    most recent first."""
    a = _between(anomalies, start, end)
    if src is not None:
        a = a.where(F.col("dims").getItem("src") == F.lit(src))
    return a.orderBy(F.col("ts").desc(), F.col("series_key").desc())


GROUPED = "[grouped]"


def group_anomalies(anomalies: DataFrame, group_for: str, src=None) -> DataFrame:
    """Group anomalies by (ts, dims[group_for]); anomalies without that
    dimension are skipped. Per other dimension: its value if every member that
    has it agrees, else ``[grouped]``. The group's series key is its smallest
    member key. The optional ``src`` filter applies to the grouped dims.

    Exploding the dims gives (ts, group, key, value) rows; min = max per
    (ts, group, key) means agreement. A group's map has one entry per distinct
    dimension name, so it stays small however many members the group has."""
    g = F.col("dims").getItem(group_for)
    a = anomalies.where(g.isNotNull()).select("ts", g.alias("group"), "series_key", "dims")
    e = a.select("ts", "group", F.explode("dims").alias("k", "v"))
    per_key = e.groupBy("ts", "group", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    per_key = per_key.select("ts", "group", "k", F.when(F.col("lo") == F.col("hi"), F.col("lo"))
                             .otherwise(F.lit(GROUPED)).alias("v"))
    dims = per_key.groupBy("ts", "group").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("dims"))
    keys = a.groupBy("ts", "group").agg(F.min("series_key").alias("series_key"))
    out = keys.join(dims, ["ts", "group"])
    if src is not None:
        out = out.where(F.col("dims").getItem("src") == F.lit(src))
    return out


def anomaly_counts(spark: SparkSession, anomalies: DataFrame, start, end, interval) -> DataFrame:
    """Per bucket the number of distinct anomalous series, zero-filled
    over the grid of :func:`fathom.operators.series.zero_filled`."""
    obs = _from_bucket(anomalies, start, end, interval).groupBy("bucket").agg(F.count_distinct("series_key").alias("value"))
    return S.zero_filled(spark, obs, start, end, interval)


def _from_bucket(anomalies: DataFrame, start, end, interval) -> DataFrame:
    """Anomalies from the start of ``start``'s bucket on, up to ``end``."""
    import datetime as dt

    t, d = dt.datetime.fromisoformat(str(start)), micros_of(interval)
    floor = t - dt.timedelta(microseconds=(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) % d)
    return _between(anomalies, floor, end)


def anomaly_counts_by_src(spark: SparkSession, anomalies: DataFrame, start, end, interval, src=None) -> DataFrame:
    """N12 for one ``src`` (zero-filled); with ``src=None`` the observed
    counts of every src, ``src, ts, value`` (no grid per src)."""
    s = F.col("dims").getItem("src")
    if src is not None:
        obs = _from_bucket(anomalies, start, end, interval).where(s == F.lit(src)).groupBy("bucket").agg(F.count_distinct("series_key").alias("value"))
        return S.zero_filled(spark, obs, start, end, interval)
    a = _between(anomalies, start, end)
    return a.groupBy(s.alias("src"), "bucket").agg(F.count_distinct("series_key").alias("value")) \
        .select("src", bucket_start("bucket", interval).alias("ts"), "value")


def unique_srcs_with_anomalies(anomalies: DataFrame, start, end) -> DataFrame:
    """Per bucket the number of distinct src with an anomaly, buckets in
    ``[start, end)``, no zero fill."""
    a = _between(anomalies, start, end).where(F.col("ts") < ntz_literal(end))
    return a.groupBy("ts").agg(F.count_distinct(F.col("dims").getItem("src")).alias("value"))


def top_anomalous_sources(anomalies: DataFrame, width="10 minutes", slide="1 minute", limit: int = 10,
                          start=None) -> DataFrame:
    """:func:`fathom.operators.series.sliding_top` over the anomalies' src."""
    a = anomalies.select("ts", F.col("dims").getItem("src").alias("src"))
    return S.sliding_top(a, "src", "ts", width, slide, limit, start)


def explain_anomalies(anomalies: DataFrame, counts: DataFrame, span: int = 10, start=None, end=None, interval=None) -> DataFrame:
    """For every anomaly, its key's stored counts from ``span`` buckets
    before to ``span`` after. Each anomaly is expanded into its ``2 span + 1``
    bucket indexes, so this is an equi-join on (key, bucket) - no
    key-only join whose pairs grow with a hot key's history.

    With ``start`` and ``end`` (and the ``interval`` of the buckets) the anomalies of that range; of tables stored by
    date, only the range's dates, and for the counts ``span`` intervals more on both sides, are opened."""
    if start is not None:
        import datetime as dt

        around = span * dt.timedelta(microseconds=micros_of(interval))
        anomalies = _between(anomalies, start, end)
        counts = S.within_dates(counts, dt.datetime.fromisoformat(str(start)) - around, dt.datetime.fromisoformat(str(end)) + around)
    a = anomalies.select("series_key", F.col("bucket").alias("anomaly_bucket"),
                         F.explode(F.sequence(F.col("bucket") - span, F.col("bucket") + span)).alias("bucket"))
    return a.join(counts.select("series_key", "bucket", "n"), ["series_key", "bucket"])


def render(anomalies: DataFrame) -> DataFrame:
    """Anomalies with the dims map as ``k=v;...`` text (stable for hashing)."""
    return anomalies.withColumn("dims", render_map("dims"))
