"""Bucketed counts and their queries (N7, N12, N15-N17), generic in the key,
time column and interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.time import (bucket_index, bucket_start, ensure_ntz, micros_of, ntz_literal)


def _bucket_of_literal(value, width) -> int:
    """Bucket index of a literal time (computed by the same SQL expression)."""
    import datetime as dt

    t = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    us = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    d = micros_of(width)
    return us // d


def _bucket_edge(value, width, up: bool = False):
    """Start of the bucket that holds a literal time; with ``up`` the next edge unless the time is one."""
    import datetime as dt

    t = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    rest = (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) % micros_of(width)
    return t - dt.timedelta(microseconds=rest) + dt.timedelta(microseconds=micros_of(width) if up and rest else 0)


def interval_counts(facts: DataFrame, interval="5 seconds", key: str = "series_key", ts: str = "ts",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Events per (key, ``floor(ts / interval)``) -> ``key, bucket, n``.

    ``carry`` columns are functions of the key (e.g. its dims map); they are
    kept as JSON text (``<name>_json``) and used as extra grouping keys, so the
    aggregation stays a hash aggregate with map-side combining (a map-typed
    buffer would force a sort-based aggregate over every row)."""
    f = ensure_ntz(facts, ts).withColumn("bucket", bucket_index(ts, interval))
    extra = [F.to_json(c).alias(f"{c}_json") for c in carry]
    return f.groupBy(key, "bucket", *extra).agg(F.count(F.lit(1)).alias("n"))


def traffic_counts(facts: DataFrame, interval="5 seconds", start=None, end=None, ts: str = "ts") -> DataFrame:
    """Events per bucket with bucket start in ``[floor(start), end)``, no zero fill."""
    f = ensure_ntz(facts, ts)
    # bounds on the raw time, widened to whole buckets, so that they reach the scan
    if start is not None:
        f = f.where(F.col(ts) >= ntz_literal(_bucket_edge(start, interval)))
    if end is not None:
        f = f.where(F.col(ts) < ntz_literal(_bucket_edge(end, interval, up=True)))
    c = f.groupBy(bucket_index(ts, interval).alias("bucket")).agg(F.count(F.lit(1)).alias("value"))
    return c.select(bucket_start("bucket", interval).alias("ts"), "value")


def series_counts(counts: DataFrame, key_value, interval, start=None, end=None, key: str = "series_key") -> DataFrame:
    """One key's bucket counts with bucket start in ``[floor(start), end]``, ascending. Of a table stored by date
    (:func:`fathom.sources.stores.write_dated`) only the dates of that range are opened."""
    c = within_dates(counts.where(F.col(key) == F.lit(key_value)), None if start is None else _bucket_edge(start, interval), end)
    if start is not None:
        c = c.where(F.col("bucket") >= F.lit(_bucket_of_literal(start, interval)))
    out = c.select(bucket_start("bucket", interval).alias("ts"), F.col("n").alias("value"))
    if end is not None:
        out = out.where(F.col("ts") <= ntz_literal(end))
    return out.orderBy("ts")


def within_dates(stored: DataFrame, start=None, end=None) -> DataFrame:
    """The dates from ``start``'s to ``end``'s (either may be open) of a table with a ``date`` column; others as they are."""
    if "date" in stored.columns:
        if start is not None:
            stored = stored.where(F.col("date") >= F.to_date(ntz_literal(start)))
        if end is not None:
            stored = stored.where(F.col("date") <= F.to_date(ntz_literal(end)))
    return stored


def zero_filled(spark: SparkSession, observed: DataFrame, start, end, interval) -> DataFrame:
    """N12 grid: ``floor((end - start) / interval)`` points from ``floor(start)``,
    each 0 unless observed, plus every observed point in ``[floor(start), end]``.
    ``observed`` has ``bucket, value``. The grid comes from ``spark.range`` so
    it is generated in parallel."""
    import datetime as dt

    s = dt.datetime.fromisoformat(str(start))
    e = dt.datetime.fromisoformat(str(end))
    d = micros_of(interval)
    npoints = ((e - s) // dt.timedelta(microseconds=1)) // d
    b0 = _bucket_of_literal(start, interval)
    grid = spark.range(0, max(npoints, 0)).select((F.col("id") + F.lit(b0)).alias("bucket"))
    obs = observed.where(F.col("bucket") >= F.lit(b0))
    obs = obs.where(bucket_start("bucket", interval) <= ntz_literal(end))
    j = grid.join(obs, "bucket", "full_outer")
    return j.select(bucket_start("bucket", interval).alias("ts"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def sliding_top(df: DataFrame, value_col: str = "src", ts: str = "ts", width="10 minutes", slide="1 minute",
                limit: int = 10, start=None) -> DataFrame:
    """Every row counts in each ``width`` window (starts aligned to
    ``slide``) that covers it; per window the top ``limit`` values by count
    desc, value asc. Null values are skipped. With ``start`` only the window
    that starts at ``floor(start, slide)``.

    Rows are first counted per (value, slide unit) - a partial aggregate - and
    only those counts are spread over the ``width / slide`` windows, so the
    expansion never touches raw rows. The per-window rank uses a row_number
    filter, which Spark turns into a group limit before the shuffle.
    """
    wu, su = micros_of(width), micros_of(slide)
    if wu % su:
        raise ValueError("width must be a multiple of slide")
    m = wu // su
    f = ensure_ntz(df, ts).where(F.col(value_col).isNotNull())
    if start is not None:  # one window reads its own rows only
        import datetime as dt

        first = _bucket_edge(start, slide)
        f = f.where((F.col(ts) >= ntz_literal(first)) & (F.col(ts) < ntz_literal(first + dt.timedelta(microseconds=wu))))
    pre = f.groupBy(F.col(value_col).alias("value"), bucket_index(ts, slide).alias("u")).agg(F.count(F.lit(1)).alias("c"))
    spread = pre.select("value", "c", "u", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("d")) \
        .select("value", "c", (F.col("u") - F.col("d")).alias("ws"))
    if start is not None:
        spread = spread.where(F.col("ws") == F.lit(_bucket_of_literal(start, slide)))
    counts = spread.groupBy("ws", "value").agg(F.sum("c").alias("count"))
    w = Window.partitionBy("ws").orderBy(F.col("count").desc(), F.col("value").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select(bucket_start("ws", slide).alias("window_start"), "value", "count", "rank")
