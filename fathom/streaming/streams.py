"""Structured Streaming forms of the counting operators.

* counts that only grow (page views, sentiment totals) are aggregated per
  micro-batch and added to a counter store keyed by batch id, so a replayed
  batch replaces its own rows instead of doubling them (``foreachBatch``);
* bucket counts use an event-time watermark and ``append`` mode: a bucket is
  written once, when the watermark has passed its end; later events for it
  are dropped and show up in the query's progress metrics;
* anomaly detection runs per micro-batch on the closed buckets: they are
  appended to the counts table, the previous ``lookback`` buckets of the
  touched keys are read back, and the batch rule
  (:func:`fathom.operators.anomaly.anomaly_flags`) decides.

Output tables live under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.time import bucket_start, epoch_us, micros_of
from fathom.operators import anomaly as A
from fathom.session import scratch_path
from fathom.sources.stores import CounterStore


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Zone-aware event time for watermarks from a UTC ``TIMESTAMP_NTZ`` column."""
    return df.withColumn(out, F.timestamp_micros(epoch_us(ts)))


def run_available_now(writer, name: str):
    """Start a ``DataStreamWriter`` with the availableNow trigger, wait, and return the ended query (its progress)."""
    q = writer.trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def stream_counter_store(stream: DataFrame, keys: list[str], store_path: str, checkpoint: str,
                         name: str = "counters") -> None:
    """Aggregate each micro-batch by ``keys`` and append it to ``store_path``
    keyed by ``batch`` (its batch id); see :func:`read_counter_totals`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(batch_id))
        # a replayed batch id overwrites its own partition only
        delta.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    run_available_now(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), name)


def stream_compacted_counters(stream: DataFrame, store: CounterStore, checkpoint: str, compact_every: int = 100, name: str = "counters") -> None:
    """:func:`stream_counter_store` into a store of bounded size: every ``compact_every`` batches, those before the
    current one are folded into its snapshot. Each micro-batch adds under its id, so a replay changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.add(batch_id, batch.groupBy(*store.keys).agg(F.count(F.lit(1)).alias(store.values[0])))
        if batch_id and batch_id % compact_every == 0:
            store.compact(batch_id - 1)

    run_available_now(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), name)


def read_counter_totals(spark: SparkSession, store_path: str, keys: list[str], types: list[str] | None = None) -> DataFrame:
    """Totals of a store; ``types`` of the keys (string unless given) let a store without rows be read, too."""
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, types or ["string"] * len(keys)))
    return spark.read.schema(f"{schema}, n bigint, batch bigint").parquet(store_path).groupBy(*keys).agg(F.sum("n").cast("long").alias("n"))


def stream_interval_counts(stream: DataFrame, key: str, interval, watermark, ts: str = "ts") -> DataFrame:
    """Streaming N7: closed (key, bucket) counts in append mode."""
    d = micros_of(interval)
    s = event_time(stream, ts).withWatermark("event_time", f"{micros_of(watermark) // 1_000_000} seconds")
    g = s.groupBy(F.col(key).alias("series_key"), F.window("event_time", f"{d // 1_000_000} seconds").alias("w"))
    c = g.agg(F.count(F.lit(1)).alias("n"))
    return c.select("series_key", (F.unix_micros(F.col("w.start")) / F.lit(d)).cast("long").alias("bucket"), "n")


def stream_traffic_counts(stream: DataFrame, interval, watermark, ts: str = "ts") -> DataFrame:
    """Streaming N15: events per closed bucket, ``bucket, value``."""
    one = stream.withColumn("_all", F.lit("all"))
    return stream_interval_counts(one, "_all", interval, watermark, ts).select("bucket", F.col("n").alias("value"))


def stream_anomalies(counts_stream: DataFrame, counts_path: str, anomalies_path: str, checkpoint: str, interval,
                     lookback: int = 10, mean_threshold: float = 2.0, sensitivity: float = 2.0,
                     counters_path: str | None = None, name: str = "anomalies", carry: tuple[str, ...] = ()) -> None:
    """Streaming N8/N9 over closed bucket counts (see module docstring). The counts table is partitioned by date, and
    a batch reads back only the dates that its own buckets and their ``lookback`` touch. With ``counters_path``,
    the anomalous series per bucket (N12) are kept as counters, too: a (series, bucket) closes once, so the sum
    over batches counts distinct series. ``carry`` names string columns that depend on the series alone and go on
    with its anomalies. Rows of a (series, bucket) add up; all of them come in the micro-batch that closes the bucket. All
    writes are keyed by batch id; a replay rewrites the same rows.

    The sums are written, then read back. Only series with a count in the batch that could be flagged at all
    (:func:`fathom.operators.anomaly.could_flag`) meet their history."""

    def dated(df: DataFrame) -> DataFrame:
        return df.withColumn("date", F.to_date(bucket_start("bucket", interval)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{counts_path}/batch={batch_id}"
        sums = batch.groupBy("series_key", "bucket").agg(F.sum("n").cast("long").alias("n"), *[F.first(c).alias(c) for c in carry])
        dated(sums).hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(mine)
        row = "series_key string, bucket bigint, n bigint"
        batch = spark.read.schema(row + "".join(f", {c} string" for c in carry) + ", date date").parquet(mine).drop("date")
        edge = batch.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
        if edge["lo"] is None:
            return
        day = lambda b: F.to_date(bucket_start(F.lit(b), interval))
        some = batch.where(A.could_flag(F.col("n"), mean_threshold, sensitivity))
        span = some.groupBy("series_key").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        hist = spark.read.schema(f"{row}, batch bigint, date date").parquet(counts_path)
        hist = hist.where((F.col("date") >= day(edge["lo"] - lookback)) & (F.col("date") <= day(edge["hi"])))
        # rows of a later batch id are of a run that failed after writing them
        hist = hist.where(F.col("batch") <= batch_id).join(span, "series_key") \
            .where((F.col("bucket") >= F.col("lo") - lookback) & (F.col("bucket") <= F.col("hi"))) \
            .select("series_key", "bucket", "n")
        flags = A.anomaly_flags(hist, lookback, mean_threshold, sensitivity).where("flag")
        found = some.join(flags.select("series_key", "bucket"), ["series_key", "bucket"], "left_semi")
        out = f"{anomalies_path}/batch={batch_id}"
        dated(found).hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(out)
        if counters_path:
            found = spark.read.schema("bucket bigint, date date").parquet(out)
            found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counters_path}/batch={batch_id}")

    run_available_now(counts_stream.writeStream.outputMode("append").foreachBatch(write)
                      .option("checkpointLocation", checkpoint), name)


def read_anomalies(spark: SparkSession, anomalies_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The streamed anomalies as the batch queries take them: ``series_key, bucket, n, date``."""
    extra = "".join(f", {c} string" for c in carry)
    return spark.read.schema(f"series_key string, bucket bigint, n bigint{extra}, batch bigint, date date").parquet(anomalies_path).drop("batch")


def fresh_paths(spark: SparkSession, name: str) -> dict:
    base = scratch_path(spark, name)
    return {"out": f"{base}/out", "aux": f"{base}/aux", "ckpt": f"{base}/ckpt"}


def stream_sliding_top(stream: DataFrame, value_col: str, width, slide, limit: int, watermark, out_path: str,
                       checkpoint: str, ts: str = "ts", name: str = "sliding_top") -> None:
    """Streaming N17: sliding-window counts per value with a watermark; each micro-batch ranks the windows that it
    closes and writes their top ``limit`` keyed by batch id. A window closes once, when the latest event so far is
    ``watermark`` past its end; a late row counts in those of its windows that were open before its micro-batch.

    What is kept is a row per value and unit of time (the largest that divides width and slide), not one per value and
    window: a micro-batch appends its counts to ``<out_path>-units``, with the first window that was open to them, and its
    latest event to ``<out_path>-edges``. Closing windows read the units that they cover back, by date; a value's units are
    dealt to one task and spread over the windows there. All writes are keyed by batch id; a replay rewrites the same rows."""
    from math import gcd

    from pyspark.sql import Window

    wide, step, delay = micros_of(width), micros_of(slide), micros_of(watermark) // 1_000_000 * 1_000_000
    size = gcd(wide, step)
    unit, kind = f"{size} microseconds", stream.schema[value_col].dataType.simpleString()
    units, edges = f"{out_path}-units", f"{out_path}-edges"
    down = lambda x, n: ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")  # noqa: E731  x / n, rounded down

    def first_open(edge: int | None) -> int:
        """The first window that is open after events up to ``edge``, milliseconds; watermarks start at 0."""
        return (max(0, 0 if edge is None else edge * 1000 - delay) - wide) // step + 1

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max(down(epoch_us(ts), 1000)).alias("edge")).write.mode("overwrite").parquet(f"{edges}/batch={batch_id}")
        # rows of a later batch id are of a run that failed after writing them
        seen = spark.read.schema("edge bigint, batch bigint").parquet(edges).where(F.col("batch") <= batch_id)
        edge = seen.agg(F.max(F.when(F.col("batch") < batch_id, F.col("edge"))).alias("before"), F.max("edge").alias("now")).first()
        low, high = first_open(edge["before"]), first_open(edge["now"])  # windows from low and before high close now
        counts = batch.groupBy(F.col(value_col).alias("value"), down(epoch_us(ts), size).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
        dated = counts.withColumn("open", F.lit(low).cast("long")).withColumn("date", F.to_date(bucket_start("unit", unit)))
        dated.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{units}/batch={batch_id}")

        day = lambda micros: F.to_date(bucket_start(F.lit(micros // size), unit))
        kept = spark.read.schema(f"value {kind}, unit bigint, n bigint, open bigint, batch bigint, date date").parquet(units)
        kept = kept.where((F.col("batch") <= batch_id) & (F.col("date") >= day(low * step)) & (F.col("date") <= day(high * step + wide)))
        start = F.col("unit") * F.lit(size)
        first = F.greatest(-down(F.lit(wide - size) - start, step), F.col("open"), F.lit(low))
        last = F.least(down(start, step), F.lit(high - 1))
        mine = kept.select("value", "n", first.alias("first"), last.alias("last")).where("first <= last").repartition("value")
        spread = mine.select("value", "n", F.explode(F.sequence("first", "last")).alias("w"))
        sums = spread.groupBy("value", "w").agg(F.sum("n").cast("long").alias("count"))
        r = Window.partitionBy("w").orderBy(F.col("count").desc(), F.col("value").asc())
        top = sums.withColumn("rank", F.row_number().over(r).cast("long")).where(F.col("rank") <= limit)
        top.select(bucket_start("w", slide).alias("window_start"), "value", "count", "rank") \
            .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    rows = stream.where(F.col(value_col).isNotNull() & F.col(ts).isNotNull()).select(value_col, ts)
    run_available_now(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), name)


def stream_sentiment_series(scored_stream: DataFrame, out_path: str, checkpoint: str, name: str = "series") -> None:
    """Streaming T9: append ``id, sentiment, ts, text`` to a parquet table
    partitioned by sentiment and date, so the recent-window reads (T10, T11)
    prune to the partitions they need. The file sink is exactly-once."""
    s = scored_stream.select("id", "sentiment", "ts", "text").withColumn("date", F.to_date("ts"))
    run_available_now(s.writeStream.format("parquet").option("path", out_path)
                      .option("checkpointLocation", checkpoint).partitionBy("sentiment", "date"), name)
