"""The packet analysis as a stream: raw lines -> facts -> categories -> fan-out -> closed counts -> anomalies, and what
is kept per source and per anomaly behind it.

* :func:`packet_counts` is one streaming query with one stateful step (bucket counts); the category bounds are read
  when the query starts, so every restart (each ``availableNow`` run) takes up the newest ones;
* :func:`fathom.streaming.streams.stream_anomalies` is the second step: it decides on the closed buckets;
* :func:`decayed_categories` keeps the histograms from which bounds follow: decayed weights on a fixed grid, tested
  for skew every ``half_life`` points and cut anew only where the test fails;
* :func:`distinct_anomalies` drops anomalies that an at-least-once source delivers again;
* :func:`unique_sources` counts a source at a time only if it was last seen before that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.stats import chi2_critical
from fathom.functions.time import bucket_start, epoch_us, from_epoch_us, micros_of
from fathom.operators import facts as FA
from fathom.session import scratch_path
from fathom.streaming.streams import event_time, run_available_now


def _seconds(interval) -> str:
    return f"{micros_of(interval) // 1_000_000} seconds"


# --- bounds ------------------------------------------------------------------

BOUNDS = "version long, field string, bounds array<double>"


def write_bounds(spark: SparkSession, path: str, bounds: dict[str, list[float]], version: int) -> None:
    """One row per field. A version is written whole and never changed; readers take the newest."""
    rows = [(version, f, [float(x) for x in b]) for f, b in bounds.items()]
    spark.createDataFrame(rows, BOUNDS).coalesce(1).drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def read_bounds(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """The newest bounds: a few numbers per field, whatever the stream's size."""
    table = spark.read.schema(BOUNDS).parquet(path)
    newest = table.agg(F.max("version")).first()[0]
    return {r["field"]: list(r["bounds"]) for r in table.where(F.col("version") == F.lit(newest)).collect()}


def packet_counts(bodies: DataFrame, bounds: dict[str, list[float]], interval, watermark, required=("src",), max_size: int = 2,
                  labels=FA.CATEGORIES) -> DataFrame:
    """N1 -> N3 -> N6 -> N7 on a stream of ``ts, body``: ``series_key, src, bucket, n`` of closed buckets. A field
    without bounds is removed, as it is before there are enough points.

    As in :func:`fathom.operators.facts.fanned_counts` facts are counted first: the state has one row per bucket and
    combination of dimensions, and what leaves it is fanned out. A series has a row per combination that it covers; all
    of a bucket leave in the micro-batch that closes it, and their ``n`` add up
    (:func:`fathom.streaming.streams.stream_anomalies` sums them)."""
    facts = event_time(FA.parse_facts(bodies)).withWatermark("event_time", _seconds(watermark))
    facts = FA.label_numbers(facts, bounds, labels)
    w = F.window("event_time", _seconds(interval)).alias("w")
    counts = facts.groupBy(F.sort_array(F.map_entries("dims")).alias("_e"), w).agg(F.count(F.lit(1)).alias("n"))
    bucket = (F.unix_micros(F.col("w.start")) / F.lit(micros_of(interval))).cast("long").alias("bucket")
    closed = counts.select(F.map_from_entries("_e").alias("dims"), bucket, "n")
    fanned = FA.fanout_dimensions(closed, required, max_size, keep=("bucket", "n"))
    return fanned.select("series_key", F.col("dims").getItem("src").alias("src"), "bucket", "n")


# --- N4, N5: histograms that decay by the number of points --------------------

# kind: 'bounds' (in force for the points of a block; with the test at its end), 'state' (points so far and bounds),
# 'hist' and 'part' (weights per bin at the end of the last whole block, and of the open one)
STATE = "field string, kind string, block long, bin long, w double, n long, bounds array<double>, chi2 double, skewed boolean"


def cut_bounds(bins: np.ndarray, w: np.ndarray, k: int, width: float) -> list[float]:
    """Upper edges of the first bins (ascending) at which the cumulated weight reaches 1/k, 2/k ... of the total."""
    cum = np.cumsum(w)
    return [float((bins[np.argmax(cum * k >= cum[-1] * (i + 1))] + 1) * width) for i in range(k - 1)]


def between(bins: np.ndarray, bounds: list[float], width: float) -> np.ndarray:
    """Number of the part between the bounds that each bin is in."""
    return np.searchsorted(np.array(bounds), (bins + 0.5) * width, "right")


def skew(part: np.ndarray, w: np.ndarray, k: int) -> float:
    """Chi-square statistic of the weights in the ``k`` parts against equal weights."""
    seen = np.bincount(part, w, minlength=k)
    e = seen.sum() / k
    return float(((seen - e) ** 2 / e).sum())


def _advance(field: str, old: pd.DataFrame, new: pd.DataFrame, half_life: int, k: int, width: float, min_points: int, critical: float) -> list[tuple]:
    """The state of one field after the blocks of a micro-batch, and the bounds in force in each of them. The weights are
    arrays over all bins that occur; a bin without a point yet weighs nothing and changes no sum."""
    state = old[old.kind == "state"]
    n = int(state.n.iloc[0]) if len(state) else 0
    bounds = list(state.bounds.iloc[0]) if len(state) and state.bounds.iloc[0] is not None else []
    kept = {kind: (g.bin.to_numpy().astype(np.int64), g.w.to_numpy().astype(np.float64)) for kind in ("hist", "part") for g in [old[old.kind == kind]]}
    order = np.argsort(new.block.to_numpy(), kind="stable")
    block_of, bin_of, w_of = (new[c].to_numpy()[order] for c in ("block", "bin", "w"))
    bins = np.unique(np.concatenate([kept["hist"][0], kept["part"][0], bin_of.astype(np.int64)]))
    place = np.searchsorted(bins, bin_of)
    done, upto = n // half_life, n + int(new.c.sum())
    last = upto // half_life
    edges = np.searchsorted(block_of, np.arange(done, last + 2))
    hist, part = np.zeros(len(bins)), np.zeros(len(bins))
    seen, opened = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
    for (b, w), weights, mark in ((kept["hist"], hist, seen), (kept["part"], part, opened)):
        at = np.searchsorted(bins, b)
        weights[at], mark[at] = w, True
    cells = between(bins, bounds, width) if bounds else None
    out = []
    for block in range(done, last + 1):
        mine = slice(edges[block - done], edges[block - done + 1])
        at = place[mine]  # a bin occurs once per block
        part[at] += w_of[mine]
        opened[at] = True
        if block == last:  # still open
            out.append((field, "bounds", block, None, None, None, bounds or None, None, None))
            break
        hist *= 0.5
        hist += part
        seen |= opened
        if block == done:
            part[:], opened[:] = 0.0, False
        else:
            part[at], opened[at] = 0.0, False
        chi2 = skew(cells, hist, k) if bounds else None
        out.append((field, "bounds", block, None, None, None, bounds or None, chi2, None if chi2 is None else chi2 > critical))
        if (block + 1) * half_life >= min_points and (not bounds or chi2 > critical):
            bounds = cut_bounds(bins, hist, k, width)
            cells = between(bins, bounds, width)
    out.append((field, "state", None, None, None, upto, bounds or None, None, None))
    for kind, weights, mark in (("hist", hist, seen), ("part", part, opened)):
        out += [(field, kind, None, b, w, None, None, None, None) for b, w in zip(bins[mark].tolist(), weights[mark].tolist())]
    return out


def _placed(facts: DataFrame, fields: list[str], dims: str) -> DataFrame:
    """``facts`` with ``_v{i}`` (number of field i or null) and ``_r{i}`` (how many facts up to and with this one have it),
    in the order of ts and dimensions. Sorted by ranges, so every task ranks its own part of the order; the parts'
    counts, one row per task, give what lies before each."""
    spark = facts.sparkSession
    path = scratch_path(spark, "ordered")
    f = facts.withColumn("_entries", F.sort_array(F.map_entries(dims)))
    for i, name in enumerate(fields):
        v = FA._numeric(dims, name)
        f = f.withColumn(f"_v{i}", F.when(F.abs(v) < F.lit(float("inf")), v))
    f.repartitionByRange("ts", "_entries").sortWithinPartitions("ts", "_entries").drop("_entries") \
        .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    f = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = f.groupBy("_part").agg(*[F.count(f"_v{i}").alias(f"_c{i}") for i in range(len(fields))])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *[F.coalesce(F.sum(f"_c{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(fields))])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    f = f.select("*", *[F.count(f"_v{i}").over(inside).alias(f"_r{i}") for i in range(len(fields))])
    f = f.join(F.broadcast(offsets), "_part")  # one row per task that wrote
    return f.select(*facts.columns, *[f"_v{i}" for i in range(len(fields))], *[(F.col(f"_r{i}") + F.col(f"_o{i}")).alias(f"_r{i}") for i in range(len(fields))])


def decayed_step(facts: DataFrame, old: DataFrame, out_path: str, state_path: str, fields: list[str], half_life: int, width: float,
                 min_points: int = 900, labels=FA.CATEGORIES, dims: str = "dims", broadcast_rows: int = 100_000) -> None:
    """One micro-batch of :func:`decayed_categories`: ``old`` is the state before it."""
    spark, k = facts.sparkSession, len(labels)
    placed = _placed(facts, fields, dims)
    n0 = old.where("kind = 'state'").select("field", F.col("n").alias("n0"))
    known = {r["field"]: r["n0"] for r in n0.collect()}
    for i, name in enumerate(fields):
        at = F.col(f"_r{i}") + F.lit(known.get(name, 0) - 1)
        placed = placed.withColumn(f"_b{i}", F.when(F.col(f"_v{i}").isNotNull(), F.floor(at / half_life))) \
            .withColumn(f"_p{i}", F.pmod(at, F.lit(half_life)))
    path = scratch_path(spark, "placed")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    points = placed.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"_b{i}").alias("block"), F.col(f"_v{i}").alias("v"),
                                                       F.col(f"_p{i}").alias("p")) for i, name in enumerate(fields)]))).where("v is not null")
    # a point's weight at the end of its block: halved once per half-life that passes in points
    weight = F.pow(F.lit(2.0), (F.col("p") - (half_life - 1)) / F.lit(float(half_life)))
    hist = points.groupBy("field", "block", F.floor(F.col("v") / width).cast("long").alias("bin")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("c"))
    critical = chi2_critical(k - 1)
    every = spark.createDataFrame([(f,) for f in fields], "field string")

    def run(key, before: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        return pd.DataFrame(_advance(key[0], before, now, half_life, k, width, min_points, critical), columns=names, dtype=object)

    # per field: blocks x bins weights, sums over the points
    both = every.join(old, "field", "left").groupBy("field").cogroup(hist.groupBy("field"))
    both.applyInPandas(run, STATE).write.mode("overwrite").parquet(state_path)
    bounds = spark.read.schema(STATE).parquet(state_path).where("kind = 'bounds'").select("field", "block", "bounds")
    small = bounds.count() <= broadcast_rows
    for i, name in enumerate(fields):
        mine = bounds.where(F.col("field") == F.lit(name)).select(F.col("block").alias(f"_b{i}"), F.col("bounds").alias(f"_x{i}"))
        placed = placed.join(F.broadcast(mine) if small else mine, f"_b{i}", "left")  # a block holds half_life points at most
        lab = F.lit(labels[-1])
        for j in reversed(range(k - 1)):
            lab = F.when(F.col(f"_v{i}") < F.col(f"_x{i}")[j], F.lit(labels[j])).otherwise(lab)
        new = F.when(F.col(f"_v{i}").isNull() | F.col(f"_x{i}").isNull(), F.lit(None)).otherwise(lab)
        placed = placed.withColumn(dims, F.map_filter(FA._rewrite(F.col(dims), name, new), lambda _, v: v.isNotNull()))
    placed.select(*facts.columns).write.mode("overwrite").parquet(out_path)


def decayed_categories(bodies: DataFrame, out_path: str, state_path: str, checkpoint: str, fields=("rl", "rs"), half_life: int = 100,
                       width: float = 1.0, min_points: int = 900, labels=FA.CATEGORIES, name: str = "decayed") -> None:
    """N4 and N5 on a stream of ``ts, body``: every numeric field has a histogram on a grid of ``width`` whose weights
    halve with every ``half_life`` points of the field. After each ``half_life`` points (a block) the weights between the
    current bounds are tested against equal ones; only if they differ at the 5 % level, or there are no bounds yet and
    ``min_points`` were seen, the bounds are cut anew. A point takes the bounds in force when its block began; before
    the first bounds its field is removed. Order: micro-batch, then ts and dimensions.

    Facts go to ``out_path``, the state (weights, bounds, and the tests per block) to ``state_path``, both per micro-batch;
    a micro-batch starts from its predecessor's state, so a replay writes the same rows again. Weights of a block are
    sums that merge, so they come from one aggregation; only blocks x bins of a micro-batch go through one task per
    field, which is what decides on the bounds one block after the other."""
    fields = list(fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            old = spark.read.schema(STATE).parquet(f"{state_path}/batch={batch_id - 1}").where("kind <> 'bounds'")
        else:
            old = spark.createDataFrame([], STATE)
        decayed_step(FA.parse_facts(batch), old, f"{out_path}/batch={batch_id}", f"{state_path}/batch={batch_id}", fields, half_life, width, min_points, labels)

    run_available_now(bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), name)


def read_skew(spark: SparkSession, state_path: str) -> DataFrame:
    """The tests of all whole blocks: ``field, block, bounds, chi2, skewed``."""
    return spark.read.schema(STATE + ", batch long").parquet(state_path).where("kind = 'bounds' AND chi2 IS NOT NULL") \
        .select("field", "block", "bounds", "chi2", "skewed")


# --- N9, N14: behind the detection --------------------------------------------

def distinct_anomalies(anomalies: DataFrame, interval, watermark) -> DataFrame:
    """N9 on a stream of anomalies ``series_key, bucket, ...`` that may come twice (a source that delivers at least once,
    a rewritten micro-batch): each (series, bucket) once, with state for the time of the watermark only. A repeat
    that comes later than the watermark allows is dropped as late."""
    a = event_time(anomalies.withColumn("_ts", bucket_start("bucket", interval)), "_ts").drop("_ts")
    return a.withWatermark("event_time", _seconds(watermark)).dropDuplicatesWithinWatermark(["series_key", "bucket"])


def unique_sources(anomalies: DataFrame, watermark, keep="0 seconds", src: str = "src", ts: str = "ts", arrival: str = "arrival", groups: int = 16_384) -> DataFrame:
    """N14 with its last-seen rule on a stream of ``src, ts, arrival``: ``src, ts`` of every anomaly whose source was
    not seen at ``ts`` or later, in the order of micro-batch and ``arrival`` (any long). What comes out of order is lost,
    as in the rule. State: one time per source. It is dropped when the watermark has passed it by ``keep``; a row that
    comes after that is either late, or later than the dropped time and counts with or without the state. Rows
    without a source are left out.

    Sources are dealt by hash to ``groups`` state rows, because a call of the rule costs far more than a source in it;
    a row holds the times of its sources and goes when the last one does. ``groups`` belongs to the checkpoint."""
    s = anomalies.where(F.col(src).isNotNull() & F.col(ts).isNotNull()).select(F.col(src).alias("src"), F.col(ts).alias("ts"), F.col(arrival).alias("arrival"))
    s = event_time(s).withColumn("us", epoch_us("ts")).drop("ts").withWatermark("event_time", _seconds(watermark))
    keep_ms = micros_of(keep) // 1000
    ends = lambda us: us // 1000 + 1 + keep_ms

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            names, arrived, us = (np.concatenate(c) for c in zip(*((b["src"].to_numpy(), b["arrival"].to_numpy(), b["us"].to_numpy()) for b in batches)))
            who, names = pd.factorize(names)
            order = np.lexsort((arrived, who))
            who, us = who[order], us[order]
            start = np.array([last.get(x, np.iinfo(np.int64).min) for x in names], np.int64)
            seen = np.maximum(pd.Series(us).groupby(who).cummax().to_numpy(), start[who])  # up to and with each row
            first = np.append(True, who[1:] != who[:-1])
            counted = us > np.where(first, start[who], np.append(us[:1], seen[:-1]))
            last.update(zip(names, seen[np.append(first[1:], True)].tolist()))
            if counted.any():
                yield pd.DataFrame({"src": names[who[counted]], "us": us[counted]})
        last = {x: t for x, t in last.items() if ends(t) >= now}
        if not last:
            state.remove()
            return
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max(ends(min(last.values())), now + 1))

    s = s.withColumn("_group", F.pmod(F.xxhash64("src"), F.lit(groups)))
    out = s.groupBy("_group").applyInPandasWithState(count, "src string, us long", "srcs array<string>, lasts array<long>", "append", "EventTimeTimeout")
    return out.select("src", from_epoch_us("us").alias("ts"))


def stream_unique_sources(anomalies: DataFrame, out_path: str, checkpoint: str, watermark, keep="0 seconds", name: str = "unique_sources", **columns):
    """Counters of :func:`unique_sources` per time, added per micro-batch; :func:`read_unique_sources` sums them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    sightings = unique_sources(anomalies, watermark, keep, **columns)
    return run_available_now(sightings.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint), name)


def read_unique_sources(spark: SparkSession, out_path: str) -> DataFrame:
    """``ts, value``: sources first seen at or after each time."""
    t = spark.read.schema("ts timestamp_ntz, n long, batch long").parquet(out_path)
    return t.groupBy("ts").agg(F.sum("n").cast("long").alias("value"))
