"""Packet facts (N1-N6): parsing, series keys, numeric categories, fan-out.

A *fact* frame has ``ts TIMESTAMP_NTZ`` and ``dims MAP<STRING,STRING>``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.maps import entries_key, index_subsets_fast, series_key
from fathom.functions.stats import chi2_critical
from fathom.functions.time import bucket_index, ensure_ntz
from fathom.session import scratch_path

# Category names of the numeric dimensions, lowest first.
CATEGORIES = ("low", "medium", "high")


def _lines(bodies: DataFrame, body_col: str, ts_col: str) -> DataFrame:
    """One row per non-blank line with its parsed map. The parse happens inside
    the generator, so Catalyst cannot copy ``from_json`` into pushed-down
    filters: every line is parsed exactly once."""
    b = ensure_ntz(bodies, ts_col)
    lines = F.filter(F.split(F.col(body_col), r"\r?\n"), lambda l: F.length(F.trim(l)) > 0)
    parsed = F.transform(lines, lambda l: F.struct(l.alias("line"), F.from_json(l, "map<string,string>").alias("dims")))
    return b.select(ts_col, F.inline(parsed))


def parse_facts(bodies: DataFrame, body_col: str = "body", ts_col: str = "ts") -> DataFrame:
    """Every non-blank line of a body is a JSON object (single quotes
    allowed) -> ``ts, dims``. Keys with null values are dropped; lines that are
    not JSON objects go to :func:`fact_rejects`."""
    lines = _lines(bodies, body_col, ts_col).where(F.col("dims").isNotNull())
    return lines.select(F.col(ts_col).alias("ts"), F.map_filter("dims", lambda k, v: v.isNotNull()).alias("dims"))


def fact_rejects(bodies: DataFrame, body_col: str = "body", ts_col: str = "ts") -> DataFrame:
    return _lines(bodies, body_col, ts_col).where(F.col("dims").isNull()).select(ts_col, "line")


def with_series_key(facts: DataFrame, dims: str = "dims") -> DataFrame:
    """Adds ``series_key`` (see :func:`fathom.functions.maps.series_key`);
    kept as is when the fan-out already produced it."""
    if "series_key" in facts.columns:
        return facts
    return facts.withColumn("series_key", series_key(dims))


def _numeric(dims: str, field: str):
    return F.expr(f"try_cast(`{dims}`['{field}'] AS DOUBLE)")


def _label(v, bounds: list[float], labels) -> F.Column:
    e = F.lit(labels[-1])
    for b, lab in reversed(list(zip(bounds, labels[:-1]))):
        e = F.when(v < F.lit(b), F.lit(lab)).otherwise(e)
    return e


def _rewrite(dims_col: F.Column, field: str, new_value: F.Column | None) -> F.Column:
    """Replace (or, with None, remove) one key of a map column."""
    kept = F.map_filter(dims_col, lambda k, v: k != F.lit(field))
    if new_value is None:
        return kept
    return F.when(dims_col.getItem(field).isNull(), dims_col).otherwise(
        F.map_concat(kept, F.create_map(F.lit(field), new_value)))


SHIFTS = (54, 44, 34, 24, 14, 4, 0)  # bits of a key that a pass leaves open: 10 fewer with every pass


def order_key(value) -> F.Column:
    """64-bit integer of a double, in the doubles' order: the bits of a number that is not negative, and for negative ones
    the other bits turned over."""
    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        x = v.to_numpy(np.float64).view(np.int64)
        return pd.Series(np.where(x < 0, x ^ np.int64(0x7FFFFFFFFFFFFFFF), x))

    return bits(value)


def order_statistics(counts: DataFrame, ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """Exact values at 1-based ranks of several multisets at once. ``counts``: a stored table ``field, value, key, c`` of
    the distinct values of each field, their :func:`order_key` and how often they occur; ``ranks``: those asked for, by
    field. Returns ``{(field, rank): value}``.

    All ranks of all fields are narrowed together: a pass counts, below the key prefixes that still hold a rank, the
    1,024 prefixes that are 10 bits longer. A prefix has no empty or infinite width whatever the values are, so seven
    passes settle 64 bits, and a rank is settled earlier when one value is left under its prefix. The driver sees at
    most 1,024 rows per open rank and pass; no task gathers a field's values."""
    out: dict[tuple[int, int], float] = {}
    open_ranks = {(f, r): (None, 0) for f, rs in ranks.items() for r in rs}  # prefix, points below it
    before = 64
    for shift in SHIFTS:
        if not open_ranks:
            break
        bin_ = F.shiftright("key", shift)
        where = F.lit(False)
        for field, prefix in {(f, p) for (f, _), (p, _) in open_ranks.items()}:
            mine = F.col("field") == F.lit(field)
            where = where | (mine if prefix is None else mine & (F.shiftright("key", before) == F.lit(prefix)))
        found: dict[tuple, list] = {}
        rows = counts.where(where).groupBy("field", bin_.alias("bin")).agg(F.sum("c").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        for r in sorted(rows.collect(), key=lambda r: r["bin"]):
            found.setdefault((r["field"], None if before == 64 else r["bin"] >> (before - shift)), []).append(r)
        left = {}
        for (field, rank), (prefix, below) in open_ranks.items():
            for r in found[field, prefix]:
                if below + r["c"] >= rank:
                    break
                below += r["c"]
            if r["lo"] == r["hi"]:
                out[field, rank] = r["lo"]
            else:
                left[field, rank] = (r["bin"], below)
        open_ranks, before = left, shift
    return out


def tertile_bounds_all(facts: DataFrame, fields, k: int = 3, dims: str = "dims") -> dict:
    """Exact equal-mass bounds for several numeric dimensions: one pass over the facts stores the count of every
    distinct value of every field, all else works on that table. Bound i is the midpoint of the order statistics
    at ranks ``floor((i+1) n / k)`` and the next one. Returns ``{field: (n, bounds)}``."""
    spark = facts.sparkSession
    fields = list(fields)
    if not fields:
        return {}
    values = F.array(*[F.struct(F.lit(i).alias("field"), _numeric(dims, f).alias("value")) for i, f in enumerate(fields)])
    path = scratch_path(spark, "values")
    rows = facts.select(F.inline(values)).where("abs(value) < double('Infinity')")
    rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("key", order_key("value")).write.parquet(path)
    counts = spark.read.parquet(path)
    ns = {r["field"]: r["n"] for r in counts.groupBy("field").agg(F.sum("c").alias("n")).collect()}
    # per bound the ranks on its two sides
    sides = {i: [(max(off, 1), min(off + 1, n)) for j in range(k - 1) for off in [(j + 1) * n // k]] for i, n in ns.items()}
    v = order_statistics(counts, {i: sorted({r for pair in s for r in pair}) for i, s in sides.items()})
    # halves are added, so that the sum of two large values stays finite
    return {f: (ns.get(i, 0), [v[i, lo] / 2.0 + v[i, hi] / 2.0 if abs(v[i, lo]) > 1e300 or abs(v[i, hi]) > 1e300 else (v[i, lo] + v[i, hi]) / 2.0
                               for lo, hi in sides.get(i, [])]) for i, f in enumerate(fields)}


def tertile_bounds(facts: DataFrame, field: str, k: int = 3, dims: str = "dims"):
    """Bounds of one field (see :func:`tertile_bounds_all`): ``(n, bounds)``."""
    return tertile_bounds_all(facts, [field], k, dims)[field]


def categorize_numbers(facts: DataFrame, fields=("rl", "rs"), labels=CATEGORIES, min_points: int = 0, dims: str = "dims") -> DataFrame:
    """Replace numeric dimensions by ``low / medium / high`` using exact
    equal-mass bounds over the whole frame; a value goes to the first bucket
    whose bound it is below. A value that is not a number is removed. A caller
    may ask for the reference's warm-up: with fewer than ``min_points`` values
    the field is removed."""
    found = tertile_bounds_all(facts, fields, len(labels), dims)
    return label_numbers(facts, {f: b if n >= max(1, min_points) else [] for f, (n, b) in found.items()}, labels, dims)


def label_numbers(facts: DataFrame, bounds: dict[str, list[float]], labels=CATEGORIES, dims: str = "dims") -> DataFrame:
    """The last step of N3, on batch or streaming facts: numeric dimensions replaced by the label of the first bound
    that they are below. A field with no bounds, and a value that is no finite number, is removed."""
    out = facts
    for field, b in bounds.items():
        if not b:
            out = out.withColumn(dims, _rewrite(F.col(dims), field, None))
            continue
        v = _numeric(dims, field)
        new = F.when(v.isNull() | ~(F.abs(v) < F.lit(float("inf"))), F.lit(None)).otherwise(_label(v, b, list(labels)))
        out = out.withColumn(dims, F.map_filter(_rewrite(F.col(dims), field, new), lambda kk, x: x.isNotNull()))
    return out


def decayed_bounds(facts: DataFrame, field: str, bucket="1 day", half_life_buckets: float = 1.0,
                   lookback: int = 10, bin_width: float = 1.0, k: int = 3, dims: str = "dims",
                   ts: str = "ts") -> DataFrame:
    """N4 bounds: per time bucket ``t``, a histogram on a fixed grid of width
    ``bin_width`` built from the previous ``lookback`` buckets with weight
    ``2^(-d / half_life)`` for bucket ``t - d``; bound i is the upper edge of
    the first bin where the cumulative weight reaches ``(i+1)/k`` of the total.

    The work is an aggregate of (bucket, bin) counts - small, whatever the
    number of facts - spread over the ``lookback`` later buckets and summed.
    Returns ``tb, b0 .. b{k-2}`` for every bucket with history.
    """
    v = _numeric(dims, field)
    h = facts.where(v.isNotNull()).select(bucket_index(ts, bucket).alias("tb"),
                                          F.floor(v / F.lit(bin_width)).cast("long").alias("bin"))
    counts = h.groupBy("tb", "bin").agg(F.count(F.lit(1)).alias("c"))
    spread = counts.select("tb", "bin", "c", F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("d")).select(
        (F.col("tb") + F.col("d")).alias("tb"), "bin",
        (F.col("c") * F.pow(F.lit(2.0), -F.col("d") / F.lit(float(half_life_buckets)))).alias("w"))
    grid = spread.groupBy("tb", "bin").agg(F.sum("w").alias("w"))
    from pyspark.sql import Window

    cw = grid.withColumn("cum", F.sum("w").over(Window.partitionBy("tb").orderBy("bin")
                                                 .rowsBetween(Window.unboundedPreceding, 0)))
    cw = cw.withColumn("total", F.sum("w").over(Window.partitionBy("tb")))
    aggs = [F.min(F.when(F.col("cum") * F.lit(k) >= F.col("total") * F.lit(i + 1), F.col("bin"))).alias(f"_b{i}")
            for i in range(k - 1)]
    b = cw.groupBy("tb").agg(*aggs)
    return b.select("tb", *[((F.col(f"_b{i}") + 1) * F.lit(bin_width)).alias(f"b{i}") for i in range(k - 1)])


def decayed_categorize(facts: DataFrame, field: str = "rs", bucket="1 day", half_life_buckets: float = 1.0,
                       lookback: int = 10, bin_width: float = 1.0, labels=CATEGORIES, dims: str = "dims",
                       ts: str = "ts", broadcast_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Categorise ``field`` with bounds that follow drift (see
    :func:`decayed_bounds`); a fact in a bucket without history loses the field."""
    k = len(labels)
    b = decayed_bounds(facts, field, bucket, half_life_buckets, lookback, bin_width, k, dims, ts)
    f = facts.withColumn("tb", bucket_index(ts, bucket))
    # one row per time bucket: stored, counted, and sent to all tasks while small; a join on the bucket alone would
    # gather a bucket's facts in one task, so beyond that the bounds are repeated per salt
    path = scratch_path(facts.sparkSession, "bounds")
    b.write.parquet(path)
    b = facts.sparkSession.read.parquet(path)
    if b.count() <= broadcast_rows:
        j = f.join(F.broadcast(b), "tb", "left")
    else:
        salted = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        j = f.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns[:1], F.map_entries(dims)), F.lit(salts)).cast("int")).join(salted, ["tb", "_salt"], "left").drop("_salt")
    v = _numeric(dims, field)
    lab = F.lit(labels[-1])
    for i in reversed(range(k - 1)):
        lab = F.when(v < F.col(f"b{i}"), F.lit(labels[i])).otherwise(lab)
    new = F.when(F.col("b0").isNull() | v.isNull(), F.lit(None)).otherwise(lab)
    out = j.withColumn(dims, F.map_filter(_rewrite(F.col(dims), field, new), lambda kk, x: x.isNotNull()))
    return out.drop("tb", *[f"b{i}" for i in range(k - 1)])


def bucket_skew(categorized: DataFrame, field: str, labels=CATEGORIES, by: list[str] | None = None,
                dims: str = "dims") -> DataFrame:
    """Chi-square statistic of the category counts against equal counts and
    whether it exceeds the 5% critical value for ``k - 1`` degrees of freedom.
    ``by`` columns give one test per group (e.g. a time bucket)."""
    lab = F.col(dims).getItem(field)
    g = categorized.where(lab.isNotNull())
    aggs = [F.sum((lab == F.lit(x)).cast("long")).alias(f"n_{x}") for x in labels]
    c = g.groupBy(*(by or [])).agg(*aggs)
    total = sum((F.col(f"n_{x}") for x in labels), F.lit(0))
    e = total / F.lit(float(len(labels)))
    chi2 = sum(((F.col(f"n_{x}") - e) ** 2 / e for x in labels), F.lit(0.0))
    crit = chi2_critical(len(labels) - 1)
    return c.withColumn("chi2", chi2).withColumn("is_skewed", F.col("chi2") > F.lit(crit))


def _with_frag(entries):
    """Entries plus their series-key fragment ``len(k) k len(v) v``."""
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.concat(
        F.length(e["key"]).cast("string"), e["key"], F.length(e["value"]).cast("string"), e["value"]).alias("frag")))


def fanout_dimensions(facts: DataFrame, required=("src",), max_size: int = 2, dims: str = "dims",
                      keep: tuple[str, ...] = ("ts",), with_key: bool = True) -> DataFrame:
    """One fact per subset (size 0 .. ``max_size``) of the non-required
    dimensions, each plus the required ones: ``1 + n + n(n-1)/2`` facts for
    ``max_size = 2``. Facts missing a required dimension are left out (see
    :func:`fanout_rejects`). Pure expressions + ``explode``; aggregate after it
    so the partial (map-side) aggregation absorbs the amplification.

    Per fact, entries are sorted and their key fragments built once; per
    subset only a native sort and join remain. With ``with_key`` the subset's
    ``series_key`` (:func:`fathom.functions.maps.series_key`) comes along."""
    req = list(required)
    has_req = F.lit(True)
    for r in req:
        has_req = has_req & F.col(dims).getItem(r).isNotNull()
    rest = F.sort_array(F.map_entries(F.map_filter(dims, lambda k, v: ~k.isin(*req) if req else F.lit(True))))
    req_entries = F.map_entries(F.map_filter(dims, lambda k, v: k.isin(*req) if req else F.lit(False)))
    f = facts.where(has_req).select(*keep, _with_frag(rest).alias("_rest"), _with_frag(req_entries).alias("_req"))
    subsets = index_subsets_fast(F.size("_rest"), max_size)
    f = f.select(*keep, "_rest", "_req", F.explode(subsets).alias("_s"))
    picked = F.transform("_s", lambda i: F.element_at(F.col("_rest"), i + 1))
    f = f.select(*keep, F.sort_array(F.concat(picked, F.col("_req"))).alias("_all"))
    cols = [*keep, F.map_from_arrays(F.col("_all.key"), F.col("_all.value")).alias(dims)]
    if with_key:
        cols.append(F.array_join(F.col("_all.frag"), "").alias("series_key"))
    return f.select(*cols)


def fanned_counts(facts: DataFrame, interval, required=("src",), max_size: int = 2, dims: str = "dims", ts: str = "ts") -> DataFrame:
    """N6 + N7 in the order that keeps the amplification small: facts are first counted per (bucket, dimensions),
    every distinct combination is fanned out once with its count, and the subsets' counts are summed per
    (bucket, entries). The entries are the only key; ``series_key`` and ``dims`` are made from the result rows.
    Returns ``series_key, bucket, n, dims``."""
    return keyed_counts(entry_counts(facts, interval, required, max_size, dims, ts))


def keyed_counts(counts: DataFrame) -> DataFrame:
    """``series_key, bucket, n, dims`` of :func:`entry_counts`."""
    return counts.select(entries_key("entries").alias("series_key"), "bucket", "n", F.map_from_entries("entries").alias("dims"))


def entry_counts(facts: DataFrame, interval, required=("src",), max_size: int = 2, dims: str = "dims", ts: str = "ts") -> DataFrame:
    """The counts of :func:`fanned_counts` by the sorted entries of a series: ``bucket, entries, n``."""
    f = ensure_ntz(facts, ts).withColumn("bucket", bucket_index(ts, interval))
    f = f.withColumn("_entries", F.sort_array(F.map_entries(dims)))
    distinct = f.groupBy("bucket", "_entries").agg(F.count(F.lit(1)).alias("n"))
    is_req = lambda e: e["key"].isin(*required) if required else F.lit(False)
    d = distinct.withColumn("_req", F.filter("_entries", is_req)).withColumn("_rest", F.filter("_entries", lambda e: ~is_req(e)))
    # no subsets without the required ones: a filter would be pushed below the count and repeat all that made the dims
    subsets = F.when(F.size("_req") == len(set(required)), index_subsets_fast(F.size("_rest"), max_size))
    d = d.select("bucket", "n", "_req", "_rest", F.explode(subsets).alias("_s"))
    picked = F.transform("_s", lambda i: F.element_at(F.col("_rest"), i + 1))
    return d.groupBy("bucket", F.sort_array(F.concat(picked, F.col("_req"))).alias("entries")).agg(F.sum("n").cast("long").alias("n"))


def fanout_rejects(facts: DataFrame, required=("src",), dims: str = "dims") -> DataFrame:
    cond = F.lit(False)
    for r in required:
        cond = cond | F.col(dims).getItem(r).isNull()
    return facts.where(cond)
