"""Op 9: mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Every document gets an exponential key ``-ln(u) / weight``: u comes from a hash of the document, the weight
from the quality of its text. A source's target is split into complete epochs (each document once per epoch)
and a rest; the rest takes documents in key order while half of the next one still fits.

The prefix sums are two-level: sums per (source, key bucket) first, then only the documents of the one bucket
of each source in which the rest ends. A source with a third of all rows is therefore never sorted in one
task, and the decision about a document is a comparison with its source's cut, without moving texts.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of its own and
comes last; rows that are equal in doc_id and text share a key and are chosen together; an empty table gives
an empty result; other columns are carried by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import scratch_path

WEIGHTS = (1, 2, 3)  # of the sources by code point, repeating
MOST_EPOCHS = 3
BUCKETS = 1024
BROADCAST_SOURCES = 100_000  # cuts sent to all tasks; those of more sources are joined
SYMBOLS = "#*$%&|<>!"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Weight in [0.25, 1]: 1 without symbols, less the more symbols a word carries."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return 0.25 + 0.75 / (1.0 + symbols / F.greatest(size, F.lit(1)))


def _u(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in (0, 1], from 48 bits of a digest; depends on the row and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / F.lit(float(2**48))


def keyed(docs: DataFrame, seed: int = 9) -> DataFrame:
    """``docs`` with ``_size, _key, _bucket``; buckets are ascending in the key."""
    text = F.col("text")
    d = docs.withColumn("_size", size_of(text))
    d = d.withColumn("_key", -F.log(_u(F.col("doc_id"), text, seed)) / F.coalesce(quality_of(text, F.col("_size")), F.lit(1.0)))
    return d.withColumn("_bucket", F.least(F.floor(BUCKETS * (1.0 - F.exp(-F.col("_key")))), F.lit(BUCKETS - 1)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` (one row per source) -> with ``target``.

    Sources in the order of ``most * source_size / weight`` fill up one after another; the first that does
    not reach its limit sets the level that the remaining ones share by weight.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", (most * F.col("source_size")).cast("double"))
    order = everything.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(onwards))
    w = w.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(all_rows))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level"))
    return w.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(light, cuts), both stored once in the shared folder. light: ``doc_id, source, _size, _key, _bucket`` per
    document. cuts: per source ``source_size, target, _epochs, _rest, _cut_bucket, _cut_key``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mix")
    keyed(docs.select("doc_id", "source", "text"), seed).drop("text").write.parquet(path)
    light = spark.read.parquet(path)
    buckets = light.groupBy("source", "_bucket").agg(F.sum("_size").alias("_sum"))
    goal = targets(buckets.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    goal = goal.withColumn("_epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    g, r = goal.alias("g"), reach.alias("r")
    edge = (g.join(r, F.col("g.source").eqNullSafe(F.col("r.source")) & (F.col("r._before") <= F.col("g._rest")))
            .groupBy(F.col("g.source").alias("source"), "source_size", "target", "_epochs", "_rest")
            .agg(F.max_by("_bucket", "_bucket").alias("_cut_bucket"), F.max("_before").alias("_cut_before")))
    e, d = edge.alias("e"), light.alias("d")
    keys = (d.join(e, F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d._bucket") == F.col("e._cut_bucket")))
            .groupBy(F.col("e.source").alias("source"), "_key", "_rest", "_cut_before").agg(F.sum("_size").alias("_sum")))
    w = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_at", F.col("_cut_before") + F.coalesce(F.sum("_sum").over(w), F.lit(0)))
    last = (keys.where((F.col("_at") + F.col("_sum") / 2 <= F.col("_rest")) & (F.col("_rest") > 0))
            .groupBy("source").agg(F.max("_key").alias("_cut_key")))
    l = last.alias("l")
    cuts = e.join(l, F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.*", "l._cut_key")
    folder = scratch_path(spark, "cuts")
    cuts.where(F.col("source_size").isNotNull()).write.parquet(folder)
    cuts = spark.read.parquet(folder)
    return light, F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts


def with_copies(keyed_docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds the cuts' columns and ``_copies``: how often the mix holds the document."""
    d, c = keyed_docs.alias("d"), cuts.alias("c")
    j = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source")), "left").select("d.*", "c.source_size", "c.target", "c._epochs", "c._rest", "c._cut_bucket", "c._cut_key")
    chosen = (F.col("_rest") > 0) & ((F.col("_bucket") < F.col("_cut_bucket"))
                                     | ((F.col("_bucket") == F.col("_cut_bucket")) & (F.col("_key") <= F.col("_cut_key"))))
    return j.withColumn("_copies", F.col("_epochs") + F.coalesce(chosen, F.lit(False)).cast("long"))


def taken(docs: DataFrame, seed: int = 9) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document."""
    light, cuts = plan(docs, seed)
    return with_copies(light, cuts).select(
        "doc_id", F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 9) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it (not at all, or up to 3 times)."""
    _, cuts = plan(docs, seed)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "text")
    out = with_copies(keyed(packed, seed).drop("doc_id", "text"), cuts)
    out = out.where("_copies > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return out.select("_row.*")
