"""Op 12: audit of how filters interact, over every order of applying them.

Five filters judge whole texts: A too few words, B too few distinct words, C too many capitals, D symbols, E a copy
of a text with a smaller doc_id. A to D come from one pass over the texts. E is an existential self-join: a row
fails when some row with an equal hash, the exact text and a smaller doc_id exists (left semi join). The failing
ids of all filters are put together, each id's failures become a bit combination, and combinations are counted per
part. Everything in the report, for all 120 orders, follows from these at most 32 counts a part.

The semi join sees only texts whose hash occurs twice or more, and on its right side one row per distinct text with
its smallest doc_id. A hash with more than one in ``HOT`` of all rows is split: its left rows are dealt to salts by
row, its right rows repeated per salt. There are fewer than ``HOT`` such hashes, whatever the size, so their list
goes to all tasks.

Defined results: null text counts as empty (fails A only: 0 is not below 80 % of 0, nor above 10 %); a null doc_id
is neither smaller nor larger than another, so its row never fails E; rows that share a doc_id are judged one by one,
and a labelled doc_id counts for each of them (a doc_id labelled twice counts when any label says 1); null lang is
the part ''; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import map_batches
from fathom.session import scratch_path

# The filters' letters and limits.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
HOT = 10_000
SALT_ROWS = 2_000  # left rows of a hot hash per salt, about
E_BIT = 16

IS_CAPITAL = np.zeros(256, np.int64)
IS_CAPITAL[65:91] = 1
IS_SYMBOL = np.zeros(256, np.int64)
IS_SYMBOL[list(SYMBOLS)] = 1
IS_START = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # first byte of a code point


def _per_text(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags[data]))
    return np.diff(sums[offsets])


def failures(texts: pa.Array) -> np.ndarray:
    """Bits of A to D (1, 2, 4, 8) that each text fails."""
    raw = texts.cast(pa.large_binary())
    _, off, buf = raw.buffers()
    offsets = np.frombuffer(off, np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(buf, np.uint8, offsets[-1] - offsets[0], offsets[0]) if buf is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    words = [t.split() for t in raw.to_pylist()]
    n = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    capitals, symbols, points = (_per_text(f, data, offsets) for f in (IS_CAPITAL, IS_SYMBOL, IS_START))
    return ((n < LEAST_WORDS) * 1 + (100 * distinct < DISTINCT_PERCENT * n) * 2
            + (100 * capitals > CAPITALS_PERCENT * points) * 4 + (symbols > 0) * 8)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, hash, bits`` per document (A to D), stored."""
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "part": b.column("part"), "hash": b.column("hash"), "bits": failures(b.column("text"))}

    return _stored(map_batches(d.withColumn("hash", F.xxhash64("text")), run, "doc_id long, part string, hash long, bits int"), "judged")


def copies(docs: DataFrame, rows: DataFrame, hot: int = HOT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``doc_id, part, hash`` of the rows that fail E. ``rows``: the hashes of all rows."""
    counts = _stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hashes")
    total = rows.count()
    often = F.col("n") * hot > total
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("hash", F.xxhash64("text"))
    d = d.join(F.broadcast(counts.where(often).select("hash", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))), "hash", "left")
    many = d.where(F.col("salts").isNotNull())
    few = d.where(F.col("salts").isNull()).join(counts.where(~often), "hash", "left_semi").withColumn("salts", F.lit(1))
    found = _stored(many.unionByName(few), "repeated")
    salt = F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int")
    left = found.withColumn("salt", salt).alias("l")
    # one row per distinct text: that a smaller doc_id exists is the same as that the smallest one is smaller
    first = found.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    right = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("r")
    same = ((F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt"))
            & (F.col("l.text") == F.col("r.text")) & (F.col("r.least") < F.col("l.doc_id")))
    return left.join(right, same, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, hot: int = HOT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``part, bits, n, good, toxic``: documents with exactly these failures, and those of them labelled so. Stored."""
    rows = judged(docs)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # a row of `judged` says that one document exists and what it fails of A to D; a copy's row adds E to its documents
    ids = rows.select("doc_id", "part", "hash", "bits", one.alias("n"))
    e = copies(docs, rows, hot, salt_rows).select("doc_id", "part", "hash", F.lit(E_BIT).alias("bits"), none.alias("n"))
    per_id = ids.unionByName(e).groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    fails, passes = per_id.where("bits > 0"), per_id.where("bits = 0")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = fails.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    rest = fails.where(F.col("doc_id").isNull()).unionByName(passes).withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    labelled = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return _stored(known.unionByName(rest).groupBy("part", "bits").agg(F.sum("n").alias("n"), labelled("good"), labelled("toxic")), "combinations")


def steps(letters: str = LETTERS) -> list[tuple]:
    """(filter_order, step, bits, kept, removed, redundant, unique, share) for every order, step and combination.
    share: in how many orders the step's filter is the first of the combination's."""
    out = []
    all_orders = list(itertools.permutations(range(len(letters))))
    for order in all_orders:
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            for bits in range(1 << len(letters)):
                fails, gone = bits >> i & 1, bool(bits & before)
                out.append((name, step, bits, int(not gone and not fails), int(fails and not gone), int(fails and gone),
                            int(bits == 1 << i), len(all_orders) // bits.bit_count() if fails else 0))
            before |= 1 << i
    return out


def report(docs: DataFrame, labels: DataFrame, hot: int = HOT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Per part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    spark = docs.sparkSession
    found = combinations(docs, labels, hot, salt_rows)
    table = spark.createDataFrame(steps(), "filter_order string, step int, bits int, k int, r int, d int, u int, s int")
    j = found.join(F.broadcast(table), "bits")  # 19,200 rows, fixed by the number of filters
    total = lambda a, b: F.sum(F.col(a) * F.col(b)).cast("long")
    return j.groupBy("part", "filter_order", "step").agg(
        total("n", "k").alias("kept"), total("n", "r").alias("removed"), total("n", "d").alias("redundant"),
        total("n", "u").alias("unique_fails"), total("good", "r").alias("good_lost"), total("toxic", "r").alias("toxic_lost"),
        total("n", "s").alias("shapley"))
