"""Op 13: exact dedup with a minimal perfect hash over the distinct digests of earlier documents.

Texts are equal when identical after lower-casing A-Z only; a text stands for itself by the SHA-256 digest of that
form. The distinct digests of the *history* are dealt by hash into shards of about ``SLOTS``; a shard's minimal
perfect hash is a stack of bit arrays: a digest owns the first bit that no other remaining digest falls on, and its
slot is the number of set bits before it. Slot ``i`` holds the full digest, the winner's locator (doc_id and row of
the stored table) and the number of rows. Digests of *arrivals* are counted per distinct digest first, then looked
up in their shard: a slot counts only if all 32 bytes agree, as the hash gives strangers slots, too. Members join
the slot's group, nonmembers are groups by themselves. Of a group the largest doc_id stays.

One row per distinct digest is moved, never a text. Verdicts on repeated texts go back to their rows by a join on the
digest; groups above one in ``HOT`` of all rows (there are fewer than ``HOT`` of those, whatever the size) go to all
tasks instead, so no task gathers a group.

Defined results: null text counts as empty; empty texts are equal to each other; texts of any length are digested
whole; a null doc_id (and -2^63) is smaller than all others, and a group of such rows has ``keep_id`` null; of rows
that repeat a doc_id and a text exactly one stays; an empty table, history or set of arrivals gives that many rows
less; ``keep_last`` passes other columns unchanged, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import mix
from fathom.session import scratch_path

SLOTS = 32_768  # digests of a shard, on average
HOT = 10_000
NO_ID = -(2**63)
INDEX = "shard long, levels array<int>, bits binary, digests binary, ids binary, rows binary, counts binary"
GROUPS = "digest binary, id long, row long, n long"


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z in lower case."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256))


def locate(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of every digest (four 64-bit words) in a level of ``size`` bits."""
    x = np.full(len(words), level * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(4):
        x = mix(x ^ words[:, j])
    return (x % np.uint64(size)).astype(np.int64)


def as_words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


class PerfectHash:
    """Distinct 32-byte digests -> 0 .. n-1, without a gap; other digests get any slot or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        left, sizes, parts = words, [], []
        while len(left):
            size = 2 * len(left) + 64
            at = locate(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        todo, start = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = start + locate(words[todo], level, size)
            hit = self.bits[at]
            out[todo[hit]] = self.before[at[hit]]
            todo, start = todo[~hit], start + size
        return out


def numbered(docs: DataFrame, *extra: Column) -> DataFrame:
    """``row, doc_id, digest`` of every document, stored once: row numbers hold for all later reads."""
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest_of(F.col("text")).alias("digest"), *extra).write.parquet(path)
    return spark.read.parquet(path)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """Per digest the winner (largest doc_id, its row) and the number of rows; counted in each task before the shuffle."""
    order = F.coalesce("doc_id", F.lit(NO_ID))
    return rows.groupBy("digest").agg(F.max(order).alias("id"), F.max_by("row", order).alias("row"), F.count(F.lit(1)).alias("n"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def build_index(groups: DataFrame, expected: int = 0, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(index, number of shards) over ``digest, id, row, n`` with distinct digests, written to the shared folder: one
    row per shard. ``expected``: distinct digests of the largest set that will be looked up at once; a shard and
    the lookups that meet it are one task's work."""
    shards = max(1, -(-max(groups.count(), expected) // slots))

    def run(t: pa.Table) -> pa.Table:
        raw = b"".join(t.column("digest").to_pylist())
        words = as_words(raw)
        h = PerfectHash.build(words)
        order = np.argsort(h.slots(words))
        packed = [np.ascontiguousarray(words[order]).tobytes(), *(t.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("id", "row", "n"))]
        return pa.table([t.column("shard")[:1].combine_chunks(), pa.array([h.sizes], pa.list_(pa.int32())), pa.array([np.packbits(h.bits).tobytes()], pa.binary()),
                         *(pa.array([p], pa.binary()) for p in packed)], names=["shard", "levels", "bits", "digests", "ids", "rows", "counts"])

    dealt = groups.select(_shard(shards), "digest", "id", "row", "n")
    return _stored(dealt.groupBy("shard").applyInArrow(run, INDEX), "index"), shards


def merge(index: DataFrame, shards: int, arrivals: DataFrame) -> DataFrame:
    """The groups of the index and of ``arrivals`` (``digest, id, row, n``, distinct digests) together."""

    def table(digests: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        # digests as rows of four words -> 32-byte values
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests).tobytes())])
        return pa.table([raw.cast(pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["digest", "id", "row", "n"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        new = as_words(b"".join(right.column("digest").to_pylist()))
        added = [right.column(c).to_numpy() for c in ("id", "row", "n")]
        if not left.num_rows:
            return table(new, added)
        held = left.to_pylist()[0]
        digests = as_words(held["digests"])
        ids, rows, counts = (np.frombuffer(held[c], "<i8").copy() for c in ("ids", "rows", "counts"))
        total = sum(held["levels"])
        h = PerfectHash(held["levels"], np.unpackbits(np.frombuffer(held["bits"], np.uint8), count=total).astype(bool))
        slot = h.slots(new)
        member = slot >= 0
        member[member] = (digests[slot[member]] == new[member]).all(axis=1)  # all bytes, not the hash alone
        s = slot[member]
        later = added[0][member] > ids[s]
        counts[s] += added[2][member]
        rows[s[later]], ids[s[later]] = added[1][member][later], added[0][member][later]
        return table(np.concatenate([digests, new[~member]]), [np.concatenate([a, b[~member]]) for a, b in zip((ids, rows, counts), added)])

    probes = arrivals.select(_shard(shards), "digest", "id", "row", "n")
    return index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(run, GROUPS)


def groups_of(rows: DataFrame, history: Column, slots: int = SLOTS) -> DataFrame:
    """``digest, id, row, n`` of every text that occurs twice or more, stored. ``history`` tells the rows that the
    index is built over; the others are looked up in it."""
    old = _stored(distinct_digests(rows.where(F.coalesce(history, F.lit(True)))), "old")
    new = _stored(distinct_digests(rows.where(~F.coalesce(history, F.lit(True)))), "new")
    index, shards = build_index(old, new.count(), slots)
    return _stored(merge(index, shards, new).where("n > 1"), "repeated")


def with_verdicts(rows: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` with ``keep_id, keep_row, group_size``."""
    total = rows.count()
    g = groups.select("digest", F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("n").alias("_n"))
    first = rows.join(F.broadcast(g.where(F.col("_n") * hot > total)), "digest", "left")
    large = first.where(F.col("_n").isNotNull())
    small = first.where(F.col("_n").isNull()).drop("_id", "_row", "_n").join(g.where(F.col("_n") * hot <= total), "digest", "left")
    both = large.unionByName(small)
    kept = F.when(F.col("_id") != NO_ID, F.col("_id"))
    return both.select(*rows.columns, F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(kept).alias("keep_id"),
                       F.coalesce("_row", "row").alias("keep_row"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"))


def earlier_half(rows: DataFrame) -> Column:
    """The history where none is given: doc_ids up to the middle of their range, and null ones."""
    edge = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if edge["lo"] is None:
        return F.lit(True)
    return F.col("doc_id") <= F.lit(edge["lo"] + (edge["hi"] - edge["lo"]) // 2)


def verdicts(docs: DataFrame, slots: int = SLOTS, hot: int = HOT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every document, dropped ones too."""
    rows = numbered(docs)
    out = with_verdicts(rows, groups_of(rows, earlier_half(rows), slots), hot)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last(docs: DataFrame, slots: int = SLOTS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns as they were."""
    names = docs.columns
    rows = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("packed"))
    light = rows.drop("packed")
    groups = groups_of(light, earlier_half(light), slots)
    kept = with_verdicts(rows, groups, hot).where(F.col("row") == F.col("keep_row"))
    return kept.select(*[F.col("packed").getField(c).alias(c) for c in names])
