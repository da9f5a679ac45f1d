"""Op 4: substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of the ``m`` consecutive words in it;
consecutive windows with one minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket.
There the words become numbers, ranks of spans of 1, 2, 4, ... words are sorted into ranks of whole windows,
exactly, and every window gets the smallest doc_id that holds it.

What cannot repeat never travels: a first pass counts the documents of every minimiser, and only super-k-mers
whose minimiser may be in two documents are packed. The set of those goes to the tasks as a bit array of fixed
size; when it fills up, more is packed and the result is the same. Equal super-k-mers are merged before they
are moved, and of equal ones only the first document needs its windows looked at singly: all later ones lose
the whole span. A minimiser with more than ``hot`` distinct strings is not gathered in a bucket: the digests of
its windows are counted by Spark's own aggregation instead.

Defined results: null text has no words; texts of fewer than ``k`` words lose none; rows that share a doc_id
never remove each other's words; rows with a null doc_id are kept whole and remove nothing; an empty table
gives an empty result; other columns pass ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from hashlib import sha256
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import WordHashes, map_batches, numbered_columns, slices, tidy, window_hashes
from fathom.session import scratch_path

K, M = 50, 8
FILTER_BITS = 26  # size of the bit array, as a power of two
HOT = 20_000
CHUNK_WORDS = 1_000_000  # words that a bucket's task ranks at once


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive elements, by doubling spans."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span:w - span + n])


def super_kmers(texts: pa.Array, hashes: WordHashes, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser, text number, first window in the text, windows) of every super-k-mer of the texts."""
    h, sizes = hashes.columns(texts)
    ends = np.cumsum(sizes)
    low = sliding_min(window_hashes(h, m), k - m + 1)
    if not len(low):
        none = np.empty(0, np.int64)
        return none, none, none, none
    doc = np.repeat(np.arange(len(sizes)), sizes)[:len(low)]
    inside = np.arange(len(low)) + k <= ends[doc]
    turn = np.empty(len(low), bool)
    turn[0] = True
    turn[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(turn)
    n = np.diff(np.append(at, len(low)))
    real = inside[at]
    at, n = at[real], n[real]
    d = doc[at]
    return low[at].view(np.int64), d, at - (ends[d] - sizes[d]), n


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``; ``row`` tells texts of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text"))


def shared_minimisers(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``minimiser`` of those that occur in two documents or more."""
    hashes = WordHashes()

    def run(b):
        ids = np.array(b.column("doc_id").to_pylist(), np.int64)
        low, d, _, _ = super_kmers(b.column("text"), hashes, k, m)
        some, at = np.unique(low, return_inverse=True)
        first, last = np.full(len(some), np.iinfo(np.int64).max), np.full(len(some), np.iinfo(np.int64).min)
        np.minimum.at(first, at, ids[d])
        np.maximum.at(last, at, ids[d])
        return {"minimiser": some, "first": first, "last": last}

    rows = map_batches(_texts(docs).where("doc_id is not null").select("doc_id", "text"), run, "minimiser bigint, first bigint, last bigint")
    return rows.groupBy("minimiser").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("minimiser")


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit array of ``2**bits`` slots over the lowest bits of the keys; at most ``2**bits / 64`` words reach the driver."""
    slot = F.col("minimiser").bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast((minimiser & {(1 << bits) - 1}) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out


def packed_super_kmers(docs: DataFrame, bits: np.ndarray, k: int = K, m: int = M) -> DataFrame:
    """``minimiser, digest, words, doc_id, row, start, n`` of the super-k-mers whose minimiser may be shared."""
    hashes, sent = WordHashes(), docs.sparkSession.sparkContext.broadcast(bits)

    def run(b):
        bits = sent.value
        mask = np.uint64(64 * len(bits) - 1)
        low, d, at, n = super_kmers(b.column("text"), hashes, k, m)
        slot = low.view(np.uint64) & mask
        keep = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
        low, d, at, n = low[keep], d[keep], at[keep], n[keep]
        words = {i: b.column("text")[i].as_py().encode().split() for i in set(d.tolist())}
        packed = [b" ".join(words[i][a:a + c + k - 1]) for i, a, c in zip(d.tolist(), at.tolist(), n.tolist())]
        take = pa.array(d, pa.int64())
        return {"minimiser": low, "digest": [xxhash.xxh3_128_digest(p) for p in packed], "words": packed,
                "doc_id": b.column("doc_id").take(take), "row": b.column("row").take(take), "start": at, "n": n}

    return map_batches(_texts(docs).where("doc_id is not null"), run,
                       "minimiser bigint, digest binary, words binary, doc_id bigint, row bigint, start int, n int")


def rank_windows(strings: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(string number, rank) of every window of the strings; equal ranks are equal words. Spans double: the rank of
    2s words is the rank of the pair of ranks of s words."""
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for s in strings for w in s], np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    rank, span = flat, 1
    while span < k:
        step = min(span, k - span)
        if len(rank) <= step:
            break
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        span += step
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(rank)]
    inside = np.arange(len(rank)) + k <= np.cumsum(sizes)[owner]
    return owner[inside], rank[inside]


def _bucket_hits(strings: DataFrame, k: int) -> DataFrame:
    """``digest, hits``: numbers of the windows of a string that an earlier document holds. Buckets are sorted by
    minimiser and ranked in chunks of whole minimisers."""
    schema = pa.schema([("digest", pa.binary()), ("hits", pa.list_(pa.int32()))])

    def chunk(digests: list[bytes], words: list[bytes], firsts: list[int]) -> pa.RecordBatch:
        owner, rank = rank_windows([w.split(b" ") for w in words], k)
        ids = np.array(firsts, np.int64)
        least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, rank, ids[owner])
        at = np.arange(len(owner)) - np.searchsorted(owner, owner)
        hit = least[rank] < ids[owner]
        owner, at = owner[hit], at[hit]
        some, where = np.unique(owner, return_index=True)
        lists = np.split(at, where[1:]) if len(some) else []
        return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.binary()), pa.array(lists, schema.field(1).type)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, words, firsts, size, last = [], [], [], 0, None
        for b in batches:
            for low, digest, text, first in zip(*(b.column(c).to_pylist() for c in ("minimiser", "digest", "words", "first"))):
                if size >= CHUNK_WORDS and low != last:
                    yield chunk(digests, words, firsts)
                    digests, words, firsts, size = [], [], [], 0
                digests.append(digest)
                words.append(text)
                firsts.append(first)
                size += text.count(b" ") + 1
                last = low
        if words:
            yield chunk(digests, words, firsts)

    parts = strings.repartition("minimiser").sortWithinPartitions("minimiser")
    return parts.select("minimiser", "digest", "words", "first").mapInArrow(tidy(run), "digest binary, hits array<int>")


def _counted_hits(strings: DataFrame, k: int) -> DataFrame:
    """The same for strings of hot minimisers, from an aggregation over the digests of all their windows."""

    def run(b):
        out = {"window": [], "digest": [], "at": [], "first": []}
        for digest, text, first in zip(*(b.column(c).to_pylist() for c in ("digest", "words", "first"))):
            w = text.split(b" ")
            for i in range(len(w) - k + 1):
                out["window"].append(xxhash.xxh3_128_digest(b" ".join(w[i:i + k])))
                out["digest"].append(digest)
                out["at"].append(i)
                out["first"].append(first)
        return out

    wins = map_batches(strings.select("digest", "words", "first"), run, "window binary, digest binary, at int, first bigint")
    least = wins.groupBy("window").agg(F.min("first").alias("least"))
    return wins.join(least, "window").where("least < first").groupBy("digest").agg(F.array_sort(F.collect_list("at")).alias("hits"))


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """``doc_id, row, spans``: word ranges (start, end) to remove per document that loses words."""
    spark = docs.sparkSession
    path = scratch_path(spark, "kmers")
    packed_super_kmers(docs, bit_filter(shared_minimisers(docs, k, m)), k, m).write.parquet(path)
    found = spark.read.parquet(path)
    strings = found.groupBy("digest", "minimiser").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("words").alias("words"))
    folder = scratch_path(spark, "strings")
    strings.write.parquet(folder)
    strings = spark.read.parquet(folder)
    counts = strings.groupBy("minimiser").agg(F.count("*").alias("c"))
    many = counts.where(F.col("c") > hot).select("minimiser")
    some = counts.where(F.col("c").between(2, hot)).select("minimiser")
    hits = _bucket_hits(strings.join(some, "minimiser", "left_semi"), k)
    if many.limit(1).count():
        hits = hits.unionByName(_counted_hits(strings.join(many, "minimiser", "left_semi"), k))
    verdict = strings.select("digest", "first", "last").join(hits, "digest", "left").where((F.col("first") < F.col("last")) | F.col("hits").isNotNull())
    spans = found.drop("words", "minimiser").join(verdict, "digest").select(
        "doc_id", "row", F.when(F.col("doc_id") > F.col("first"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + (k - 1)).alias("b"))))
        .otherwise(F.transform("hits", lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + k).alias("b")))).alias("s")).where("s is not null")
    return spans.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _kept(n: int, spans: list | None) -> np.ndarray:
    keep = np.ones(n, bool)
    for s in spans or ():
        keep[s["a"]:s["b"]] = False
    return keep


def digests(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""

    def run(b):
        n, gone, kept = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = text.encode().split()
            keep = _kept(len(words), spans)
            n.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            kept.append(sha256(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])).hexdigest())
        return {"doc_id": b.column("doc_id"), "n_words": n, "n_removed": gone, "kept_sha256": kept}

    joined = _texts(docs).join(repeated_spans(docs, k, m, hot), ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


WORD_AND_BLANKS = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def deduplicate(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """``docs`` without the repeated words (each with the white space after it); all other columns unchanged, whatever
    their names."""
    rows = numbered_columns(docs)
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                texts = s.column(text).to_pylist()
                for i, spans in enumerate(s.column("spans").to_pylist()):
                    if spans:
                        data = texts[i].encode()
                        words = [m.span() for m in WORD_AND_BLANKS.finditer(data)]
                        keep = _kept(len(words), spans)
                        head = data[:words[0][0]] if words else b""
                        texts[i] = (head + b"".join([data[a:c] for (a, c), ok in zip(words, keep) if ok])).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, s.schema.field(c).type) if c == text else s.column(c) for c in names],
                                                 schema=pa.schema([s.schema.field(c) for c in names]))

    spans = repeated_spans(docs, k, m, hot).select(F.col("doc_id").alias(doc_id), "row", "spans")
    joined = rows.withColumn("row", F.xxhash64(F.coalesce(text, F.lit("")))).join(spans, [doc_id, "row"], "left").select(*names, "spans")
    return joined.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)
