"""Shared helpers: Arrow batches in and out of tasks, ASCII word splitting, word hashes.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. On UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` lowers A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from fathom.session import scratch_path

ROWS = 512  # rows handled at once inside a task; bounds the memory of a batch
CACHE = 250_000  # entries of a task's word caches; a full cache is emptied, results never depend on it
LOADED: dict = {}  # what the tasks of one operator read once per Python worker, with its caches


class WordHashes(dict):
    """word -> 64-bit hash, computed on first use; emptied when full (bounded memory)."""

    def __missing__(self, w: bytes | str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def columns(self, texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words of all texts in order, words per text). Arrow splits at ASCII white space and numbers
        the distinct words, so that each is looked up once per call."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        numbered = flat.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        at = numbered.indices.to_numpy()
        table = self.of(distinct) if distinct else np.zeros(1, np.uint64)
        real = np.array([w != "" for w in distinct], bool)[at] if "" in distinct else None  # white space at an end
        h = table[at] if len(at) else np.empty(0, np.uint64)
        if real is None:
            return h, np.diff(offsets)
        counts = np.append(0, np.cumsum(real))
        return h[real], np.diff(counts[offsets])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of every window of ``k`` consecutive elements (empty when fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, seed, np.uint64)
    mul = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        acc = (acc ^ h[j:j + n]) * mul
        acc ^= acc >> np.uint64(32)
    return mix(acc)


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def give_back(keep: bool = False) -> None:
    """Frees what a reused worker still holds of earlier tasks: Arrow's and malloc's unused memory and, unless the
    task is of the kind that wants it (``keep``), all that is in ``LOADED``."""
    if not keep:
        LOADED.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, its worker tidied up before and after the task (:func:`give_back`)."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep)
        yield from run(batches)
        give_back(keep)

    return tidied


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = ROWS, keep: bool = False) -> DataFrame:
    """``mapInArrow`` over small slices; ``fn`` returns one list or array per output column. ``keep``: it uses
    ``LOADED``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, rows):
                cols = fn(part)
                if cols is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(tidy(run, keep), schema)


def docs_of(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only; null text becomes the empty text. Other columns never reach the tasks."""
    return df.select(*[F.coalesce(F.col("text"), F.lit("")).alias("text") if c == "text" else F.col(c) for c in cols])


def bounded_rows(rows: DataFrame, limit: int) -> list[Row]:
    """Rows with ``doc_id`` and a size ``n``, in an order by a hash of doc_id, each that still fits into ``limit``
    together. Rows are stored once; the driver chooses by id and size and fetches the chosen rows alone."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "sample")
    rows.withColumn("row_no", F.monotonically_increasing_id()).write.parquet(folder)
    stored, chosen, total = spark.read.parquet(folder), {}, 0
    for r in sorted(stored.select("row_no", "doc_id", "n").collect(), key=lambda r: (r.doc_id * 0x9E3779B1 % 2**32, r.doc_id, r.n, r.row_no)):
        if total + r.n <= limit:
            chosen[r.row_no] = len(chosen)
            total += r.n
    ids = spark.createDataFrame([(i,) for i in chosen], "row_no long")
    return sorted(stored.join(F.broadcast(ids), "row_no").collect(), key=lambda r: chosen[r.row_no])


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0, c1 ...``: whatever they were called, nothing clashes with them. ``toDF`` with
    the old names gives them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
