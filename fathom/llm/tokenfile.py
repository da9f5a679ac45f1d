"""Op 5: token-ID files with fixed-width bit packing.

Every id takes ``(vocab_size - 1).bit_length()`` bits, least significant bit first. A file holds blocks of
``BLOCK`` ids, each starting on a byte, then a footer::

    blocks | int64 doc_id[n_docs] | uint64 first_id[n_docs + 1] | uint64 block_offset[n_blocks + 1] | tail

``tail`` is magic, width, block size, n_docs, n_blocks and n_ids. Block offsets and document starts allow
random access: a document is unpacked from the blocks that it touches, vectorised in numpy.

Documents are dealt out by ranges of doc_id and sorted, and every task streams its range into files of about
``FILE_IDS`` ids in the shared folder. File names are unique per attempt; only the files named in the written
manifest count, so a task that runs twice leaves an unused file and no wrong result.

Defined results: null text is empty and gets the end id alone; repeated doc_ids are adjacent, ordered by text;
a null doc_id comes first and is written as the smallest 64-bit number; an empty table gives an empty
manifest; other columns are left out.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.bpe import PieceEncoder
from fathom.llm.textio import docs_of, slices

BLOCK = 1 << 15
ROWS, PIECES = 4096, 400_000  # texts encoded at once, pieces that a task remembers
FILE_IDS = 1 << 25
MAGIC = b"IDBITS01"
TAIL = struct.Struct("<8sIIQQQ")  # magic, width, block, n_docs, n_blocks, n_ids
NO_ID = -(1 << 63)
SPACE = "\u0120"  # fixed value: the space in byte-level vocabularies


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):  # the same bits, without unpacking them
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder's address."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


class Writer:
    """One file; ids arrive document by document and leave as packed blocks."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.docs: list[int] = []
        self.first: list[int] = [0]
        self.offsets: list[int] = [0]
        self.rest: list[np.ndarray] = []  # ids that no block holds yet
        self.size = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.first.append(self.first[-1] + len(ids))
        self.rest.append(ids)
        self.size += len(ids)
        if self.size >= 16 * self.block:
            ids = np.concatenate(self.rest)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(ids[i:i + self.block])
            self.rest, self.size = [ids[full:]], len(ids) - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        for i in range(0, len(ids), self.block):
            self._put(ids[i:i + self.block])
        for a, kind in ((self.docs, "<i8"), (self.first, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(a, kind).tobytes())
        self.out.write(TAIL.pack(MAGIC, self.width, self.block, len(self.docs), len(self.offsets) - 1, self.first[-1]))
        self.out.close()


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, f):
        self.f = f
        f.seek(f.size() - TAIL.size)
        magic, self.width, self.block, n, blocks, self.n_ids = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-ID file")
        size = 8 * (n + n + 1 + blocks + 1)
        f.seek(f.size() - TAIL.size - size)
        foot = f.read(size)
        self.docs = np.frombuffer(foot, "<i8", n)
        self.first = np.frombuffer(foot, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(foot, "<u8", blocks + 1, 8 * (2 * n + 1)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the file."""
        if a >= b:
            return np.empty(0, "<u4")
        i, j = a // self.block, -(-b // self.block)
        self.f.seek(int(self.offsets[i]))
        data = self.f.read(int(self.offsets[j] - self.offsets[i]))
        out = []
        for k in range(i, j):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(data[self.offsets[k] - self.offsets[i]:self.offsets[k + 1] - self.offsets[i]], n, self.width))
        return np.concatenate(out)[a - i * self.block:b - i * self.block]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id in the file, ids), in file order; reads long runs of blocks."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + ids_at_once, "right")) - 1)
            a = int(self.first[i])
            run = self.ids(a, int(self.first[j]))
            for k in range(i, j):
                yield int(self.docs[k]), int(self.first[k]), run[self.first[k] - a:self.first[k + 1] - a]
            i = j


_ENCODERS: dict[str, PieceEncoder] = {}


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library behind the piece caches: it encodes each piece of text once while that is cached."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()

        first = np.zeros(t.get_vocab_size(), bool)  # tokens that begin with a space
        first[[i for token, i in t.get_vocab().items() if token[:1] == SPACE]] = True

        def encode_words(words: Iterable[str]) -> dict[str, bytes]:
            """Pieces that hold one space, at their start, go in long runs: the tokenizer breaks before each of these
            spaces, so a token that begins with a space begins a piece."""
            run, rest = [], []
            for w in words:
                (run if w[:1] == " " and w.isprintable() and w.rfind(" ") == 0 and len(w) > 1 else rest).append(w)
            out = {w: array("I", e.ids).tobytes() for w, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False))}
            for i in range(0, len(run), 20_000):
                some = run[i:i + 20_000]
                data = array("I", t.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids)
                at = (4 * np.flatnonzero(first[np.frombuffer(data, "<u4")])).tolist()
                if len(at) != len(some):
                    raise ValueError("tokens and pieces begin at different spaces")
                data = data.tobytes()
                out.update({w: data[a:b] for w, a, b in zip(some, at, [*at[1:], len(data)])})
            return out

        special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        _ENCODERS[path] = PieceEncoder(path, encode_words, special, whole_pieces=True, cache=PIECES)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, vocab_path: str, vocab_size: int, end_id: int | None = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all documents into files under ``path``; the manifest, also written there: ``file, n_docs, n_ids, first_doc, part, seq``."""
    spark = docs.sparkSession
    width = width_of(vocab_size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(f"{path}/ids")
        fs.create_dir(root, recursive=True)
        part, seq, w, name = TaskContext.get().partitionId(), 0, None, ""
        enc = library_encoder(vocab_path)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

        def done():
            w.close()
            row = {"file": [name], "n_docs": [len(w.docs)], "n_ids": [w.first[-1]], "first_doc": [w.docs[0]], "part": [part], "seq": [seq]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("part", pa.int32()), ("seq", pa.int32())]))

        for b in batches:
            for s in slices(b, ROWS):
                for doc, raw in zip(s.column("doc_id").to_pylist(), enc.encode_batch(s.column("text").to_pylist())):
                    ids = np.frombuffer(raw + end, "<u4")
                    if w is None:
                        name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                        w = Writer(fs.open_output_stream(f"{root}/{name}"), width)
                    w.add(NO_ID if doc is None else doc, ids)
                    if w.first[-1] >= file_ids:
                        yield done()
                        w, seq = None, seq + 1
        if w is not None:
            yield done()

    rows = docs_of(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "file string, n_docs bigint, n_ids bigint, first_doc bigint, part int, seq int").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ids(spark: SparkSession, path: str, fn: Callable[[np.ndarray], object], field: str) -> DataFrame:
    """``doc_id, start, n_tokens, value`` of every document, ``value = fn(ids)`` of type ``field``. ``start`` counts
    the ids of all documents before it; the running sum is over one row per file."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(field))
    order = Window.orderBy("first_doc", "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{path}/manifest").withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(f"{path}/ids")
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    rows: list[tuple] = []
                    for doc, at, ids in Reader(f).documents():
                        rows.append((None if doc == NO_ID else doc, base + at, len(ids), fn(ids)))
                        if len(rows) == 1024:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), kind))], names=["doc_id", "start", "n_tokens", "value"])

    return files.select("file", "base").repartition(n).mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, value {field}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
