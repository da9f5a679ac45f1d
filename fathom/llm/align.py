"""Op 11: alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers' tokens of a text lie on one byte axis (a space and the text). Every token points to the token that
reaches farthest right among those that overlap it; of two that end together the second tokenizer's counts. Chains
of pointers end at tokens behind which both tokenizers cut. Doubling (successor of the successor, for all tokens of
a batch at once, until nothing changes) leaves every token pointing at the last one of its component, which labels
the group. So runs of tokens between common cuts are found without walking a text.

Both tokenizers always cut before a single space between words, so a stretch from one such space to the next has
the same tokens and groups wherever it stands: every distinct stretch of a batch is encoded and aligned once, and
documents are put together from stretches (a second vocabulary with spaces inside its pieces has whole texts as
stretches). ``align`` stores token ids and group ends per document. A link is a pair of tokens, one of each tokenizer, that end
at the same byte: the last tokens of a group. Links are counted over the corpus per pair of ids. Of two tokens that
end together one is a suffix of the other, so there are at most as many pairs as suffixes in the vocabularies
(``pair_bound``, some hundred thousand, whatever the corpus); the counts go to all tasks on that ground.

Defined results: null and empty texts, and texts whose tokens' bytes do not spell a space and the text (the second
tokenizer cannot write every text back), have no tokens: zeros and an empty text for the groups. Texts of any length
are encoded whole; rows with the same doc_id are aligned one by one and count one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.bpe import byte_alphabet
from fathom.llm.textio import CACHE, docs_of, map_batches
from fathom.session import scratch_path

ROWS = 1024  # texts aligned or read back at once
BATCH_BYTES = 1 << 21  # and no more bytes than that, unless one text is longer
KEPT_TOKENS = 1 << 21  # tokens of cached stretches; a full cache is emptied, results never depend on it
JOINED = 4096  # new stretches encoded as one text
# A stretch that may stand before and behind others: a space and a word character first, no space last, no character
# that the second tokenizer may write back differently.
JOINABLE = re.compile(rb" [\x21-\x7E\xC3-\xDF][^\x00\xE2]*(?<! )\Z", re.DOTALL)
ALIGNED = "doc_id long, a_ids binary, b_ids binary, a_last binary, b_last binary"
# How the second vocabulary writes a space, and bytes.
BLANK, BYTE_PIECE = "▁", "<0x{:02X}>"


class ByteLevel:
    """A byte-level BPE file: ids of texts, bytes of ids. The file's tokens are ranked by id, its merges' order."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        self.coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        encode = self.coder.encode_to_numpy
        return [encode(t, disallowed_special=()) for t in texts]


class Pieces:
    """A sentencepiece model: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        single = {BYTE_PIECE.format(i): bytes([i]) for i in range(256)}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [single.get(p) or p.replace(BLANK, " ").encode() for p in pieces]
        # no piece goes on over a space that follows something else: texts may be cut there
        self.cuts_at_spaces = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Number of id pairs (one of each vocabulary) of which one token's bytes end with the other's."""
    def suffixes(longer: list[bytes], shorter: list[bytes], least: int) -> int:
        count: dict[bytes, int] = {}
        for t in shorter:
            if t:
                count[t] = count.get(t, 0) + 1
        return sum(count.get(t[i:], 0) for t in longer for i in range(least, len(t)))

    return suffixes(a, b, 0) + suffixes(b, a, 1)  # equal tokens counted once


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token, from the ascending end offsets of both tokenizers' tokens over the same bytes."""
    na, nb = len(a_ends), len(b_ends)
    # the token of the other kind that holds a token's last byte reaches farthest right of all that overlap it
    to_b = np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    successor = np.concatenate([na + to_b, np.where(a_ends[to_a] > b_ends, to_a, na + np.arange(nb))])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    last = successor - na  # terminal tokens are of the second kind
    group = np.cumsum(successor[na:] == na + np.arange(nb)) - 1
    return group[last[:na]], group[last[na:]]


class Table:
    """Bytes of ids as an Arrow array, to spell many ids at once."""

    def __init__(self, values: list[bytes]):
        self.values = pa.array(values, pa.large_binary())
        self.lengths = np.array([len(v) for v in values], np.int64)

    def spell(self, ids: np.ndarray) -> memoryview:
        out = self.values.take(pa.array(ids, pa.int64()))
        return memoryview(out.buffers()[2]).cast("B") if len(ids) and out.buffers()[2] is not None else memoryview(b"")


def _counted(n: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(n, dtype=np.int64))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start .. start + length - 1 of every entry, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


# First bytes of a character that is surely no white space: ASCII, or lead bytes under which Unicode has none.
STARTS_WORD = np.zeros(257, bool)
STARTS_WORD[0x21:0x7F] = True
STARTS_WORD[0xC3:0xF5] = True
STARTS_WORD[[0xE1, 0xE2, 0xE3]] = False


def stretches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches start: every text, and every single space between two words of a text."""
    space = np.append(data == 0x20, False)
    following = STARTS_WORD[np.append(data[1:], 256)] if len(data) else np.zeros(0, bool)
    cut = space[:-1] & following & ~np.append(True, space[:-2])[:len(data)]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Aligner:
    """Both tokenizers, and the tokens and group ends of the stretches seen so far."""

    def __init__(self, vocabulary: str, model: str):
        self.a, self.b = ByteLevel(vocabulary), Pieces(model)
        self.tables = Table(self.a.bytes), Table(self.b.bytes)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.spelled: list[np.ndarray] = []
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.last = [np.zeros(0, bool), np.zeros(0, bool)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # where a slot's tokens start, and the end

    def learn(self, new: list[bytes]) -> None:
        """Encodes and aligns distinct stretches. Those that may stand one after another go through the tokenizers as one
        long text, whose tokens are dealt back by their end offsets."""
        may = [s for s in new if JOINABLE.match(s)] if self.b.cuts_at_spaces else []
        alone = set(new).difference(may)
        todo = [may[i:i + JOINED] for i in range(0, len(may), JOINED)] + [[s] for s in alone]
        found: list[tuple] = []
        for run in todo:
            both = self._spelling(run)
            if both is None and len(run) > 1:
                todo += [[s] for s in run]
                continue
            found.append(both or ((np.zeros(0, np.uint32), np.zeros(1, np.int64)),) * 2)
            self.spelled.append(np.full(len(run), both is not None))
            for s in run:
                self.slot[s] = len(self.slot)
        for j in (0, 1):
            self.ids[j] = np.concatenate([self.ids[j], *(f[j][0] for f in found)])
            self.at[j] = np.concatenate([self.at[j], self.at[j][-1] + np.cumsum(np.concatenate([f[j][1] for f in found]))])
        flat = [self.ids[j][len(self.last[j]):] for j in (0, 1)]
        if len(flat[0]):
            groups = components(*(np.cumsum(t.lengths[f]) for t, f in zip(self.tables, flat)))
            self.last = [np.concatenate([old, np.append(np.diff(g) > 0, True)]) for old, g in zip(self.last, groups)]

    def _spelling(self, run: list[bytes]) -> list[tuple] | None:
        """By the first and by the second tokenizer: ids of some stretches that stand one after another, and how many
        each has; None if the ids of either do not spell them."""
        whole = b"".join(run)
        text, cuts, out = whole.decode(), np.cumsum([len(s) for s in run]), []
        for ids, table in zip((self.a.encode([text])[0], self.b.encode([text[1:]])[0]), self.tables):  # the second adds the space itself
            if bytes(table.spell(ids)) != whole:
                return None
            out.append((ids, np.diff(np.searchsorted(np.cumsum(table.lengths[ids]), cuts, "right"), prepend=0)))
        return out

    def texts(self, texts: list[str]) -> list[list[np.ndarray]]:
        """[ids, last of its group, tokens per text] by the first and by the second tokenizer."""
        if len(self.slot) > CACHE or max(map(len, self.ids)) > KEPT_TOKENS:
            self.clear()
        parts = [(" " + t).encode() if t else b"" for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = stretches(data, starts) if self.b.cuts_at_spaces else np.unique(starts[ends > starts])
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.slot]
        if new:
            self.learn(new)
        slot = np.array([self.slot[s] for s in distinct], np.int64)[found.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        first = np.searchsorted(at, np.append(starts, len(data)))
        if len(self.spelled) > 1:
            self.spelled = [np.concatenate(self.spelled)]
        bad = _counted(~self.spelled[0][slot]) if self.spelled else np.zeros(1, np.int64)
        slot = slot[np.repeat(bad[first[1:]] == bad[first[:-1]], np.diff(first))]  # all stretches of a text or none
        ok = bad[first[1:]] == bad[first[:-1]]
        per_text = _counted(np.where(ok, np.diff(first), 0))
        out = []
        for j in (0, 1):
            n = np.diff(self.at[j])[slot]
            where = _ragged(self.at[j][:-1][slot], n)
            out.append([self.ids[j][where], self.last[j][where], np.diff(_counted(n)[per_text])])
        return out


_loaded: dict = {}


def aligner(vocabulary: str, model: str) -> Aligner:
    """Loaded once per worker."""
    if (vocabulary, model) not in _loaded:
        _loaded[vocabulary, model] = Aligner(vocabulary, model)
    return _loaded[vocabulary, model]


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def align(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_last, b_last`` per document, stored: the ids as little-endian numbers (of two bytes,
    or four for vocabularies beyond that) and a bit per token that is set on the last of each group. ``groups`` has them as arrays."""

    def run(batch: pa.RecordBatch) -> dict:
        both, columns, start, size = aligner(vocabulary, model), [[], [], [], []], 0, 0
        kinds = [_id_type(len(both.a.bytes)), _id_type(len(both.b.bytes))]
        texts = batch.column("text").to_pylist()

        def close(part: list[str]) -> None:
            for j, (ids, last, n) in enumerate(both.texts(part)):
                at = _counted(n)
                raw = ids.astype(kinds[j])
                columns[j] += [raw[x:y].tobytes() for x, y in zip(at, at[1:])]
                columns[2 + j] += [np.packbits(last[x:y]).tobytes() for x, y in zip(at, at[1:])]

        for i, t in enumerate(texts):
            if size and size + len(t) > BATCH_BYTES:
                close(texts[start:i])
                start, size = i, 0
            size += len(t)
        close(texts[start:])
        return {"doc_id": batch.column("doc_id"), **dict(zip(("a_ids", "b_ids", "a_last", "b_last"), map(_binary, columns)))}

    path = scratch_path(docs.sparkSession, "aligned")
    map_batches(docs_of(docs, "doc_id", "text"), run, ALIGNED, ROWS).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _tokens(b: pa.RecordBatch, side: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, last of its group, where each row's tokens start and the last's end)."""
    raw = b.column(f"{side}_ids").to_pylist()
    at = _counted(np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize)
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(b.column(f"{side}_last").to_pylist(), np.diff(at))]
    return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.concatenate(bits).astype(bool), at


def groups(aligned: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_sizes, b_sizes``: ids, and how many of them each group holds, as arrays."""
    both = aligner(vocabulary, model)
    kinds = _id_type(len(both.a.bytes)), _id_type(len(both.b.bytes))

    def run(b: pa.RecordBatch) -> dict:
        out = {"doc_id": b.column("doc_id")}
        for side, kind in zip("ab", kinds):
            ids, last, at = _tokens(b, side, kind)
            out[f"{side}_ids"] = [ids[x:y] for x, y in zip(at, at[1:])]
            out[f"{side}_sizes"] = [np.diff(np.flatnonzero(last[x:y]), prepend=-1) for x, y in zip(at, at[1:])]
        return out

    return map_batches(aligned, run, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>", ROWS)


def link_counts(aligned: DataFrame, kinds: tuple[str, str], pieces: int) -> DataFrame:
    """``a_id, b_id, n, best`` of every pair of ids that a link holds, counted over the corpus: first in each batch,
    then in Spark. best: no other pair of the b_id counts more. ``pieces``: size of the second vocabulary."""

    def run(b: pa.RecordBatch) -> dict:
        (a_ids, a_last, _), (b_ids, b_last, _) = _tokens(b, "a", kinds[0]), _tokens(b, "b", kinds[1])
        code, n = np.unique(a_ids[a_last] * pieces + b_ids[b_last], return_counts=True)
        return {"code": code, "n": n}

    counts = map_batches(aligned.drop("doc_id"), run, "code long, n long", ROWS).groupBy("code").agg(F.sum("n").alias("n"))
    path = scratch_path(aligned.sparkSession, "links")
    counts.write.parquet(path)
    counts = aligned.sparkSession.read.parquet(path)
    pair = counts.select(F.floor(F.col("code") / pieces).cast("int").alias("a_id"), F.pmod("code", F.lit(pieces)).cast("int").alias("b_id"), "n")
    top = pair.groupBy("b_id").agg(F.max("n").alias("top"))
    return pair.join(top, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def spelled_groups(a: tuple, b: tuple, digits: tuple[Table, int]) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the groups of all given tokens (ids, last of its group), with ``;`` after the last one,
    too; and where each token's text starts."""
    (a_ids, a_last), (b_ids, b_last) = a, b
    table, span = digits
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_upto, b_upto = np.append(np.flatnonzero(a_last) + 1, 0), _counted(np.diff(np.flatnonzero(b_last), prepend=-1))
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + b_upto[a_group]] = a_ids + a_last * span  # a group's last one is followed by |
    order[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids + b_last * (2 * span)  # or ;
    return table.spell(order), _counted(table.lengths[order])


def digits_table(size: int) -> tuple[Table, int]:
    """Decimal ids followed by a comma, a bar or a semicolon."""
    return Table([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(size)]), size


def summary(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document."""
    spark = docs.sparkSession
    both = aligner(vocabulary, model)
    a, b = both.a.bytes, both.b.bytes
    pieces, size, kinds, bound = len(b), max(len(a), len(b)), (_id_type(len(a)), _id_type(len(b))), pair_bound(a, b)
    aligned = align(docs, vocabulary, model)
    rows = link_counts(aligned, kinds, pieces).toArrow()
    if rows.num_rows > bound:
        raise ValueError(f"{rows.num_rows} pairs of ids end together; the vocabularies allow {bound}")
    code = rows.column("a_id").to_numpy().astype(np.int64) * pieces + rows.column("b_id").to_numpy()
    order = np.argsort(code)
    counts = spark.sparkContext.broadcast((code[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order]))
    digits: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not digits:
            digits.append(digits_table(size))
        codes, n, best = counts.value
        (a_ids, a_last, a_at), (b_ids, b_last, b_at) = _tokens(batch, "a", kinds[0]), _tokens(batch, "b", kinds[1])
        where = np.searchsorted(codes, a_ids[a_last] * pieces + b_ids[b_last])
        links = _counted(a_last)[a_at]  # one a group
        per_row = lambda x: np.diff(_counted(x)[links])
        text, ends = spelled_groups((a_ids, a_last), (b_ids, b_last), digits[0])
        cut = ends[a_at + b_at]
        sums = [sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:])]
        return {"doc_id": batch.column("doc_id"), "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(links), "n_links": np.diff(links),
                "n_best": per_row(best[where]), "count_sum": per_row(n[where]), "groups_sha256": sums}

    return map_batches(aligned, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", ROWS)
