"""Op 1: BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut where a space precedes a non-space; the tokenizer's split pattern always breaks there, so
every piece can be encoded alone. The distinct pre-tokens of a batch form a trie, walked depth first. Every
node (prefix) has one state: the last token of the prefix's encoding. The prefix ending at depth d ends with
the token t if t is a suffix of the prefix and may stand after the last token of the prefix that remains;
exactly one suffix qualifies, so a word's ids are read back from its leaf, and shared prefixes are computed
once. Sorted words visit a trie's nodes in depth-first order, so the walk keeps one path of states and goes
back to the common prefix with the next word.

Defined results: null text counts as empty (no ids); any text, however long, is encoded whole; rows with the
same doc_id are encoded one by one; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fathom.llm.textio import CACHE, LOADED, docs_of, map_batches

ROWS = 2048  # texts encoded at once: the more, the more often a piece is looked up for several places
SPACE_BEFORE_SPACE = re.compile(r" (?!\S)")
CUT = re.compile(r"(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        self.id: dict[bytes, int] = {}
        for t, i in ids.items():
            self.bytes[i] = raw[t]
            self.id[raw[t]] = i
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank = [-1] * size  # merge that makes the token; -1: a single byte
        self.left, self.right = [0] * size, [0] * size
        self.merge: dict[int, int] = {}  # left * size + right -> rank
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merge[x * size + y] = r
            self.rank[made], self.left[made], self.right[made] = r, x, y
        self.size = size
        self.endings: list = [-1, {}]  # tokens read backwards; a node: token that it completes or -1, next nodes by byte
        for b, i in self.id.items():
            node = self.endings
            for c in reversed(b):
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.length = [len(b) for b in self.bytes]
        self.decimal = [str(i) for i in range(size)]
        self.follows: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a in an encoding.

        Undo the later of the two tokens' merges step by step; the pair breaks if, in a state on the way, the
        two parts that touch would have merged before the next undone merge took one of them away. Merges of
        equal rank run from left to right.
        """
        rank, merge, size = self.rank, self.merge, self.size
        limit = len(merge)
        while True:
            r = merge.get(a * size + b)
            if r is not None and r < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as little-endian uint32 bytes."""
        order = sorted((w.encode(), w) for w in words)
        packed, length = self.packed, self.length
        size, follows, endings = self.size, self.follows, self.endings[1].get
        if len(follows) >= 2 * CACHE:
            follows.clear()
        last: list[int] = [-1]  # last[d]: last token of the current word's prefix of d bytes
        out: dict[str, bytes] = {}
        before = b""
        for b, w in order:
            n, shared = len(b), 0
            top = min(n, len(before))
            while shared < top and b[shared] == before[shared]:
                shared += 1
            del last[shared + 1:]
            for d in range(shared + 1, n + 1):
                starts, tokens, step, at = [], [], endings, d
                while at:
                    at -= 1
                    node = step(b[at])
                    if node is None:
                        break
                    t, nodes = node
                    step = nodes.get
                    if t >= 0:
                        starts.append(at)
                        tokens.append(t)
                while True:
                    at, t = starts.pop(), tokens.pop()
                    if not at:
                        break
                    key = last[at] * size + t
                    ok = follows.get(key)
                    if ok is None:
                        ok = follows[key] = self.may_follow(last[at], t)
                    if ok:
                        break
                last.append(t)
            ids, d = [], n
            while d:
                t = last[d]
                ids.append(packed[t])
                d -= length[t]
            ids.reverse()
            out[w] = b"".join(ids)
            before = b
        return out


class Recent:
    """Bounded cache of two generations: a full young one becomes the old one; what is used again stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def recall(self, keys: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """The generation that holds all known keys, and the keys that are to be added to it."""
        young, old, new = self.young, self.old, []
        for x in [x for x in keys if x not in young]:
            v = old.get(x)
            if v is None:
                new.append(x)
            else:
                young[x] = v
        return young, new

    def turn(self) -> dict[str, bytes]:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        return self.young


class PieceEncoder:
    """Whole texts -> ids. Pieces and pre-tokens seen before come from bounded caches."""

    def __init__(self, path: str, encode_words: Callable[[Iterable[str]], dict[str, bytes]], special: dict[str, int],
                 whole_pieces: bool = False, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.encode_words = encode_words
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.whole_pieces = whole_pieces
        self.words, self.pieces = Recent(cache // 2), Recent(cache)

    def _words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece, or spans of them that can be encoded alone. A line break between two characters
        that are no white space is a pre-token of its own."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if len(body) > 1 and body[-1] in ".,:;!?|" and body[:-1].isalpha():
            return [piece[:-1], body[-1]]
        if "\n" in body:
            lines = body.split("\n")
            if all(x and len(x.split()) == 1 and x == x.strip() for x in lines):
                lines[0] = piece[:len(piece) - len(body)] + lines[0]
                return [w for x in lines for w in ("\n", *self._words(x))][1:]
        if self.whole_pieces:
            return [piece]
        return [piece[a:b] for _, (a, b) in self.pre.pre_tokenize_str(piece)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Head piece first; each other item stands for a space and the item."""
        if SPACE_BEFORE_SPACE.search(text):
            head, *rest = CUT.split(text)
            return [head, *(p[1:] for p in rest)] if not CUT.match(text) else ["", *(p[1:] for p in [head, *rest] if p)]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes. Arrow splits the texts and numbers the distinct pieces;
        those are looked up or encoded, and numpy lays their ids out in the order of the pieces."""
        out: list[bytes] = [b""] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            (odd if SPACE_BEFORE_SPACE.search(text) or any(s in text for s in self.special) else plain).append(i)
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        piece = numbered.indices.to_numpy().copy()  # 32 bits, as all that follows: a batch is far smaller
        first = lists.offsets.to_numpy()[:-1]
        follows = np.ones(len(piece), bool)
        follows[first] = False
        distinct = numbered.dictionary.to_pylist()
        used = np.flatnonzero(np.bincount(piece[follows], minlength=len(distinct))).tolist()
        cuts = {i: [self._cut(part) if k % 2 == 0 else part for k, part in enumerate(self.cut_special.split(texts[i]) if self.cut_special else [texts[i]])] for i in odd}
        plain_keys = [distinct[j] for j in used]
        heads = {distinct[j] for j in piece[first].tolist()}
        after = set()
        for parts in cuts.values():
            for p in parts[::2]:
                heads.add(p[0])
                after.update(p[1:])
        known, top = self._lookup(list(after.union(plain_keys)) if after else plain_keys, heads)
        ids = [b""] * len(distinct)
        for j, v in zip(used, map(known.__getitem__, plain_keys)):
            ids[j] = v
        ids += [top[distinct[j]] for j in piece[first].tolist()]
        piece[first] = np.arange(len(distinct), len(ids))
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[piece]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        at += np.repeat(start[piece] - (ends - n), n)
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        stop = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        for k, i in enumerate(plain):
            out[i] = flat[stop[k]:stop[k + 1]].tobytes()
        for i, parts in cuts.items():
            out[i] = b"".join([self.special[p] if k % 2 else top[p[0]] + b"".join([known[x] for x in p[1:]]) for k, p in enumerate(parts)])
        return out

    def _lookup(self, after: list[str], heads: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of pieces that follow a space, and of pieces that start a text."""
        self.words.turn()
        self.pieces.turn()
        known, new = self.pieces.recall(after)
        fresh = {x: self._words(" " + x) for x in new}
        tops = {x: self._words(x) if x else [] for x in heads}
        words, todo = self.words.recall({w for ws in (*fresh.values(), *tops.values()) for w in ws})
        words.update(self.encode_words(todo))
        for x, ws in fresh.items():
            known[x] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        return known, {x: b"".join([words[w] for w in ws]) for x, ws in tops.items()}


def load(path: str) -> tuple[Vocabulary, PieceEncoder]:
    """Vocabulary and encoder of a task, read once per Python worker and held until a task of another kind runs there."""
    if path not in LOADED:
        v = Vocabulary(path)
        LOADED[path] = v, PieceEncoder(path, v.encode_words, v.special)
    return LOADED[path]


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, special-token strings recognised, none added."""

    def run(b):
        _, enc = load(vocab_path)
        ids = enc.encode_batch(b.column("text").to_pylist())
        return {"doc_id": b.column("doc_id"), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]}

    return map_batches(docs_of(docs, "doc_id", "text"), run, "doc_id bigint, ids array<int>", ROWS, keep=True)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that form no character become U+FFFD."""

    def run(b):
        v, _ = load(vocab_path)
        text = [b"".join(map(v.bytes.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
        return {"doc_id": b.column("doc_id"), "text": text}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", keep=True)


def round_trip(docs: DataFrame, vocab_path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass; digests of the ids and of the decoded text per document, and the ids if asked for."""

    def run(b):
        v, enc = load(vocab_path)
        n, d_ids, d_text, out = [], [], [], []
        for raw in enc.encode_batch(b.column("text").to_pylist()):
            ids = np.frombuffer(raw, "<u4").tolist()
            n.append(len(ids))
            if with_ids:
                out.append(np.frombuffer(raw, "<u4").astype(np.int32))
            d_ids.append(sha256(",".join(map(v.decimal.__getitem__, ids)).encode()).hexdigest())
            text = b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace")
            d_text.append(sha256(text.encode()).hexdigest())
        return {"doc_id": b.column("doc_id"), "n_tokens": n, "ids_sha256": d_ids, "decoded_sha256": d_text} | ({"ids": out} if with_ids else {})

    return map_batches(docs_of(docs, "doc_id", "text"), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), ROWS, keep=True)
