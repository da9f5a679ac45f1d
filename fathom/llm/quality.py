"""Op 6: quality rules by line sequence labelling with a linear-chain conditional random field.

Each line with a word is described by a few counts; Viterbi decoding labels the lines of a text as content or
boilerplate, and the share of words in content lines decides whether the document stays. Base rules come
first: too few words or too many repeated 8-word windows reject a text whatever its labels are.

The model is fitted in numpy on a bounded sample of labelled rows (``max_docs`` per class, the first by a hash
of doc_id, until ``max_lines`` lines): lines of documents of quality 1 count as content, of quality 0 as
boilerplate, and the transitions carry a verdict over lines that could be either. A class weighs as much in the fit as
it has labelled documents in the whole table, whatever its part of the sample is. All else covers all rows.

Defined results: null or empty text has no words and fails the base rules; a text of any length is labelled
whole; repeated rows are judged one by one; without labelled rows of both classes every line is content; an
empty table gives an empty result; other columns pass ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import WordHashes, bounded_rows, docs_of, map_batches, mix, numbered_columns, slices, tidy, window_hashes

KEEP_ROWS = 128  # rows judged at once beside all their columns; bounds the line features held in a task
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, DIGITS, SHOUT = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
N_FEATURES = 9


@dataclass
class Crf:
    """Emission weights (2 labels x features), transitions, feature means and deviations, share to stay."""

    emit: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    share: float = 0.5


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    n, size = len(words), max(1, len(line))
    return [
        np.log1p(n),
        (len(line) - len(line.translate(None, SYMBOLS))) / n,
        (len(line) - len(line.translate(None, UPPER))) / size,
        (len(line) - len(line.translate(None, DIGITS))) / size,
        (len(line) - len(line.translate(None, SHOUT))) / n,
        1.0 - len(set(words)) / n,
        size / n,
        float(again),
        1.0,
    ]


def lines_of(data: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word; number of lines equal to an earlier one."""
    feats, sizes, seen, dup = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again))
            sizes.append(len(words))
    return feats, sizes, dup


def repeat_words(texts: pa.Array, hashes: WordHashes, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its words, and those inside k-word windows that the text holds twice or more."""
    h, sizes = hashes.columns(texts)
    total = len(h)
    out = np.zeros(len(sizes), np.int64)
    if total < k:
        return sizes, out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    win = window_hashes(h, k)
    at = np.flatnonzero(np.arange(len(win)) + k <= ends[doc[:len(win)]])
    key = mix(win[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + k, -1)
    covered = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
    np.add.at(out, doc, covered)
    return sizes, out


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Longest first: order, the documents' rows at each place (shrinking), lengths."""
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.empty((0, 2))
    start = np.cumsum(lengths[order]) - lengths[order]
    places = [start[:np.count_nonzero(lengths > t)] + t for t in range(int(lengths.max(initial=0)))]
    return order, [flat[p] for p in places], lengths


def viterbi(scores: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """Best label sequence of each document from its lines' scores (lines x labels); ties go to label 0 first."""
    order, at, lengths = _padded(scores)
    if not at:
        return [np.empty(0, np.int64) for _ in scores]
    best, back, ends = at[0], [], np.zeros((len(scores), 2))
    ends[:len(best)] = best
    for row in at[1:]:
        n = len(row)
        options = best[:n, :, None] + step
        back.append(options.argmax(1))
        best = options.max(1) + row
        ends[:n] = best
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    labels = ends.argmax(1)
    paths = np.zeros((len(scores), len(at)), np.int8)
    sorted_len = lengths[order]
    for t in range(len(at) - 1, -1, -1):
        n = len(at[t])
        if t < len(back):
            m = back[t].shape[0]
            labels[:m] = back[t][np.arange(m), labels[:m]]
        paths[:n, t] = labels[:n]
    for i, d in enumerate(order):
        out[d] = paths[i, :sorted_len[i]].astype(np.int64)
    return out


def fit(docs: list[np.ndarray], good: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3) -> Crf:
    """Conditional likelihood, a document's part times its weight, by gradient ascent; forward and backward sums run
    over all documents at once."""
    flat = np.concatenate(docs)
    lines = np.repeat(weight, [len(d) for d in docs])
    mean = np.average(flat, 0, lines)
    dev = np.sqrt(np.average((flat - mean) ** 2, 0, lines)) + 1e-6
    mean[-1], dev[-1] = 0.0, 1.0
    docs = [(d - mean) / dev for d in docs]
    order, at, _ = _padded(docs)
    y, w = good[order], weight[order]
    emit, step = np.zeros((2, flat.shape[1])), np.zeros((2, 2))
    speed_e, speed_s = np.zeros_like(emit), np.zeros_like(step)
    total = lines.sum()
    for _ in range(rounds):
        score = [x @ emit.T for x in at]
        alpha = [score[0]]
        for s in score[1:]:
            m = alpha[-1][:len(s), :, None] + step
            alpha.append(np.logaddexp(m[:, 0], m[:, 1]) + s)
        beta = [np.zeros_like(s) for s in score]
        g_e, g_s = np.zeros_like(emit), np.zeros_like(step)
        for t in range(len(at) - 1, -1, -1):
            n = len(at[t])
            if t + 1 < len(at):
                m = len(at[t + 1])
                nxt = (score[t + 1] + beta[t + 1])[:, None, :] + step
                beta[t][:m] = np.logaddexp(nxt[:, :, 0], nxt[:, :, 1])
                pair = alpha[t][:m, :, None] + nxt
                pair = np.exp(pair - pair.max((1, 2), keepdims=True))
                pair /= pair.sum((1, 2), keepdims=True)
                real = np.zeros((2, 2))
                real[0, 0], real[1, 1] = w[:m][y[:m] == 0].sum(), w[:m][y[:m] == 1].sum()
                g_s += real - (pair * w[:m, None, None]).sum(0)
            p = alpha[t] + beta[t]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g_e += ((np.eye(2)[y[:n]] - p) * w[:n, None]).T @ at[t]
        speed_e = 0.8 * speed_e + g_e / total - decay * emit
        speed_s = 0.8 * speed_s + g_s / total - decay * step
        emit, step = emit + rate * speed_e, step + rate * speed_s
    return Crf(emit, step, mean, dev)


def labelled(labels: DataFrame, label: str) -> DataFrame:
    return labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1)).dropDuplicates(["doc_id"])


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """``doc_id, text, <label>`` of the first ``max_docs`` labelled documents of each class by a hash of doc_id."""
    known = labelled(labels, label)
    parts = [known.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for v in (0, 1)]
    return docs_of(docs, "doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_lines: int = 40_000) -> Crf | None:
    def run(b):
        rows = [lines_of(t.encode())[0] for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "quality": b.column("quality"), "n": [len(r) for r in rows], "x": [[v for line in r for v in line] for r in rows]}

    rows = bounded_rows(map_batches(sample(docs, labels, "quality", max_docs), run, "doc_id bigint, quality int, n bigint, x array<double>"), max_lines)
    ys = np.array([r.quality for r in rows if r.n], int)
    if len(set(ys)) < 2:
        return None
    counts = docs.select("doc_id").join(labelled(labels, "quality"), "doc_id").groupBy("quality").count().collect()
    weights = np.zeros(2)
    for r in counts:
        weights[r.quality] = r["count"] / sum(s.quality == r.quality for s in rows)
    return fit([np.array(r.x).reshape(-1, N_FEATURES) for r in rows if r.n], ys, weights[ys])


def assess(texts: list[str], model: Crf | None, hashes: WordHashes) -> dict[str, list]:
    """The rules' columns for a list of texts."""
    raw = [t.encode() for t in texts]
    sizes, repeat = repeat_words(pa.array(texts, pa.string()), hashes)
    found = [lines_of(b) for b in raw]
    if model is None:
        content = [sum(s) for _, s, _ in found]
    else:
        scores = [((np.array(x) - model.mean) / model.dev) @ model.emit.T if x else np.empty((0, 2)) for x, _, _ in found]
        content = [int(np.dot(path, s)) if s else 0 for path, (_, s, _) in zip(viterbi(scores, model.step), found)]
    n = sizes.tolist()
    failed = [k < MIN_WORDS or 100 * int(r) > MAX_REPEAT_PCT * k for k, r in zip(n, repeat)]
    share = [c / k if k else 0.0 for c, k in zip(content, n)]
    return {
        "n_words": n,
        "word_chars": [len(t) - (len(b) - len(b.translate(None, BLANKS))) for t, b in zip(texts, raw)],
        "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in raw],
        "n_dup_lines": [d for _, _, d in found],
        "n_repeat_words": repeat.tolist(),
        "base_failed": failed,
        "content_share": share,
        "kept": [not f and s >= (model.share if model else 0.0) for f, s in zip(failed, share)],
    }


def judge(docs: DataFrame, model: Crf | None) -> DataFrame:
    """The rules' figures and verdict per document."""
    hashes = WordHashes()

    def run(b):
        return {"doc_id": b.column("doc_id"), **assess(b.column("text").to_pylist(), model, hashes)}

    return map_batches(docs_of(docs, "doc_id", "text"), run,
                       "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                       "n_repeat_words bigint, base_failed boolean, kept boolean, content_share double")


def keep_good(docs: DataFrame, model: Crf | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, whatever their names."""
    hashes, at, rows = WordHashes(), docs.columns.index("text"), numbered_columns(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, KEEP_ROWS):
                texts = [t or "" for t in s.column(at).to_pylist()]
                yield s.filter(pa.array(assess(texts, model, hashes)["kept"], pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)
