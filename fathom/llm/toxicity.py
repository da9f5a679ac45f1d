"""Op 10: toxicity by a convolutional text classifier over hashed word embeddings, in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first four letters. Filters of one, two
and three words run over the whole text, the largest response of each filter over all places feeds a logistic
layer. The language of a text is guessed from its own function words; every language gets a threshold, and scores
are shifted so that a language's threshold lies at ``CUT``.

The network is fitted on a bounded sample of labelled rows (``max_docs`` per class, ``max_words`` words together; every
fourth row of it is left out). The thresholds come from all labelled rows that it was not fitted on: Spark counts them
by language, score (in steps of 1/``STEPS`` of the logit) and label, and each class weighs as much as its share of all
labelled rows of the language. Held-out rows (crc32 of doc_id mod 3 is 1) serve neither. Scores depend on the text
alone and cover every row.

Defined results: null or empty text has no words and gets the score of an all-zero response; texts of any
length are scored whole; repeated rows are scored alike; without labelled rows of both classes all scores are
0.5; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import CACHE, bounded_rows, docs_of, map_batches

SLOTS, DIM, FILTERS, WIDTHS, LETTERS, CUT = 1 << 15, 8, 6, (1, 2, 3), (None, 4), 0.7
STEPS, APART, MIN_ROWS = 128, 4, 50
PARTS = len(LETTERS)
# Frequent function words of four languages; a text with none of them is of language 4.
FUNCTION_WORDS = (
    ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with"),
    ("der", "die", "und", "den", "das", "nicht", "von", "mit", "ist", "ein"),
    ("le", "les", "et", "des", "une", "est", "dans", "qui", "pour", "du"),
    ("el", "los", "y", "las", "por", "con", "para", "una", "del", "su"),
)
LANGUAGES = len(FUNCTION_WORDS) + 1


class WordSlots(dict):
    """word -> its slots as digits of base SLOTS, then the mark of a function word; emptied when full."""

    MARKS = {w: k + 1 for k, ws in enumerate(FUNCTION_WORDS) for w in ws}

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        w = raw.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}#*$%&|<>-_")
        v = self.MARKS.get(w, 0)
        for k, n in enumerate(LETTERS):
            v = v * SLOTS + xxhash.xxh3_64_intdigest(w[:n], seed=k) % SLOTS
        self[raw] = v
        return v

    def of(self, text: str) -> np.ndarray:
        words = text.encode().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split_slots(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of the embedding table, one array per part of the word."""
    return [codes // SLOTS**k % SLOTS + k * SLOTS for k in range(PARTS)]


def language(codes: np.ndarray) -> int:
    marks = np.bincount(codes // SLOTS**PARTS, minlength=LANGUAGES)[1:]
    return int(marks.argmax()) if marks.any() else LANGUAGES - 1


@dataclass
class Model:
    table: np.ndarray  # PARTS * SLOTS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    offsets: list[np.ndarray]  # per width: FILTERS
    out: np.ndarray
    bias: float
    shift: np.ndarray  # per language, added to the logit

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.table[rows] for rows in split_slots(codes))

    def taps(self, codes: np.ndarray) -> np.ndarray:
        """Response of every filter place to every word: words x (sum of widths * FILTERS)."""
        return self.vectors(codes) @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pooled(self, taps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Largest response per filter and text (0 where a text is shorter than the filter or none is positive)."""
        out, col = [], 0
        n = len(taps)
        for f, c in zip(self.filters, self.offsets):
            k = len(f)
            best = np.zeros((len(sizes), FILTERS), np.float32)
            if n >= k:
                r = sum(taps[j:n - k + 1 + j, col + j * FILTERS:col + (j + 1) * FILTERS] for j in range(k)) + c
                full = np.flatnonzero(sizes >= k)
                if len(full):
                    edges = np.stack([starts[full], starts[full] + sizes[full] - k + 1], 1).reshape(-1)
                    r = np.concatenate([r, np.zeros((1, FILTERS), r.dtype)])  # reduceat wants an end inside
                    best[full] = np.maximum(np.maximum.reduceat(r, edges, axis=0)[::2], 0)
            out.append(best)
            col += k * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language) per text."""
        sizes = np.array([len(d) for d in docs], np.int64)
        codes = np.concatenate(docs) if len(docs) else np.empty(0, np.int64)
        distinct, at = np.unique(codes, return_inverse=True)
        taps = self.taps(distinct)[at] if len(distinct) else np.empty((0, FILTERS * sum(WIDTHS)), np.float32)
        spoken = np.array([language(d) if len(d) else LANGUAGES - 1 for d in docs], np.int64)
        z = self.pooled(taps, np.cumsum(sizes) - sizes, sizes) @ self.out + self.bias
        return np.clip(z + self.shift[spoken], -40, 40), spoken

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.logits(docs)[0]))


def train_network(docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.1, seed: int = 10, min_docs: int = 3) -> Model:
    """Adagrad on the log loss; only the words at the places of the largest responses get a gradient. Slots seen
    in fewer than ``min_docs`` documents stay at zero, so that no document is learnt by its rare words."""
    rng = np.random.default_rng(seed)
    f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    m = Model(f32(PARTS * SLOTS, DIM, scale=0.1), [f32(k, DIM, FILTERS, scale=0.3) for k in WIDTHS],
              [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f32(len(WIDTHS) * FILTERS, scale=0.3), 0.0, np.zeros(LANGUAGES))
    seen = np.zeros(PARTS * SLOTS, np.int64)
    for d in docs:
        seen[np.unique(np.concatenate(split_slots(d)))] += 1
    m.table[seen < min_docs] = 0
    speed = {id(p): np.full(p.shape, 1e-4, np.float32) for p in (m.table, m.out, *m.filters, *m.offsets)}
    bias_speed = 1e-4

    def move(p: np.ndarray, g: np.ndarray) -> None:
        s = speed[id(p)]
        s += g * g
        p -= rate * g / np.sqrt(s)

    def move_rows(p: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        known = seen[rows] >= min_docs
        rows, at = np.unique(rows[known], return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, at, g[known])
        s = speed[id(p)]
        s[rows] += total * total
        p[rows] -= rate * total / np.sqrt(s[rows])

    for _ in range(max(epochs, min(24, 16_000 // max(1, len(docs))))):  # small samples: up to three times as often
        turn = rng.permutation(len(docs))
        for i in range(0, len(turn), batch):
            some = turn[i:i + batch]
            pooled = np.zeros((len(some), len(m.out)), np.float32)
            places = np.full((len(some), len(m.out)), -1)
            vectors = []
            for r, d in enumerate(some):
                e = m.vectors(docs[d])
                vectors.append(e)
                for w, (f, c) in enumerate(zip(m.filters, m.offsets)):
                    k = len(f)
                    if len(e) >= k:
                        resp = sum(e[j:len(e) - k + 1 + j] @ f[j] for j in range(k)) + c
                        top = resp.argmax(0)
                        best = resp[top, np.arange(FILTERS)]
                        cols = slice(w * FILTERS, (w + 1) * FILTERS)
                        pooled[r, cols] = np.maximum(best, 0)
                        places[r, cols] = np.where(best > 0, top, -1)
            z = pooled @ m.out + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            err = ((p - y[some]) / len(some)).astype(np.float32)
            g_pool = err[:, None] * m.out
            g_out, g_bias = pooled.T @ err, float(err.sum())
            g_f, g_c = [np.zeros_like(f) for f in m.filters], [np.zeros_like(c) for c in m.offsets]
            rows, g_e = [], []
            for r, col in zip(*np.nonzero(places >= 0)):
                w, q = divmod(int(col), FILTERS)
                f, at, g = m.filters[w], places[r, col], g_pool[r, col]
                k = len(f)
                g_f[w][:, :, q] += g * vectors[r][at:at + k]
                g_c[w][q] += g
                for part in split_slots(docs[some[r]][at:at + k]):
                    rows.append(part)
                    g_e.append(g * f[:, :, q])
            if g_e:
                move_rows(m.table, np.concatenate(rows), np.concatenate(g_e))
            move(m.out, g_out)
            for p_, g_ in (*zip(m.filters, g_f), *zip(m.offsets, g_c)):
                move(p_, g_)
            bias_speed += g_bias * g_bias
            m.bias -= rate * g_bias / np.sqrt(bias_speed)
    return m


def threshold(steps: np.ndarray, y: np.ndarray, n: np.ndarray, shares: np.ndarray) -> float | None:
    """The logit with the best F1, midway between neighbours, from counts ``n`` of (step, label) where class c weighs
    ``shares[c]`` together; None without rows of both classes."""
    sums = np.array([n[y == c].sum() for c in (0, 1)], float)
    if not (sums.all() and shares.all()):
        return None
    values, at = np.unique(steps, return_inverse=True)
    weights = np.zeros((2, len(values)))
    np.add.at(weights, (y, at), n * (shares / sums)[y])
    clean, toxic = weights[:, ::-1].cumsum(1)  # from the highest score down
    values = values[::-1]
    i = int((2 * toxic / (clean + toxic + shares[1])).argmax())
    low = values[i + 1] + 1 if i + 1 < len(values) else values[i] - STEPS
    return float((values[i] + low) / 2 / STEPS)


def calibrate(m: Model, docs: DataFrame, known: DataFrame, fitted: list[int]) -> None:
    """Thresholds from all rows of ``known`` but the fitted ones, moved to CUT. Texts outside the held-out fold, which
    ``known`` has no rows of, are scored where they are and only (doc_id, language, step) meet the labels."""
    slots = WordSlots()

    def run(b):
        z, spoken = m.logits([slots.of(t) for t in b.column("text").to_pylist()])
        return {"doc_id": b.column("doc_id"), "spoken": spoken, "step": np.floor(z * STEPS).astype(np.int64)}

    scored = map_batches(docs_of(docs, "doc_id", "text").where(_fold(F.col("doc_id")) != 1), run, "doc_id bigint, spoken int, step int")
    used = F.broadcast(docs.sparkSession.createDataFrame([(i, True) for i in set(fitted)], "doc_id long, fitted boolean"))
    rows = scored.join(known, "doc_id").join(used, "doc_id", "left").groupBy("spoken", "step", "toxic", F.col("fitted").isNotNull().alias("fitted")).count().collect()
    spoken, step, y, seen, n = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 5).T

    def cut(of: np.ndarray) -> float | None:
        free = of & (seen == 0)
        return threshold(step[free], y[free], n[free], np.array([n[of & (y == c)].sum() for c in (0, 1)], float))

    general = cut(np.ones(len(n), bool))
    for k in range(LANGUAGES):
        of = spoken == k
        t = cut(of) if n[of & (seen == 0)].sum() >= MIN_ROWS else None
        m.shift[k] = np.log(CUT / (1 - CUT)) - (t if t is not None else general or 0.0)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_words: int = 2_000_000) -> Model | None:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (_fold(F.col("doc_id")) != 1)).dropDuplicates(["doc_id"])
    parts = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for v in (0, 1)]
    chosen = docs_of(docs, "doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    slots = WordSlots()

    def run(b):
        codes = [slots.of(t) for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "n": [len(c) for c in codes], "codes": codes}

    rows = bounded_rows(map_batches(chosen, run, "doc_id bigint, toxic int, n bigint, codes array<bigint>"), max_words)
    if len({r.toxic for r in rows}) < 2:
        return None
    fit = [r for i, r in enumerate(rows) if i % APART != APART - 1]
    m = train_network([np.array(r.codes, np.int64) for r in fit], np.array([r.toxic for r in fit]))
    calibrate(m, docs, known, [r.doc_id for r in fit])
    return m


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    slots = WordSlots()

    def run(b):
        codes = [slots.of(t) for t in b.column("text").to_pylist()]
        s = model.scores(codes) if model else np.full(len(codes), 0.5)
        return {"doc_id": b.column("doc_id"), "score": s.astype(np.float64)}

    out = map_batches(docs_of(docs, "doc_id", "text"), run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
