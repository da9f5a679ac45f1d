"""Small cases and brute force for the operators that read texts."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, k string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vocab():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab())


ODD = [None, "", " ", "  ", "a", " a", "a  b", "a \n b\n\n", "don't I'LL 's", "x" * 4000, "=" * 3000, "é漢字😀 　  \x1c\x85",
       "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "１２٣ 4", "same", "same", "word.\nWord, word\n\nword"]


def some_text(seed, n=3000):
    rng = random.Random(seed)
    return "".join(rng.choice("abc dé.,\n\t 's<|>endoftx12 ") for _ in range(n))


def test_bpe_equals_library(spark):
    from fathom.llm import bpe

    texts = ODD + [some_text(i) for i in range(20)]
    t = library()
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), vocab(), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, texts), vocab()), vocab())
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.round_trip(frame(spark, texts).limit(0), vocab()).count() == 0


def test_decode_of_any_ids(spark):
    from fathom.llm import bpe

    rng = random.Random(1)
    rows = [(i, [rng.randrange(50257) for _ in range(30)]) for i in range(200)] + [(200, None)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocab()).collect()}
    t = library()
    assert all(got[i] == (t.decode(ids, skip_special_tokens=False) if ids else "") for i, ids in rows)


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bit_packing(width):
    from fathom.llm.tokenfile import pack, unpack

    ids = np.random.default_rng(width).integers(0, 2**width, 1003, dtype=np.uint64).astype("<u4")
    data = pack(ids, width)
    assert len(data) == -(-1003 * width // 8) and (unpack(data, 1003, width) == ids).all()


def test_token_file_random_access(tmp_path):
    from pyarrow import fs

    from fathom.llm.tokenfile import Reader, Writer

    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (0, 1, 700, 0, 3000, 5)]
    local = fs.LocalFileSystem()
    w = Writer(local.open_output_stream(str(tmp_path / "f")), 13, block=256)
    for i, d in enumerate(docs):
        w.add(i * 10, d)
    w.close()
    with local.open_input_file(str(tmp_path / "f")) as f:
        r = Reader(f)
        whole = np.concatenate(docs)
        assert r.n_ids == len(whole) and (r.ids(300, 1900) == whole[300:1900]).all()
        assert all(i == j * 10 and (x == docs[j]).all() for j, (i, _, x) in enumerate(r.documents(ids_at_once=100)))


def test_long_runs_of_pieces_equal_the_library():
    """Random texts of white space, marks, contractions and marks of other scripts, special tokens among them."""
    import numpy as np

    from fathom.llm.tokenfile import library_encoder

    rng, path = random.Random(7), vocab()
    bits = [" ", " ", " ", "  ", "\n", "\r\n", "\t", "\x85", "\u00a0", "\u3000", "\u200b", "a", "word", "Ther.", "it's", "'ll", "%%%", "&&", "12", "\u00e9", "e\u0301",
            "\u6f22\u5b57", "\U0001f600", "\u0120", "<|endoftext|>", "\x00", "\u0300", "\u00bd", "_", "...", "-"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(4000)]
    t, encoder = library(), library_encoder(path)
    for i in range(0, len(texts), 500):  # later batches meet pieces that are cached
        for text, got in zip(texts[i:i + 500], encoder.encode_batch(texts[i:i + 500])):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark):
    from fathom.llm import tokenfile
    from fathom.session import scratch_path

    texts = ODD + [some_text(i) for i in range(20)]
    path = scratch_path(spark, "t")
    tokenfile.write_ids(frame(spark, texts), path, vocab(), 50257, end_id=0, file_ids=2000)
    got = tokenfile.read_ids(spark, path, tokenfile.crc32, "bigint").orderBy("doc_id").collect()
    t, start = library(), 0
    assert len(got) == len(texts)
    for r, text in zip(got, texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.value) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = scratch_path(spark, "t")
    tokenfile.write_ids(frame(spark, texts).limit(0), empty, vocab(), 50257)
    assert tokenfile.read_ids(spark, empty, tokenfile.crc32, "bigint").count() == 0


def base_figures(text):
    w = WORDS.findall(text or "")
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, dup = Counter(wins), set(), set(), 0
    for i, x in enumerate(wins):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_figures_and_filter(spark):
    from fathom.llm import quality

    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab cd ef gh #x ij% kl".split()) for _ in range(60)) for _ in range(30)] + ["one two\none two\n\none two " * 20, "a b c d e f g h " * 30]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality.judge(docs, None).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_figures(text)
        assert r.kept == (not r.base_failed)
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert quality.judge(docs.limit(0), None).count() == 0


def test_viterbi_against_all_paths():
    from itertools import product

    from fathom.llm.quality import viterbi

    rng = np.random.default_rng(5)
    step = rng.normal(size=(2, 2))
    docs = [rng.normal(size=(n, 2)) for n in (1, 5, 3, 0, 5, 2)]
    for s, path in zip(docs, viterbi(docs, step)):
        score = lambda p: sum(s[i, y] for i, y in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(path) == max(product((0, 1), repeat=len(s)), key=score) if len(s) else len(path) == 0


def test_labeller_on_held_out_rows(spark):
    from fathom.llm import quality

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    rows = got.select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_labeller_at_real_class_shares(spark):
    """Lines with symbols are half of the bad documents and a fifth of the nine times as many good ones."""
    from fathom.llm import quality

    rng = random.Random(6)
    texts, labels = [], []
    for i in range(1500):
        good = int(rng.random() < 0.9)
        kind = ("#" if rng.random() < 0.2 else "") if good else ("#" if rng.random() < 0.5 else "X")
        texts.append(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{kind if k % 3 == 0 else ''}" for k in rng.sample(range(200), 30)))
        labels.append((i, good))
    docs, known = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, known, max_docs=60)).collect()}
    assert np.mean([kept[i] for i, good in labels if good]) >= 0.98
    assert np.mean([kept[i] for i, good in labels if not good and "X" in texts[i]]) <= 0.1


def test_toxicity_on_held_out_rows(spark):
    from fathom.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    pos, neg = (np.array([r.score for r in rows if r.held_out and r.toxic == v]) for v in (1, 0))
    assert (pos[:, None] > neg).mean() >= 0.93
    assert (pos >= 0.7).mean() >= 0.75 and (neg >= 0.7).mean() <= 0.05
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert {r.score for r in toxicity.score(frame(spark, ODD), None).collect()} == {0.5}


def test_toxicity_thresholds_at_real_class_shares(spark):
    """A word of half the toxic and 40% of the clean texts is a good cut for a balanced sample only."""
    from fathom.llm import toxicity

    rng = random.Random(10)
    plain = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(2400):
        toxic = int(rng.random() < 0.1)
        word = ("vile" if rng.random() < 0.5 else "mud") if toxic else ("mud" if rng.random() < 0.4 else "dew")
        texts.append(" ".join(rng.sample(plain, 12) + [word]))
        labels.append((i, toxic))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame(spark, texts), known, max_docs=80)
    rows = [r for r in toxicity.score(frame(spark, texts), model).join(known, "doc_id").collect() if not r.held_out]
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    f1 = lambda cut: 2 * (y & (p >= cut)).sum() / ((p >= cut).sum() + y.sum())
    assert f1(0.7) >= max(map(f1, p)) - 0.1  # the rows that the network was fitted on do not count for the cut
    assert np.mean(p[y == 0] >= 0.7) <= 0.05


def test_mixing(spark):
    from fathom.llm import mixing

    rng = random.Random(9)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(600)] + [None, "", "tie tie", "tie tie"]
    sources = {i: rng.choice(["big"] * 7 + ["b", "c", None]) for i in range(len(texts))}
    docs = frame(spark, texts, sources)
    rows = mixing.taken(docs).collect()
    again = mixing.taken(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
    size = Counter()
    for i, t in enumerate(texts):
        size[sources[i]] += len(WORDS.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    free, left, target = set(order), float(sum(size.values())), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    got = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and r.source_size == size[s]
        assert abs(r.target - target[s]) < 1e-6 * (1 + target[s]) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - target[s]) <= 150 + 1e-6 for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    from fathom.llm import merkle

    texts = [None, "", "a", "abcd", "one line\nand two\n\nsection two", "one line\nand two\n\n\nsection two", "same", "same", "x" * 5000 + "\n" + some_text(3, 9000), some_text(4, 3000)]
    rows = merkle.compare_with_edits(frame(spark, texts)).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        assert r.n_chars == len(t) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) or edited != t
        assert r.next_doc_id == (i + 1) % len(texts)
    prints = [r.fingerprint for r in rows]
    assert prints[6] == prints[7] and prints[0] == prints[1] and len(set(prints)) == len(texts) - 2
    assert rows[8].near_edited > 0.5 > rows[8].near_next
    one = merkle.with_fingerprint(merkle.with_fingerprint(spark.createDataFrame([("p\nq\nr", "p\nX\nr\ns")], "a string, b string"), "a", "x"), "b", "y")
    assert one.select(merkle.edited_paragraphs(F.col("x"), F.col("y"))).first()[0] == [1, 3]
    assert merkle.compare_with_edits(frame(spark, texts).limit(0)).count() == 0
    lone = merkle.compare_with_edits(frame(spark, ["only one text here"])).first()
    assert lone.near_next == 1.0
