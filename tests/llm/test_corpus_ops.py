"""Tokenizer alignment, filter audit and exact dedup against brute force, on small and odd tables."""

import itertools
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_ops import ODD, SCHEMA, WORDS, frame, library, some_text, vocab

ODD_ROWS = [None, "", "same", "SAME", "same", "same", "x" * 50_000, " ".join(map(str, range(30_000))), "é漢😀"]


def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    """(groups, links) of every text, by walking along both token lists; encoded by the libraries themselves."""
    import sentencepiece

    from fathom.llm.bpe import byte_alphabet

    a, b = library(), sentencepiece.SentencePieceProcessor(model_file=pieces())
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    out = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        xs = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ys = b.encode(t) if t else []
        xb = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in xs]
        yb = []
        for i in ys:
            p = b.id_to_piece(i)
            m = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            yb.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode())
        if b"".join(xb) != want or b"".join(yb) != want:
            xs, ys, xb, yb = [], [], [], []
        groups, i, j = [], 0, 0
        while i < len(xs):
            ga, gb, la, lb = [xs[i]], [ys[j]], len(xb[i]), len(yb[j])
            i, j = i + 1, j + 1
            while la != lb:
                if la < lb:
                    ga.append(xs[i])
                    la, i = la + len(xb[i]), i + 1
                else:
                    gb.append(ys[j])
                    lb, j = lb + len(yb[j]), j + 1
            groups.append((ga, gb))
        assert j == len(ys)
        out.append((groups, [(g[-1], h[-1]) for g, h in groups]))
    return out


def test_alignment(spark):
    from fathom.llm import align

    texts = ODD + ["▁a b", "a\x00b", "<0x41> <s> </s> <unk>", " lead", "日本語の文章。"] + [some_text(i, 400) for i in range(15)]
    want = brute_alignment(texts)
    n = Counter(link for _, links in want for link in links)
    top = defaultdict(int)
    for (x, y), c in n.items():
        top[y] = max(top[y], c)
    got = {r.doc_id: r for r in align.summary(frame(spark, texts), vocab(), pieces()).collect()}
    assert len(got) == len(texts)
    for i, (groups, links) in enumerate(want):
        r = got[i]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert r.groups_sha256 == (sha256(text.encode()).hexdigest() if groups else "")
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links))
        assert r.count_sum == sum(n[p] for p in links) and r.n_best == sum(n[p] == top[p[1]] for p in links)
    for r in align.groups(align.align(frame(spark, texts), vocab(), pieces()), vocab(), pieces()).collect():
        groups = want[r.doc_id][0]
        assert r.a_ids == [i for g, _ in groups for i in g] and r.b_ids == [i for _, g in groups for i in g]
        assert r.a_sizes == [len(g) for g, _ in groups] and r.b_sizes == [len(g) for _, g in groups]


def test_pointer_jumping_labels_components():
    from fathom.llm.align import components

    rng = random.Random(2)
    for size in (1, 2, 3, 40, 500):
        ends = [np.array(sorted(rng.sample(range(1, size), min(size - 1, rng.randrange(size))) + [size])) for _ in "ab"]
        ga, gb = components(*ends)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        assert list(ga) == [np.searchsorted(cuts, e) for e in ends[0]] and list(gb) == [np.searchsorted(cuts, e) for e in ends[1]]


def test_alignment_of_odd_tables(spark):
    from fathom.llm import align

    rows = [(i, t, None, None, None, None, None, None) for i, t in zip([None, 1, 1, 1, 2, 3, 4, 5, None], ODD_ROWS)]
    got = align.summary(spark.createDataFrame(rows, SCHEMA), vocab(), pieces()).collect()
    assert len(got) == len(rows) and sum(r.n_a == 0 for r in got) == 2 and len({r.groups_sha256 for r in got if r.doc_id == 1}) == 3
    assert align.summary(frame(spark, []), vocab(), pieces()).count() == 0
    assert align.summary(frame(spark, [None, ""]), vocab(), pieces()).agg(F.sum("n_a")).first()[0] == 0


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). One filter after the other, in every order."""
    def fails(i):
        doc_id, text, _ = docs[i]
        t = text or ""
        w = WORDS.findall(t)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                "E": doc_id is not None and any((u or "") == t and d is not None and d < doc_id for d, u, _ in docs)}

    all_fails = [fails(i) for i in range(len(docs))]
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in docs}:
        mine = [i for i in range(len(docs)) if (docs[i][2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                bad = {i for i in mine if all_fails[i][f]}
                gone = bad & left
                shapley[part, f] += len(gone)
                left -= gone
                ids = [docs[i][0] for i in gone]
                out[part, "".join(order), step] = [len(left), len(gone), len(bad - gone), sum(sum(all_fails[i].values()) == 1 for i in bad),
                                                   sum(d in good for d in ids), sum(d in toxic for d in ids)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("hot, salt_rows", [(10_000, 2_000), (1, 2), (10_000, 1)])
def test_audit(spark, hot, salt_rows):
    from fathom.llm import audit

    rng = random.Random(4)
    base = [" ".join(rng.choice(["Ab", "cd", "EF", "é", f"w{rng.randrange(200)}", "#x" if rng.random() < 0.1 else "y"]) for _ in range(rng.randrange(150))) for _ in range(25)]
    texts = [rng.choice(base) for _ in range(60)] + [" ".join(f"w{i}" for i in range(120))] * 20 + ODD_ROWS
    docs = [(rng.choice([i, i, i, i // 2, None]), t, rng.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(0, 1, 1), (None, 1, 1)]
    frame_ = spark.createDataFrame([(*d, None, None, "n", "b", "h") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, n string, bits string, hash string").repartition(4)
    got = audit.report(frame_, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hot, salt_rows).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step], r


def test_audit_of_empty_tables(spark):
    from fathom.llm import audit

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(frame(spark, []), labels).count() == 0
    rows = audit.report(frame(spark, [None]), labels).collect()
    assert len(rows) == 600 and {r.removed for r in rows if r.filter_order[r.step - 1] == "A"} == {1}


def test_perfect_hash():
    from fathom.llm.exact import PerfectHash

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        words = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        words[: n // 2, :3] = 7  # many digests that differ in one word only
        h = PerfectHash.build(words)
        assert sorted(h.slots(words)) == list(range(n)) and sum(h.sizes) <= 8 * n + 2000
        strange = h.slots(rng.integers(0, 2**63, (500, 4), dtype=np.uint64))
        assert ((strange >= -1) & (strange < max(n, 1))).all()


def brute_exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text or "")].append(doc_id)
    least = -(2**63)
    return {t: (max(ids, key=lambda i: least if i is None else i), len(ids), Counter(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("slots, hot", [(32_768, 10_000), (3, 1), (1, 10_000)])
def test_exact(spark, slots, hot):
    from fathom.llm import exact

    rng = random.Random(8)
    base = [some_text(i, 30) for i in range(12)]
    texts = [rng.choice([t, t.upper(), t]) for t in (rng.choice(base) for _ in range(80))] + ["Copy É"] * 30 + ["copy É", "copy é"] + [some_text(i, 50) for i in range(40)] + ODD_ROWS
    docs = [(rng.choice([i, i, i, i // 2, None]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "n", "r", "k") for d, t in docs], SCHEMA.replace("k string", "digest string").replace("node", "`a.b`")).repartition(4)
    want = brute_exact(docs)
    by_sha = {sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    got = exact.verdicts(df, slots, hot).collect()
    assert len(got) == len(docs)
    kept = Counter()
    for r in got:
        keep_id, n, ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep_id, n) and r.doc_id in ids
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == keep_id
    assert set(kept.values()) == {1} and len(kept) == len(want)
    last = exact.keep_last(df, slots, hot)
    assert last.columns == df.columns and last.schema == df.schema
    assert sorted(str(r.doc_id) for r in last.collect()) == sorted(str(v[0]) for v in want.values())
    assert exact.verdicts(df.limit(0)).count() == 0 and exact.keep_last(df.limit(0)).count() == 0


def test_exact_index_is_kept_and_looked_up(spark):
    """An index over earlier texts, written once, takes later arrivals: members join, strangers do not."""
    from fathom.llm import exact

    old = exact.numbered(frame(spark, ["a", "b", "b", "C"]))
    index, shards = exact.build_index(exact.distinct_digests(old), slots=2)
    assert index.agg(F.sum(F.length("digests"))).first()[0] == 3 * 32
    new = exact.numbered(frame(spark, ["x", "y", "y", "z", "B", "c"]))
    got = {r.digest: (r.id, r.n) for r in exact.merge(index, shards, exact.distinct_digests(new)).collect()}
    digest = lambda t: bytearray(sha256(t.encode()).digest())
    assert {k: got[bytes(digest(k))] for k in "abcxyz"} == {"a": (0, 1), "b": (4, 3), "c": (5, 2), "x": (0, 1), "y": (2, 2), "z": (3, 1)} and len(got) == 6
