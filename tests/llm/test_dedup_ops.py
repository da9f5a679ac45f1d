"""Small cases and brute force for near duplicates, repeated passages, archives and page texts."""

import base64
import random
import re
from hashlib import sha1, sha256

import pytest
from test_text_ops import ODD, WORDS, frame


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages and chains of edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    fresh = lambda k: [word() for _ in range(k)]
    passage, base = fresh(70), fresh(120)
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(fresh(rng.randrange(1, 200)))
        elif kind == 1:
            out.append(fresh(30) + passage + fresh(40))
        elif kind == 2:
            out.append(list(base))
        elif kind == 3:
            w = list(rng.choice(out)) if out else fresh(9)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            out.append(w)
        elif kind == 4:
            w = list(base)
            w[rng.randrange(len(w))] = word().upper()
            out.append(w + fresh(rng.randrange(3)))
        else:
            out.append([rng.choice(["la", "li"])] * rng.randrange(1, 150))
    return [rng.choice([" ", "\n", "  "]).join(w) for w in out] + ODD


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_against_all_pairs(spark):
    from fathom.llm import jaccard

    for seed in (1, 2, 3):
        texts = corpus(seed)
        docs = frame(spark, texts)
        want = components(texts)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()} == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    from fathom.llm import jaccard

    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, texts)).collect()}
    assert got == components(texts)


def test_overlap_bound_never_below_overlap():
    import numpy as np

    from fathom.llm.jaccard import bitmap, overlap_bound

    rng = np.random.default_rng(0)
    for n, m, common in ((5, 5, 5), (500, 400, 380), (3000, 10, 9), (1000, 1000, 0)):
        x = rng.integers(0, 2**63, n + m - common, dtype=np.uint64)
        a, b = x[:n], x[n - common:]
        assert overlap_bound(bitmap(a), bitmap(b), n, m) >= common


def removed(texts, k=50):
    words = [WORDS.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a:a + k]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < i:
                gone.update(range(a, a + k))
        out.append(gone)
    return words, out


def test_substrings_against_all_windows(spark):
    from fathom.llm import substrings

    for seed, hot in ((1, 20_000), (2, 20_000), (3, 3), (4, 0)):
        texts = corpus(seed)
        words, gone = removed(texts)
        docs = frame(spark, texts)
        got = {r.doc_id: r for r in substrings.digests(docs, hot=hot).collect()}
        for i, w in enumerate(words):
            kept = " ".join(x for j, x in enumerate(w) if j not in gone[i])
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), sha256(kept.encode()).hexdigest())
    assert any(gone)
    out = substrings.deduplicate(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert WORDS.findall(r.text or "") == [x for j, x in enumerate(words[r.doc_id]) if j not in gone[r.doc_id]]
        assert gone[r.doc_id] or r.text == texts[r.doc_id]
    assert substrings.digests(docs.limit(0)).count() == 0


def test_rank_windows_is_exact():
    from fathom.llm.substrings import rank_windows

    rng = random.Random(0)
    strings = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 30))] for _ in range(50)]
    for k in (1, 2, 3, 7, 8):
        owner, rank = rank_windows(strings, k)
        wins = [(i, tuple(s[a:a + k])) for i, s in enumerate(strings) for a in range(len(s) - k + 1)]
        assert owner.tolist() == [i for i, _ in wins]
        assert len({(w, r) for (_, w), r in zip(wins, rank.tolist())}) == len({w for _, w in wins}) == len(set(rank.tolist()))


def test_archive_round_trip(spark):
    from fathom.llm import warc
    from fathom.session import scratch_path

    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 5000, "b", "x" * 5000, "", "c"]
    rows = [(i, None if i == 4 else f"http://h/{i}", h, "clash") for i, h in enumerate(html)] + [(8, "http://h/8", "c", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, address string").repartition(3)
    path = scratch_path(spark, "w")
    warc.write_archive(pages, path)
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    got = warc.read_headers(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (html[r.page_id] or "").encode()
        lead = first[html[r.page_id] or ""]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
    assert spark.read.parquet(f"{path}/payloads").count() == len(first)
    for r in warc.reconstruct(spark, path).collect():
        head = bytes(r.header)
        data = (html[r.page_id] or "").encode()
        assert bytes(r.payload) == data
        lines, block = head.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)$", lines).group(1))
        body = b"" if b"WARC-Type: revisit" in lines else data
        assert size == len(block + body) and bytes(r.record) == head + body + b"\r\n\r\n"
    small = scratch_path(spark, "w")
    warc.write_archive(pages.where("page_id < 8"), small, dedup_from=5)
    assert {r.page_id for r in warc.read_headers(spark, small).where("record_type = 'revisit'").collect()} == {3, 6}
    none = scratch_path(spark, "w")
    warc.write_archive(pages.limit(0), none)
    assert warc.read_headers(spark, none).count() == 0


@pytest.mark.parametrize("name, pattern, by", [("length", "(?<=msgtype=response\r\nContent-Length: )", "9"), ("response", "(?<=WARC-Refers-To: <urn:x-page:)", "7"),
                                               ("length", "(?<=utf-8\r\nContent-Length: )", "9")])
def test_archive_with_a_broken_header(spark, name, pattern, by):
    from pyspark.sql import functions as F

    from fathom.llm import warc
    from fathom.session import scratch_path

    rows = [(i, f"http://h/{i}", "same" if i % 2 else f"page {i}") for i in range(6)]
    path = scratch_path(spark, "w")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert len(warc.read_headers(spark, path).collect()) == 6
    changed = F.encode(F.regexp_replace(F.decode("header", "UTF-8"), pattern, by), "UTF-8")
    bad = scratch_path(spark, "w")
    spark.read.parquet(f"{path}/headers").withColumn("header", F.when(F.col("page_id") == 3, changed).otherwise(F.col("header"))).write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match=name):
        warc.read_headers(spark, bad).collect()


def test_links_inside_groups(spark):
    from fathom.llm import jaccard

    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b[:60 - cut] + [f"x{cut}"] * (cut > 0)) for b in base for cut in range(7)] + [" ".join(base[0]), "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    classes = sorted({tuple(w) for w in words if w})
    of = {c: sets[words.index(list(c))] for c in classes}
    want = {(c, d) for c in classes for d in classes if c < d and 100 * len(of[c] & of[d]) >= 75 * len(of[c] | of[d])}
    assert len(want) > 60
    name = {r.node: tuple(words[r.doc_id]) for r in jaccard.profile(docs)[0].collect()}
    got = [tuple(sorted((name[r.a], name[r.b]))) for r in jaccard.links(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {r.doc_id: r.n_links for r in jaccard.link_counts(docs).collect()}
    assert counts == {i: sum(tuple(w) in pair for pair in want) for i, w in enumerate(words)}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="page-7"><header>top</header><nav><a href=x>menu</a></nav>
<div class="sidebar">side</div><div id="content" class="post-%d body"><h1>Title &amp; more</h1><p>First <b>bold</b>text&nbsp;here and long<br>broken
line.<p>Second paragraph of the article<form>name</form><div class="comments"><p>a reader says</p></div><script>if (a<b) {"</p>"}</script></div>
<aside>more</aside><footer>end</footer></body></html>"""


def test_page_texts(spark):
    from fathom.llm import htmltext

    want = "Title & more First boldtext here and long broken line. Second paragraph of the article"
    rows = [(i, f"https://user@a.example:80/{i}", PAGE % i) for i in range(5)]
    short = '<html><body class="page-1"><div class="post-9 body">ok</div><div class="other"><p>a long line outside of the article, longer than it</p></div></body></html>'
    rows += [(5, "https://a.example/x", short), (6, None, None), (7, "b", ""), (8, "b", "no tags &lt; here"), (9, "http://c/", "<p>open <p>tags <li>a<li>b")]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", rows_host())).collect()}
    assert [got[i].text for i in range(5)] == [want] * 5
    assert got[5].text == "ok"  # the host's path wins over the page's own best container
    assert (got[6].text, got[7].text, got[8].text, got[9].text) == ("", "", "no tags < here", "open tags a b")
    assert all(r.n_chars == len(r.text) for r in got.values())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    joined = {r.page_id: r.text for r in htmltext.extract(pages, broadcast_chars=0).collect()}
    assert joined == {i: r.text for i, r in got.items()}
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_article_text_is_not_lost_to_attribute_words(spark):
    from fathom.llm import htmltext

    article = """<html><body><nav class="nav">menu</nav><div class="overflow-hidden"><article class="post"><h1 id="share">One</h1>
<p>Two <a href="/wiki/hidden-valley" title="display: none">valley</a> and <span class="social-impact">three</span>.</p>
<section id="related-work"><h2 id="social-impact">Four</h2><p id="reply">five, long enough to be the article of this page</p></section>
<section id="related">six</section><header class="header">seven</header>
<div class="related-posts">out</div><div id="comments">out</div><p hidden>out</p><p style="color:red; DISPLAY : none">out</p>
<div class="ad">out</div><div class="x sidebar2">out</div><p hidden="">out</p><p role="complementary">out</p></article></div></body></html>"""
    want = "One Two valley and three. Four five, long enough to be the article of this page six seven"
    usual = '<body><div class="story"><p>the usual text of this host</p></div></body>'
    empty = '<body><div class="story"></div><div class="long"><p>the article is here</p></div></body>'
    gone = '<body><div class="story" hidden><p>not shown</p></div><div class="long"><p>the article is here</p></div></body>'
    rows = [(0, "http://a/0", article)] + [(i, f"http://b/{i}", usual) for i in range(1, 5)] + [(5, "http://b/5", empty), (6, "http://b/6", gone)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == want
    assert got[1] == "the usual text of this host" and got[5] == got[6] == "the article is here"


HOSTED = """<html><body><div class="main-nav"><a href="/">start</a></div><div class="layout with-sidebar"><div class="story">
<div class="teaser">Lead %d of the article.</div><h2 class="part">Summary</h2><p>Text <span class="comment">number %d</span> of <b class="ad">this</b> host, told at
some length so that the story holds more than half of the page, %s and on.</p><div class="share-this">Tell your friends</div><div class="author-box">By our staff, who wrote it</div>
<ul class="see"><li><a href="/a">Other story %d</a></li></ul><ol><li>first %d</li></ol></div><ul><li><a href="/x%d">elsewhere %d</a></li></ul>
<div class="user-comments"><article class="comment-body">reader %d says</article></div><div class="reader-comments">reader %d too</div>
<div class="post-comment">and %d</div><div class="comment-form">your name %d</div><div class="noticeBoard">board %d</div></div></body></html>"""


def test_parts_are_judged_by_their_host(spark):
    from fathom.llm import htmltext

    def page(i):
        return HOSTED.replace("%s", "on " * (40 + i)).replace("%d", str(i))

    def story(i):
        return f"Lead {i} of the article. Summary Text number {i} of this host, told at some length so that the story holds more than half of the page, " + "on " * (40 + i) + "and on."

    rows = [(i, f"http://many.example/{i}", page(i)) for i in range(6)] + [(i, "http://copies.example/", page(7)) for i in range(6, 16)] + [(16, "http://one.example/", page(8))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for i in range(6):  # repeated texts and lists of links go; the lead and the article's own list stay
        assert got[i] == f"{story(i)} first {i}"
    alone = "Tell your friends By our staff, who wrote it"  # copies of one page tell nothing about its parts
    for i in range(6, 17):
        n = 7 if i < 16 else 8
        lead = story(n).removeprefix(f"Lead {n} of the article. ")  # without article element or verdict the word decides
        assert got[i] == f"{lead} {alone} " + ("" if i < 16 else f"Other story {n} ") + f"first {n}"
    again = {r.page_id: r.text for r in htmltext.extract(pages.repartition(7), broadcast_chars=0).collect()}
    assert again == got


def test_names_of_parts():
    from fathom.llm import htmltext as h

    for names, mark in {"": h.UNMARKED, "post body": h.UNMARKED, "user-comments": h.COMMENT, "userComments": h.COMMENT, "comment-form": h.COMMENT, "post-comment": h.COMMENT,
                        "main-nav": h.MENU, "has-sidebar": h.UNMARKED, "site_footer": h.HEAVY, "x sidebar2": h.HEAVY, "share-buttons": h.LIGHT, "teaser": h.LIGHT,
                        "social-impact": h.UNMARKED, "share-this": h.UNMARKED, "ad-hoc": h.UNMARKED}.items():
        assert h.name_mark(names, False) == mark, names
    assert h.name_mark("teaser", True) == h.name_mark("page-header", True) == h.UNMARKED


def test_page_texts_and_verdicts_equal_a_plain_version(spark):
    """The given pages through Python's own parser, and the verdicts of hosts by counting one page after the other."""
    from collections import Counter, defaultdict
    from html.parser import HTMLParser

    from fathom.llm import htmltext as h

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.inside, self.blocks = 0, 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("nav", "script", "style", "title", "aside", "footer", "form")
            if tag in h.BLOCK or tag in ("br", "hr"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag in h.BLOCK:
                self.blocks.append("")
            self.inside -= tag == "article"
            self.skip -= tag in ("nav", "script", "style", "title", "aside", "footer", "form")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        same += got[r.page_id] == " ".join(" ".join(b.split()) for b in plain.blocks if b.split())
    assert same == len(rows)

    extra = [(10_000 + i, "http://many.example/", HOSTED.replace("%s", "on " * (40 + i)).replace("%d", str(i % 8))) for i in range(9)]
    both = pages.select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    votes, parts = defaultdict(Counter), defaultdict(list)
    for r in both.collect():
        host = (r.url or "").split("//")[-1].split("/")[0].split(":")[0].lower()
        page = h.Page(r.html or "")
        path, score = page.best()
        if score > 0:
            votes[host][path] += 1
        for p, *seen in page.seen():
            parts[host, p].append(seen)
    want = {}
    for (host, p), seen in parts.items():
        n, others = len(seen), defaultdict(set)
        for digest, other, *_ in seen:
            others[digest].add(other)
        repeated = sum(len(others[s[0]]) > 1 for s in seen)
        chars, linked, large = (sum(s[i] for s in seen) for i in (2, 3, 4))
        weak, inner = (any(s[i] for s in seen) for i in (5, 6))
        if n >= 3 and 4 * n >= sum(votes[host].values()):
            out = 2 * large < n and (2 * repeated >= n or 2 * linked > chars and (weak or not inner))
            if out or weak:
                want.setdefault(host, (set(), set()))[not out].add(p)
    found = {r.host: r for r in h.host_paths(h.host_votes(both)).collect()}
    assert set(found) == set(votes)
    for host, r in found.items():
        assert votes[host][r.path] == max(votes[host].values())
        assert (set(r.out.split("\n")) - {""}, set(r.kept.split("\n")) - {""}) == want.get(host, (set(), set()))
    assert want["many.example"][0] and want["many.example"][1]


def rows_host():
    from pyspark.sql import functions as F

    return F.lit("clash")
