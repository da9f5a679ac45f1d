"""Op 8: main text of web pages by consensus of host paths.

Every page's containers are scored by the text of their own blocks, links aside (the next container up gets
half). A page votes for the path of its best container: tags with their classes from the root down, digits
generalised. Spark counts the votes per host, and every page is read again with its host's winning path; a page
without such a container, or without text in it, uses its own best one.

Parts of a page (block elements with a class or id, and bare lists) are judged by their host too. Spark counts, per
host and path of a part, its pages, those whose text of this part also stands on a page with another longest block, and
its characters inside links. A path on three pages or more and on a quarter of the host's pages is beside the article
if half of its texts repeat so, or if most of its text is links and it stands outside an article or has a weak mark;
but never where it holds half of a page's text or its main heading. Words in class names, roles and ids are marks:
names made of such words alone, and names that begin or end with a word for comments or navigation (user-comments,
main-nav) unless the part holds the article, always count, as comments and adverts differ from page to page; weak
marks (share, related, notice) decide only where the host has no verdict, that is, on too few pages or always one text. Inline elements are never judged by names.
Left out as well: parts by tag and role, and those hidden by ``hidden``, ``aria-hidden`` or ``display: none``.

A block's white space becomes one space, blocks are joined by one space; character references are decoded.

Defined results: null or empty html gives the empty text; html without any tag is one block; broken markup is
read as browsers do in the common cases (open paragraphs end at the next block, unclosed elements at the end);
a null url belongs to the host ""; repeated rows are extracted alike, and copies of a page do not make its parts
repeat; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import lru_cache
from heapq import nlargest
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.textio import map_batches
from fathom.session import scratch_path

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body div html main section td center".split())
DROPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object search select svg template textarea title".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("article body div html main section table ul ol dl".split())
# Words of class names, ids and roles that mark parts beside the article; with other such words or words
# of place and form they mark it too (site-footer).
COMMENTS = frozenset("comment commentlist comments disqus replies reply respond".split())
MENUS = frozenset("breadcrumb breadcrumbs footer menu menubar nav navbar navigation pager pagination sidebar".split())
ADVERTS = frozenset("""ad ads adv advert adverts advertisement advertising complementary consent contentinfo cookie cookies gdpr modal
newsletter popup promo promoted signup sponsor sponsored subscribe toolbar tracking""".split())
WEAK = frozenset("""banner copyright header masthead notice notices notification recommended related share sharing skip social teaser toc
widget widgets""".split())
FORM = frozenset("""area bar block bottom box button buttons container icons inner item items left links list outer page posts
right site slot top unit wrap wrapper""".split())
STRONG = COMMENTS | MENUS | ADVERTS
OWN = frozenset("header masthead teaser".split())  # an article's own heading or lead belongs to it
STATES = frozenset("disable disabled enable enabled has hide is no open show with without".split())  # has-sidebar, no-comments
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())  # their ids are anchors
PARTS = frozenset("address center details div dl fieldset figure ol section table ul".split())  # judged by their host
UNMARKED, LIGHT, COMMENT, MENU, HEAVY = range(5)  # marks by names; COMMENT and MENU: with words of other kinds
MIN_PAGES, MIN_SHARE = 3, 4  # a host's verdict on a path: on so many pages, and on one of so many of the host's
LONGEST = 8  # blocks of a page tried as its mark outside a part
LONG_PATH = 400  # longer paths are carried on by a digest
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # userComments
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(raw)}


def is_hidden(attrs: dict[str, str]) -> bool:
    """Whether attributes other than names say that an element is not shown or not part of the article."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or UNSHOWN.search(attrs.get("style", "")):
        return True
    return any(r in STRONG or r == "banner" for r in attrs.get("role", "").lower().split())


@lru_cache(4096)
def name_mark(names: str, in_article: bool) -> int:
    """The strongest mark of a part's names."""
    mark = UNMARKED
    for name in names.split():
        words = WORD.findall(HUMP.sub("-", name).lower())
        if not words:
            continue
        if all(w in STRONG or w in WEAK or w in FORM for w in words):
            if not STRONG.isdisjoint(words):
                return HEAVY
            weak = WEAK.intersection(words)
            if weak - OWN if in_article else weak:
                mark = max(mark, LIGHT)
        elif words[0] not in STATES:
            ends = {words[0], words[-1]}
            mark = max(mark, COMMENT if ends & COMMENTS else MENU if ends & MENUS else UNMARKED)
    return mark


def kinds(names: str) -> str:
    return ".".join(sorted({re.sub(r"\d+", "#", c) for c in names.lower().split()}))


def joined_path(path: str, tag: str, names: str, ident: str = "") -> str:
    end = f"/{tag}" + (f".{names}" if names else "") + (f"@{ident}" if ident else "")
    full = path + end
    return full if len(full) <= LONG_PATH else "~" + xxhash.xxh3_64_hexdigest(full) + (end if len(end) < LONG_PATH // 2 else "")


class Page:
    """One pass over a page: blocks of text with their container and part, and the paths of both."""

    def __init__(self, html: str):
        self.parent, self.path, self.tag = [-1], [""], ["#root"]
        self.blocks: list[tuple[int, str, int, int]] = []  # container, text, characters inside links, part
        # Parts in page order: the part around it, path ("" if its host has no say), mark, in an article, holds the
        # page's heading, holds an article.
        self.around: list[int] = []
        self.part: list[str] = []
        self.mark: list[int] = []
        self.inner: list[bool] = []
        self.titled: list[bool] = []
        self.holding: list[bool] = []
        stack: list[tuple[str, int, int, bool, bool]] = [("#root", 0, -1, False, False)]  # tag, container, part, left out, in an article
        text: list[str] = []
        linked = links = 0

        def flush() -> None:
            nonlocal linked
            if text:
                if not stack[-1][3]:
                    words = " ".join(unescape("".join(text)).split())
                    if words:
                        self.blocks.append((stack[-1][1], words, min(linked, len(words)), stack[-1][2]))
                text.clear()
            linked = 0

        def pop_to(i: int) -> None:
            nonlocal links
            if any(s[0] in BLOCK for s in stack[i:]) or stack[-1][3] != stack[i - 1][3]:
                flush()
            links -= sum(s[0] == "a" for s in stack[i:])
            del stack[i:]

        def noted(flags: list[bool], p: int) -> None:
            while p >= 0 and not flags[p]:
                flags[p] = True
                p = self.around[p]

        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at and not stack[-1][3]:
                text.append(html[at:m.start()])
                if links:
                    linked += m.start() - at
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            if tag in BLOCK:
                ends = ENDS.get(tag)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or ends and stack[i][0] in ends:
                        pop_to(i)
                        break
                    if stack[i][0] in SCOPE and not (ends and stack[i][0] == "table"):
                        break
            _, element, part, out, in_article = stack[-1]
            attrs = attributes(m["attrs"])
            whole = tag in ("html", "body", "article", "main")
            inside = out or tag in DROPPED or (tag == "header" and not in_article) or bool(attrs and not whole and is_hidden(attrs))
            if tag in BLOCK or inside != out:
                flush()
            classes = kinds(attrs.get("class", "")) if tag in BLOCK else ""
            around = self.path[element]
            if tag in CONTAINER:
                self.parent.append(element)
                self.path.append(joined_path(around, tag, classes))
                self.tag.append(tag)
                element = len(self.path) - 1
            if not inside:
                ident = "" if tag in TITLES else attrs.get("id", "")
                if tag in BLOCK and not whole and (classes or ident or tag in ("ul", "ol")):
                    names = attrs.get("class", "") + (f" {ident}" if tag == "div" or not in_article else "")
                    self.around.append(part)
                    self.part.append(joined_path(around, tag, classes, kinds(ident)) if tag in PARTS else "")
                    self.mark.append(name_mark(names, in_article))
                    self.inner.append(in_article)
                    self.titled.append(False)
                    self.holding.append(False)
                    part = len(self.part) - 1
                if tag in ("h1", "main"):
                    noted(self.titled, part)
                elif tag == "article":
                    noted(self.holding, part)
            if tag == "a":
                links += 1
            stack.append((tag, element, part, inside, in_article or tag in ("article", "main")))
        if at < len(html) and not stack[-1][3]:
            text.append(html[at:])
        flush()
        # Sums over each part with the parts that it holds.
        self.chars, self.links, self.digest = ([0] * len(self.part) for _ in range(3))
        for _, words, inside, p in self.blocks:
            if p >= 0:
                self.chars[p] += len(words)
                self.links[p] += inside
                self.digest[p] += xxhash.xxh3_64_intdigest(words)
        for p in range(len(self.part) - 1, -1, -1):
            if self.around[p] >= 0:
                self.chars[self.around[p]] += self.chars[p]
                self.links[self.around[p]] += self.links[p]
                self.digest[self.around[p]] += self.digest[p]
        self.total = sum(len(words) for _, words, _, _ in self.blocks)

    def is_large(self, p: int) -> bool:
        """Whether a part holds the page's heading or half of its text."""
        return self.titled[p] or 2 * self.chars[p] >= self.total

    def beside(self, out: Collection[str] = (), kept: Collection[str] = ()) -> list[bool]:
        """Per part whether it is left out, given its host's paths beside the article and those that are text."""
        left: list[bool] = []
        for p, (around, path, mark) in enumerate(zip(self.around, self.part, self.mark)):
            if around >= 0 and left[around] or mark == HEAVY:
                left.append(True)
            elif mark == COMMENT:
                left.append(not self.titled[p])
            elif mark == MENU:
                left.append(not (self.holding[p] or self.is_large(p)))
            elif path and path in out:
                left.append(not self.is_large(p))
            else:
                left.append(mark == LIGHT and path not in kept)
        return left

    def best(self) -> tuple[str, float]:
        """Path and score of the best container by names alone; its article or main element stands for it."""
        score = [0.0] * len(self.path)
        left = self.beside()
        for e, words, linked, p in self.blocks:
            if p >= 0 and left[p]:
                continue
            own = max(0, len(words) - 2 * linked)
            score[e] += own
            if self.parent[e] >= 0:
                score[self.parent[e]] += own / 2
        top = max(range(len(score)), key=lambda e: (score[e], -e))
        for kind in ("article", "main"):
            e = top
            while e >= 0:
                if self.tag[e] == kind:
                    return self.path[e], score[top]
                e = self.parent[e]
        return self.path[top], score[top]

    def seen(self) -> list[tuple[str, int, int, int, int, bool, bool, bool]]:
        """Per path of a part: digest of its text, digest of the page's longest block outside it, characters, those in
        links, whether it is large, has a weak mark, stands in an article."""
        end = list(range(1, len(self.part) + 1))  # the parts inside p are p to end[p] - 1
        for p in range(len(self.part) - 1, -1, -1):
            if self.around[p] >= 0:
                end[self.around[p]] = max(end[self.around[p]], end[p])
        of: dict[str, list[int]] = {}
        for p, path in enumerate(self.part):
            if path and self.chars[p] and self.mark[p] in (UNMARKED, LIGHT):
                same = of.setdefault(path, [])
                if not (same and p < end[same[-1]]):  # not inside one of the same path
                    same.append(p)
        long = nlargest(LONGEST, self.blocks, key=lambda b: (len(b[1]), b[1])) if of else []
        rows = []
        for path, same in of.items():
            other = next((w for _, w, _, q in long if not any(p <= q < end[p] for p in same)), None)
            rows.append((
                path, _signed(sum(self.digest[p] for p in same)), 0 if other is None else _signed(xxhash.xxh3_64_intdigest(other)),
                sum(self.chars[p] for p in same), sum(self.links[p] for p in same),
                any(self.is_large(p) for p in same) or 2 * sum(self.chars[p] for p in same) >= self.total,
                any(self.mark[p] == LIGHT for p in same), any(self.inner[p] for p in same)))
        return rows

    def text(self, path: str, left: list[bool]) -> str:
        """Text of all containers with the path, without the parts left out."""
        inside: list[bool] = []
        for p, own in zip(self.parent, self.path):
            inside.append(own == path or (p >= 0 and inside[p]))
        return " ".join([w for e, w, _, p in self.blocks if inside[e] and not (p >= 0 and left[p])])


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def host_votes(pages: DataFrame) -> DataFrame:
    """What all pages say, summed: ``is_part, host, path, digest, n, low, high, chars, linked, large, weak, inner, score``.
    A row without ``is_part`` is a path as best container, with its pages and scores; any other is one text of one
    part, with its pages and the smallest and largest digest of their longest block outside the part."""
    names = "host path digest other chars linked large weak inner score".split()

    def run(b):
        rows = []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = Page(html or "")
            path, score = page.best()
            if score > 0:
                rows.append((host, path, 0, 0, 0, 0, False, False, False, score))
            rows += [(host, *seen, -1.0) for seen in page.seen()]
        return dict(zip(names, zip(*rows) if rows else [()] * len(names)))

    said = map_batches(
        _hosted(pages).select("host", "html"), run,
        "host string, path string, digest bigint, other bigint, chars bigint, linked bigint, large boolean, weak boolean, inner boolean, score double")
    return said.groupBy((F.col("score") < 0).alias("is_part"), "host", "path", "digest").agg(
        F.count("*").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.sum(F.col("large").cast("long")).alias("large"), F.max("weak").alias("weak"),
        F.max("inner").alias("inner"), F.sum("score").alias("score"))


def host_paths(votes: DataFrame) -> DataFrame:
    """``host, path, out, kept`` from :func:`host_votes`: the path with the most votes per host (then the largest scores,
    then the first by name), and the paths of parts beside the article and of weakly marked parts that are text (at
    most four times the parts of an average page), one to a line."""
    hosts = votes.where("not is_part").groupBy("host").agg(
        F.min_by("path", F.struct(-F.col("n"), -F.col("score"), F.col("path"))).alias("path"), F.sum("n").alias("pages"))
    parts = votes.where("is_part").groupBy("host", F.col("path").alias("part")).agg(
        F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.expr("if(low <> high, n, 0)")).alias("repeated"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.sum("large").alias("large"), F.max("weak").alias("weak"), F.max("inner").alias("inner"))
    judged = parts.where(F.col("n") >= MIN_PAGES).join(hosts.select("host", "pages"), "host").where(F.col("n") * MIN_SHARE >= F.col("pages"))
    out = F.expr("2 * large < n and (2 * repeated >= n or (2 * linked > chars and (weak or not inner)))")
    listed = judged.select("host", "part", out.alias("out"), "weak").where("out or (weak and texts > 1)")

    def lines(which):
        return F.array_join(F.array_sort(F.collect_list(F.when(which, F.col("part")))), "\n")

    lists = listed.groupBy("host").agg(lines(F.col("out")).alias("out"), lines(~F.col("out")).alias("kept"))
    return hosts.join(lists, "host", "left").select("host", "path", F.coalesce("out", F.lit("")).alias("out"), F.coalesce("kept", F.lit("")).alias("kept"))


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def extract(pages: DataFrame, broadcast_chars: int = 16 << 20) -> DataFrame:
    """``page_id, url, text, n_chars``. Votes and verdicts are stored once; verdicts of up to ``broadcast_chars``
    characters in all go to all tasks, more are joined by host."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "votes")
    host_votes(pages).write.parquet(folder)
    votes = spark.read.parquet(folder)
    folder = scratch_path(spark, "paths")
    host_paths(votes).write.parquet(folder)
    paths = spark.read.parquet(folder)
    size = paths.agg(F.sum(F.expr("64 + length(host) + length(path) + length(out) + length(kept)"))).first()[0] or 0
    if size <= broadcast_chars:
        paths = F.broadcast(paths)

    def run(b):
        texts, sets = [], {"": frozenset(), None: frozenset()}
        columns = (b.column(c).to_pylist() for c in ("html", "path", "out", "kept"))
        for html, path, *lists in zip(*columns):
            for lines in lists:
                if lines not in sets:
                    sets[lines] = frozenset(lines.split("\n"))
            page = Page(html or "")
            left = page.beside(*(sets[lines] for lines in lists))
            text = page.text(path, left) if path is not None else ""
            if not text:
                own = page.best()[0]
                text = page.text(own, left) or page.text(own, page.beside())
            texts.append(text)
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    joined = _hosted(pages).join(paths, "host", "left").select("page_id", "url", "html", "path", "out", "kept")
    return map_batches(joined, run, "page_id bigint, url string, text string, n_chars bigint")
