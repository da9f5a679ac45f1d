"""Registered queries of this subpackage and their DuckDB SQL (None in SQL: see tests/llm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1(spark, sf_dir):
    """Digests of every document's ids and of the text decoded from them."""
    from fathom.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocab())


WARC_SQL = """
with r as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first_id from r)
select page_id, payload_bytes,
  translate(array_to_string(list_transform([1, 11, 21, 31], lambda x: lpad(to_base(('0x' || substr(h, x, 10))::bigint, 32), 8, '0')), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to from d
"""


@query("op3_warc", WARC_SQL)
def op3(spark, sf_dir):
    """Archive of all pages, written and read back."""
    from fathom.llm.warc import read_headers, write_archive
    from fathom.session import scratch_path

    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path, dedup_from=0)
    return read_headers(spark, path)


MIX_SQL = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, text from documents),
k as (select *, -ln((('0x' || substr(md5(concat_ws(':', '9', doc_id::varchar, text)), 1, 12))::bigint + 1.0)::double / 281474976710656.0)
  / coalesce(0.25 + 0.75 / (1.0 + (length(text) - length(translate(text, '#*$%&|<>!', '')))::double / greatest(size, 1)), 1.0) as key from d),
s as (select source, sum(size) as source_size from d group by 1),
w as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 3.0 * source_size as cap from s),
f as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
l as (select max(case when cap > w * level then level end) as level from f),
t as (select source, source_size, case when cap <= w * f.level then cap::double else w * l.level end as target from f, l),
g as (select *, case when source_size = 0 then 0 else floor(target / source_size) end as epochs from t),
p as (select k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as rest,
  coalesce(sum(k.size) over (partition by k.source order by key rows between unbounded preceding and 1 preceding), 0) as before
  from k join g on k.source is not distinct from g.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target::double as target,
  (size * (epochs + case when rest > 0 and before + size / 2 <= rest then 1 else 0 end))::bigint as taken from p
"""


@query("op9_mix", MIX_SQL)
def op9(spark, sf_dir):
    """Words that the mix takes of every document."""
    from fathom.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def op5(spark, sf_dir):
    """Token-ID files of all documents, written and read back."""
    from fathom.llm import tokenfile
    from fathom.session import scratch_path

    path = scratch_path(spark, "ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, vocab(), 50257, end_id=0)
    return tokenfile.read_ids(spark, path, tokenfile.crc32, "bigint").withColumnRenamed("value", "ids_crc32")


@query("op6_quality")
def op6(spark, sf_dir):
    """Base figures and the line labeller's verdict on every document."""
    from fathom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op10_toxicity")
def op10(spark, sf_dir):
    """Toxicity score of every document."""
    from fathom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


MERKLE_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents),
o as (select *, length(text)::bigint as n, coalesce(lead(text) over w, first(text) over (order by doc_id)) as next_text,
  coalesce(lead(doc_id) over w, first(doc_id) over (order by doc_id)) as next_doc_id from d window w as (order by doc_id)),
e as (select *, substring(text, 1, n - n // 4) || substring(next_text, 1, n // 4) as edited from o),
t as (select doc_id, 'a' as kind, text from e union all select doc_id, 'b', edited from e),
p as (select doc_id, kind, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda l:
  list_transform(list_concat(regexp_extract_all(substring(l, 1, 64), '(?s).{1,8}'), regexp_extract_all(substring(l, 65), '(?s).{1,32}')), lambda x: md5(x)))) as leaves from t),
q as (select doc_id, kind, list_transform(leaves, lambda s: list_transform(s, lambda l: {'h': sha256(array_to_string(l, '')),
  'l': array_to_string(list_transform(l, lambda x: substring(x, 1, 6)), '')})) as para from p),
r as (select doc_id, kind, list_transform(para, lambda s: {'h': sha256(array_to_string(list_transform(s, lambda x: x.h), '')),
  'l': array_to_string(list_transform(s, lambda x: substring(x.h, 1, 8) || '.' || x.l), ',')}) as sec from q),
f as (select doc_id, kind, sha256(array_to_string(list_transform(sec, lambda s: s.h), '')) || '/'
  || array_to_string(list_transform(sec, lambda s: substring(s.h, 1, 16) || ':' || s.l), ';') as fp from r),
w as (select doc_id, kind, unnest(flatten(list_transform(flatten(leaves), lambda l: list_transform(l, lambda x, i: {'h': substring(x, 1, 6), 'n': case when i <= 8 then 1 else 4 end})))) as x from p),
c as (select doc_id, kind, x.h as h, x.n as leaf, sum(x.n) as n from w group by all),
z as (select doc_id, kind, sum(n) as n from c group by all),
pairs as (select doc_id, 'b' as other, doc_id as other_id from e union all select doc_id, 'a', next_doc_id from e),
k as (select p.doc_id, p.other, sum(least(x.n, y.n)) as common from pairs p join c x on x.doc_id = p.doc_id and x.kind = 'a'
  join c y on y.doc_id = p.other_id and y.kind = p.other and y.h = x.h and y.leaf = x.leaf group by all),
near as (select p.doc_id, p.other, coalesce(common, 0)::double / greatest(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(common, 0), 1) as share from pairs p
  left join k on k.doc_id = p.doc_id and k.other = p.other left join z x on x.doc_id = p.doc_id and x.kind = 'a' left join z y on y.doc_id = p.other_id and y.kind = p.other)
select e.doc_id, e.n as n_chars, sha256(e.edited) as edited_sha256, a.fp as fingerprint, b.fp as edited_fingerprint,
  case when substring(a.fp, 1, 64) = substring(b.fp, 1, 64) then 1.0::double else nb.share end as near_edited,
  case when substring(a.fp, 1, 64) = substring(c.fp, 1, 64) then 1.0::double else nn.share end as near_next, e.next_doc_id
from e join f a on a.doc_id = e.doc_id and a.kind = 'a' join f b on b.doc_id = e.doc_id and b.kind = 'b'
join f c on c.doc_id = e.next_doc_id and c.kind = 'a' join near nb on nb.doc_id = e.doc_id and nb.other = 'b' join near nn on nn.doc_id = e.doc_id and nn.other = 'a'
"""


@query("op7_fingerprint", MERKLE_SQL)
def op7(spark, sf_dir):
    """Merkle fingerprints of every document and of its edited text, with likenesses."""
    from fathom.llm.merkle import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


@query("op8_html_text")
def op8(spark, sf_dir):
    """Main text of every page."""
    from fathom.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


SUBSTRING_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
s as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as win from i),
f as (select win, min(doc_id) as first_doc from s group by 1),
r as (select s.doc_id, s.i from s join f using (win) where f.first_doc < s.doc_id),
c as (select doc_id, list(distinct j) as gone from (select doc_id, unnest(range(i, i + 50)) as j from r) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when gone is null then array_to_string(ws, ' ')
    else array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda j: not list_contains(gone, j)), lambda j: ws[j]), ' ') end) as kept_sha256
from w left join c on c.doc_id = w.doc_id
"""


@query("op4_substrings", SUBSTRING_SQL)
def op4(spark, sf_dir):
    """Words of every document that a repeated 50-word window covers."""
    from fathom.llm.substrings import digests

    return digests(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
s as (select doc_id, len(sh) as n, unnest(list_transform(sh, lambda x: hash(x))) as h from g),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id
  and 100 * a.n >= 75 * b.n and 100 * b.n >= 75 * a.n group by all),
l as (select a, b from p where 100 * c >= 75 * (na + nb - c) union all select b, a from p where 100 * c >= 75 * (na + nb - c)),
r(doc_id, c) as (select doc_id, doc_id from g union select l.b, r.c from r join l on l.a = r.doc_id and r.c < l.b)
select g.doc_id, len(sh)::bigint as n_shingles, m.c as component_id from g join (select doc_id, min(c) as c from r group by 1) m using (doc_id)
"""


@query("op2_jaccard", JACCARD_SQL)
def op2(spark, sf_dir):
    """Shingle-set size and component of every document at a Jaccard similarity of 0.75 or more."""
    from fathom.llm.jaccard import classes

    return classes(table(spark, sf_dir, "documents"))


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_alignment")
def op11(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers in every document."""
    from fathom.llm.align import summary

    return summary(table(spark, sf_dir, "documents"), vocab(), pieces())


AUDIT_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
m as (select doc_id, part, case when len(ws) < 100 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
  + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as bits from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
c as (select part, bits, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by all),
f(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select f.l || g.l || h.l || i.l || j.l as filter_order, [f.b, g.b, h.b, i.b, j.b] as bs from f, f g, f h, f i, f j where f.b + g.b + h.b + i.b + j.b = 31
  and len(list_distinct([f.b, g.b, h.b, i.b, j.b])) = 5),
s as (select filter_order, k::int as step, bs[k] as own, coalesce(list_sum(bs[1:k - 1]), 0)::int as gone from o, range(1, 6) t(k)),
r as (select part, filter_order, step, own, sum(case when bits & (gone | own) = 0 then n else 0 end) as kept,
  sum(case when bits & own > 0 and bits & gone = 0 then n else 0 end) as removed, sum(case when bits & own > 0 and bits & gone > 0 then n else 0 end) as redundant,
  sum(case when bits = own then n else 0 end) as unique_fails, sum(case when bits & own > 0 and bits & gone = 0 then good else 0 end) as good_lost,
  sum(case when bits & own > 0 and bits & gone = 0 then toxic else 0 end) as toxic_lost from c, s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark, sf_dir):
    """What five filters remove, in every order of applying them."""
    from fathom.llm.audit import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


EXACT_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""


@query("op13_exact_dedup", EXACT_SQL)
def op13(spark, sf_dir):
    """Of equal texts the last document stays."""
    from fathom.llm.exact import verdicts

    return verdicts(table(spark, sf_dir, "documents"))
