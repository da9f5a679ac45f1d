"""Null ids, repeated rows, rows that share an id, and one very long text: every operator returns a row for each."""

import random

import pytest
from test_text_ops import SCHEMA, vocab


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    same = " ".join(words[:200])
    rows = [(1, " ".join(words), None, None, None, None, None, None), (None, same, "en", "s", 1, "a", "b", "c"), (None, None, None, None, None, None, None, None),
            (2, same, "en", "s", 1, "a", "b", "c"), (2, same, "en", "s", 1, "a", "b", "c"), (2, same + " more", "en", "t", 1, "a", "b", "c"),
            (3, "x" * 50_000, "en", "", 1, "a", "b", "c"), (4, same, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_every_operator_keeps_every_row(spark, docs):
    from fathom.llm import bpe, jaccard, merkle, mixing, quality, substrings, tokenfile, toxicity
    from fathom.session import scratch_path

    n = docs.count()
    assert bpe.round_trip(docs, vocab()).count() == n
    path = scratch_path(spark, "t")
    tokenfile.write_ids(docs, path, vocab(), 50257)
    ids = tokenfile.read_ids(spark, path, tokenfile.crc32, "bigint").collect()
    assert len(ids) == n and sum(r.doc_id is None for r in ids) == 2
    assert quality.judge(docs, None).count() == n
    assert toxicity.score(docs, None).count() == n
    assert merkle.compare_with_edits(docs).count() == n
    taken = mixing.taken(docs).collect()
    assert len(taken) == n and len({r.taken for r in taken if r.doc_id == 2 and r.size == 200}) == 1
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.classes(docs).collect()}
    # rows 1 and 2 share 200 words only; 2, 4 and the row without an id hold one text; its longer form is similar
    assert got[(2, 196)] == got[(2, 197)] == got[(4, 196)] == got[(None, 196)] == 2 and got[(1, 29_996)] == 1
    kept = jaccard.keep_first(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "2", "2", "3", "None", "None"]
    sub = {}
    for r in substrings.digests(docs).collect():
        sub.setdefault(r.doc_id, []).append(r.n_removed)
    assert sub[1] == [0] and sub[None] == [0, 0] and sorted(sub[2]) == [200, 200, 200] and sub[4] == [200]
    assert substrings.deduplicate(docs).count() == n


def test_archive_and_pages(spark):
    from fathom.llm import htmltext, warc
    from fathom.session import scratch_path

    rows = [(None, None, None), (None, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (1, None, "y" * 100_000), (2, "", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "w")
    warc.write_archive(pages, path)
    heads = warc.read_headers(spark, path).collect()
    assert len(heads) == len(rows) and sorted(str(r.record_type) for r in heads).count("revisit") == 2
    assert all(r.refers_to == 1 for r in heads if r.record_type == "revisit")
    assert warc.reconstruct(spark, path).count() == len(rows)
    assert htmltext.extract(pages).count() == len(rows)


def test_stages_keep_columns_of_any_name(spark, docs):
    """Names that the operators use themselves, and names with a dot."""
    from fathom.llm import exact, jaccard, mixing, quality, substrings

    names = ["doc_id", "text", "a.b", "source", "_row", "_spans", "spans", "row"]
    odd = docs.toDF(*names)
    n = odd.count()
    for out, rows in ((quality.keep_good(odd, None), None), (jaccard.keep_first(odd), 7), (substrings.deduplicate(odd), n), (mixing.mix(odd), None), (exact.keep_last(odd), 5)):
        assert out.columns == names
        got = out.collect()
        assert rows is None or len(got) == rows
        assert {tuple(r)[2] for r in got} <= {None, "en"}
