"""The pipeline against its stages' brute-force versions, and the shape of STAGES."""

from collections import Counter
from hashlib import sha256

import pytest
from test_dedup_ops import components, corpus, removed
from test_text_ops import WORDS, frame, library


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    texts = [t for seed in (11, 12) for t in corpus(seed, 80)] + ["menu | home | about | " * 12, "$$$ %%% buy now! " * 20]
    docs = frame(spark, texts, {i: "abc"[i % 3] for i in range(len(texts))}).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{base}/documents.parquet")
    rows = [(i, int("|" not in (t or "") and "$" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 == 0 or i > len(texts) - 3]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, texts


def test_stages(spark, tables):
    import corpus_pipeline
    from fathom.llm import mixing, quality

    base, texts = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = corpus_pipeline.run(spark, base).collect()

    good = sorted(r.doc_id for r in quality.judge(docs, quality.train(docs, labels)).collect() if r.kept)
    assert 20 < len(good) < len(texts)
    comp = components([texts[i] for i in good])
    first = [i for n, i in enumerate(good) if comp[n][1] == n]
    words, gone = removed([texts[i] for i in first])
    cut = {i: [w for j, w in enumerate(words[n]) if j not in gone[n]] for n, i in enumerate(first)}
    assert len(first) < len(good) and any(gone)

    stage = docs
    for _, fn in corpus_pipeline.STAGES[:3]:
        stage = fn(spark, stage, base)
        assert stage.columns == docs.columns
        stage = spark.createDataFrame(stage.collect(), docs.schema)
    assert {r.doc_id: WORDS.findall(r.text or "") for r in stage.collect()} == cut
    copies = {r.doc_id: (r.taken // r.size if r.size else None) for r in mixing.taken(stage).collect()}
    found = Counter(r.doc_id for r in got)
    assert all(found[i] == n for i, n in copies.items() if n is not None)
    text = {r.doc_id: r.text or "" for r in stage.collect()}
    t = library()
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_a_reused_worker_drops_the_vocabulary_for_other_tasks():
    """A worker that has encoded holds the vocabulary for the next encoding task and drops it when another stage comes."""
    import gc

    import pyarrow as pa

    from fathom.llm import bpe, quality, textio
    from fathom.llm.queries import vocab

    class Frame:  # what mapInArrow is given, as a worker would run it
        columns, schema, dtypes = ["text"], None, []

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):  # noqa: N802
            tasks.append(run)
            return self

    tasks = []
    held = lambda: sum(isinstance(x, (bpe.Vocabulary, bpe.PieceEncoder)) for x in gc.get_objects())
    textio.map_batches(Frame(), lambda b: None, "x int")
    textio.map_batches(Frame(), lambda b: {"x": [len(bpe.load(vocab())[1].encode_batch(["a b"]))]}, "x int", keep=True)
    quality.keep_good(Frame(), None)
    other, encoding, rules = tasks
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"])], names=["text"])
    for task in (other, rules):
        assert [b.to_pydict() for b in encoding(iter([batch]))] == [{"x": [1]}] and held() == 2
        list(task(iter([])))
        assert held() == 0


def test_registration():
    import __spark_entry__ as entry
    import corpus_pipeline

    queries = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in queries) == 1 for n in range(1, 11)) and "pipeline" in queries
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert set(entry.oracle_sql()) <= set(queries)
