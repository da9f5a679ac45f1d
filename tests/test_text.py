import datetime as dt

from fathom.functions.text import normalize_py
from fathom.operators import text as T


def test_normalize_rules(spark):
    cases = {
        '"Check http://x.io/a and www.site.com @Bob   #Great\tday"': "check URL and URL USER great day",
        "'quoted'": "quoted",
        "RT @a: hi": "rt USER hi",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r["norm"] for r in T.normalize_text(df).collect()}
    assert got == cases
    assert {k: normalize_py(k) for k in cases} == cases


def test_tokens_and_stopwords(spark):
    df = spark.createDataFrame([("sooooo cool!!! the, \"end\". ..",)], "norm string")
    toks = T.tokenize_text(df).first()["tokens"]
    assert toks == ["soo", "cool!!", "the", "end", ""]
    toks = T.tokenize_text(df, stopwords=["the", "cool"]).first()["tokens"]
    assert toks == ["soo", "cool!!", "end", ""]  # 'cool!!' is not word-like, so it stays


def test_sentiment_pipeline_smoke(spark):
    train = [("i love this so much", "positive"), ("love love it", "positive"), ("happy happy day", "positive"),
             ("i hate this", "negative"), ("hate it so much", "negative"), ("this is neutral", "neutral"),
             ("a neutral statement", "neutral")]
    tr = T.tokenize_text(T.normalize_text(spark.createDataFrame(
        [(i, t, c) for i, (t, c) in enumerate(train)], "doc_id long, text string, sentiment string")))
    model = T.train_sentiment(tr)
    test = ["I love it", "I hate it", "so neutral", "happy times"]
    te = T.tokenize_text(T.normalize_text(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string")))
    scored = T.classify_sentiment(model, te)
    totals = {r["sentiment"]: r["n"] for r in T.sentiment_totals(scored).collect()}
    assert totals == {"positive": 2, "negative": 1, "neutral": 1, "total": 4}


def test_program_quarantine(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, None)], "id long, text string")

    def fn(t):
        if t == "boom":
            raise ValueError("bad")
        return t.upper()

    out = T.score_with_program(df, lambda: T.per_value(fn), "text", "out", keep=("id",))
    ok, failed = T.quarantine_failures(out)
    assert [(r.id, r.out) for r in ok.collect()] == [(1, "OK")]
    assert [(r.id, r.status) for r in failed.collect()] == [(2, "failed")]


def test_recent_windows(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(i, f"t{i % 3}", "positive" if i % 2 else "negative", t0 + dt.timedelta(seconds=30 * i)) for i in range(20)]
    s = spark.createDataFrame(rows, "id long, text string, sentiment string, ts timestamp_ntz")
    now = t0 + dt.timedelta(seconds=600)
    c = {r["sentiment"]: r["n"] for r in T.recent_counts(s, ["positive", "negative", "neutral"], str(now), 300).collect()}
    assert c == {"positive": 5, "negative": 5, "neutral": 0}  # i = 10..19
    rt = T.recent_texts(s, "positive", str(now), 300, limit=2).collect()
    assert sorted(r["text"] for r in rt) == ["t1", "t2"]  # i = 11, 13


def test_hot_tokens_are_split_without_changing_scores(spark):
    rows = [(i, "the " + " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 6)), "abc"[i % 3]) for i in range(60)] + [(60, "", "a"), (61, "unseen", "b")]
    tok = T.tokenize_text(T.normalize_text(spark.createDataFrame(rows, "doc_id long, text string, sentiment string")))
    model = T.train_sentiment(tok.where("doc_id < 40"))
    want = {r["doc_id"]: r["sentiment"] for r in T.classify_sentiment(model, tok).collect()}
    assert len(want) == 62
    for share in (1, 10, 1000):  # no hot token, some, all
        assert {r["doc_id"]: r["sentiment"] for r in T.classify_sentiment(model, tok, broadcast_tokens=0, share=share).collect()} == want


def test_observed_events(spark):
    from pyspark.sql import Observation

    seen = Observation("feed")
    lines = spark.createDataFrame([("ab", 1), (None, 2), ("é", 3)], "text string, n int")
    assert T.observed_text_events(lines, name=seen).count() == 2
    assert seen.get == {"accepted": 2, "chars": 3, "ignored": 1}


def test_sentiment_makes_token_sets_once(spark, tmp_path, monkeypatch):
    from fathom.plans import text as P

    texts = [(1, "good fine good", "en", "a", 14), (2, "bad awful", "en", "a", 9), (3, "Fine!", "en", "b", 5), (4, None, "en", "b", 0), (3, "bad", "en", "b", 3)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for name in ("train_sentiment", "classify_sentiment"):
        whole = getattr(P.T, name)
        monkeypatch.setattr(P.T, name, lambda *a, whole=whole: seen.append(a[-1]) or whole(*a))
    got = sorted(map(tuple, P.sentiment(spark, str(tmp_path)).collect()))
    assert [i for i, _ in got] == [1, 2, 3, 4] and dict(got)[1] == "positive" and dict(got)[2] == "negative"
    assert len(seen) == 2
    for frame in seen:  # neither step normalises and splits the texts again
        assert "regexp_replace" not in frame._jdf.queryExecution().optimizedPlan().toString()
