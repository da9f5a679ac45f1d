"""Registered text queries over ``documents`` (classes from ``labels``) and,
for the time-windowed ones, ``events`` as a scored stream (class = type)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fathom.functions import text as TX
from fathom.operators import text as T
from fathom.plans.registry import query
from fathom.session import scratch_path
from fathom.sources import standins
from fathom.sources.tables import load


def _re2(p: str) -> str:
    """The same pattern for DuckDB's RE2: \\uXXXX -> \\x{XXXX}."""
    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NORM = (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), {_q(_re2(TX.URL_PATTERN))}, "
        f"'URL', 'g'), {_q(_re2(TX.USER_PATTERN))}, 'USER', 'g'), {_q(_re2(TX.SPACE_PATTERN))}, ' ', 'g'), "
        f"{_q(_re2(TX.HASHTAG_PATTERN))}, '\\1', 'g'), {_q(TX.EDGE_QUOTES)})")
COLLAPSE = ("array_to_string(list_filter(string_split(t, ''), lambda x, i: i < 3 OR NOT "
            "(x = string_split(t, '')[i - 1] AND x = string_split(t, '')[i - 2])), '')")
TOKENS = (f"list_transform(list_filter(regexp_split_to_array(norm, {_q('[' + _re2(TX.SPLIT_WS) + ']+')}), "
          f"lambda t: t <> ''), lambda t: trim({COLLAPSE}, {_q(TX.TOKEN_EDGE)}))")
NORMED = f"normed AS (SELECT doc_id, {NORM} AS norm FROM documents)"
TOKED = f"tk AS (SELECT doc_id, {TOKENS} AS tokens FROM normed)"
LABEL = """lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                                  ELSE 'neutral' END AS c FROM labels JOIN documents USING (doc_id))"""


def _docs(spark, sf):
    return load(spark, sf, "documents")


def _tokenized(spark, sf):
    return T.tokenize_text(T.normalize_text(_docs(spark, sf)))


@query("text_filter_language", sql="SELECT doc_id, text FROM documents WHERE lang = 'en'")
def filter_language(spark, sf):
    return T.filter_language(_docs(spark, sf)).select("doc_id", "text")


@query("text_language_counts", sql="SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf):
    return T.language_counts(_docs(spark, sf))


@query("text_metrics", sql="""SELECT count(text) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars,
  CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ignored
  FROM (SELECT CASE WHEN event_type <> 'error' THEN props END AS text FROM events)""")
def metrics(spark, sf):
    return T.text_metrics(standins.raw_texts(load(spark, sf, "events")))


@query("text_normalize", sql=f"WITH {NORMED} SELECT doc_id, norm FROM normed")
def normalize(spark, sf):
    return T.normalize_text(_docs(spark, sf)).select("doc_id", "norm")


@query("text_tokens", sql=f"""WITH {NORMED}, {TOKED}
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INT) AS n_tokens FROM tk""")
def tokens(spark, sf):
    t = _tokenized(spark, sf)
    return t.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query("text_document_frequency", sql=f"""WITH {NORMED}, {TOKED}
SELECT token, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS token FROM tk) GROUP BY token""")
def document_frequency(spark, sf):
    return T.document_frequency(_tokenized(spark, sf))


NB = f"""WITH {NORMED}, {TOKED}, {LABEL},
tr AS (SELECT lab.doc_id, lab.c, unnest(list_distinct(tk.tokens)) AS w FROM lab JOIN tk USING (doc_id)),
vocab AS (SELECT DISTINCT w FROM tr),
nc AS (SELECT c, count(*) AS n FROM lab GROUP BY c),
tot AS (SELECT count(*) AS nn, count(DISTINCT c) AS k FROM lab),
th AS (SELECT c, w, ln(count(*) + 1.0) - ln(any_value(nc.n) + 2.0) AS lt FROM tr JOIN nc USING (c) GROUP BY c, w),
base AS (SELECT nc.c, ln(nc.n + 1.0) - ln(tot.nn + tot.k * 1.0) AS pi, -ln(nc.n + 2.0) AS lt0 FROM nc, tot),
s0 AS (SELECT b.c, b.pi + coalesce((SELECT sum(ln(1 - exp(th.lt))) FROM th WHERE th.c = b.c), 0)
              + ((SELECT count(*) FROM vocab) - (SELECT count(*) FROM th WHERE th.c = b.c)) * ln(1 - exp(b.lt0)) AS s0,
              b.lt0 FROM base b),
dv AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(tokens) AS w FROM tk) WHERE w IN (SELECT w FROM vocab)),
sc AS (SELECT dv.doc_id, s0.c, sum(coalesce(th.lt, s0.lt0) - ln(1 - exp(coalesce(th.lt, s0.lt0)))) AS s
       FROM dv, s0 LEFT JOIN th ON th.c = s0.c AND th.w = dv.w GROUP BY dv.doc_id, s0.c),
tot_s AS (SELECT tk.doc_id, s0.c, s0.s0 + coalesce(sc.s, 0) AS score FROM tk, s0
          LEFT JOIN sc ON sc.doc_id = tk.doc_id AND sc.c = s0.c),
pick AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, c ASC) AS rn FROM tot_s),
scored AS (SELECT doc_id, c FROM pick WHERE rn = 1)
"""


def _classified(spark, sf):
    # what both steps read of a text, its distinct tokens, is made once
    path = scratch_path(spark, "token-sets")
    _tokenized(spark, sf).select("doc_id", F.array_distinct("tokens").alias("tokens")).write.parquet(path)
    tok = spark.read.parquet(path)
    lab = standins.labelled_texts(_docs(spark, sf), load(spark, sf, "labels")).select("doc_id", "sentiment")
    return T.classify_sentiment(T.train_sentiment(tok.join(lab, "doc_id")), tok)


@query("text_sentiment", sql=NB + "SELECT doc_id, c AS sentiment FROM scored")
def sentiment(spark, sf):
    return _classified(spark, sf)


def _normalizer():
    """The program of T7, loaded once per task."""
    return T.per_value(TX.normalize_py)


def _strict_normalizer():
    """A program that fails on texts with a raw hash sign run."""

    def fn(v):
        if "###" in v:
            raise ValueError("hash run")
        return TX.normalize_py(v)

    return T.per_value(fn)


@query("text_program_normalize", sql=f"WITH {NORMED} SELECT doc_id, norm, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM normed")
def program_normalize(spark, sf):
    return T.score_with_program(_docs(spark, sf), _normalizer, "text", "norm", keep=("doc_id",))


@query("text_quarantine", sql=f"""WITH {NORMED}, o AS (SELECT n.doc_id, n.norm, contains(d.text, '###') AS bad FROM normed n JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN bad THEN NULL ELSE norm END AS norm, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN bad THEN 'ValueError: hash run' END AS error FROM o""")
def quarantine(spark, sf):
    # one run of the program; the frames of T12 are filters on its stored result
    path = scratch_path(spark, "scored")
    T.score_with_program(_docs(spark, sf), _strict_normalizer, "text", "norm", keep=("doc_id",)).write.parquet(path)
    ok, failed = T.quarantine_failures(spark.read.parquet(path))
    return ok.unionByName(failed)


STOP = ["the", "and", "of", "to", "in", "is", "for", "la", "de", "und", "der"]


@query("text_tokens_stop_words", sql=f"""WITH {NORMED}, {TOKED},
k AS (SELECT doc_id, list_filter(tokens, lambda t: NOT (regexp_matches(t, {_q(TX.WORDLIKE)}) AND t IN ({', '.join(map(_q, [*STOP, *TX.RESERVED_STOPWORDS]))}))) AS tokens FROM tk)
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INT) AS n_tokens FROM k""")
def tokens_stop_words(spark, sf):
    t = T.tokenize_text(T.normalize_text(_docs(spark, sf)), stopwords=STOP)
    return t.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query("text_events", sql="SELECT text, ts AS created_at FROM (SELECT CASE WHEN event_type <> 'error' THEN props END AS text, ts FROM events) WHERE text IS NOT NULL")
def text_events(spark, sf):
    return T.text_events(standins.raw_texts(load(spark, sf, "events")), "text", "ts")


@query("text_sentiment_totals", sql=NB + """, k AS (SELECT * FROM (VALUES ('positive'), ('negative'), ('neutral')) v(c)),
t AS (SELECT coalesce(k.c, x.c) AS sentiment, CAST(coalesce(x.n, 0) AS BIGINT) AS n
      FROM k FULL OUTER JOIN (SELECT c, count(*) AS n FROM scored GROUP BY c) x ON k.c = x.c)
SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM t""")
def sentiment_totals(spark, sf):
    return T.sentiment_totals(_classified(spark, sf))


EVSQL = "ev AS (SELECT event_id AS id, props AS text, event_type AS sentiment, ts FROM events)"
NOW, SECS = "2024-01-15 12:00:00", 86400


def _series(spark, sf):
    return T.sentiment_series(standins.scored_from_events(load(spark, sf, "events")))


@query("text_sentiment_series", sql=f"WITH {EVSQL} SELECT id, sentiment, ts, text FROM ev")
def sentiment_series(spark, sf):
    return _series(spark, sf)


@query("text_recent_texts", sql=f"""WITH {EVSQL}, f AS (SELECT * FROM ev WHERE sentiment = 'purchase'
  AND ts >= TIMESTAMP '{NOW}' - INTERVAL {SECS} SECOND AND ts <= TIMESTAMP '{NOW}' ORDER BY ts, id LIMIT 10)
SELECT text, max(ts) AS ts FROM f GROUP BY text""")
def recent_texts(spark, sf):
    return T.recent_texts(_series(spark, sf), "purchase", NOW, SECS, 10)


CLASSES = ["click", "purchase", "view", "signup", "error", "unknown"]


@query("text_recent_counts", sql=f"""WITH {EVSQL}, k AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in CLASSES)}) v(sentiment)),
x AS (SELECT sentiment, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {SECS} SECOND
      AND ts <= TIMESTAMP '{NOW}' GROUP BY sentiment)
SELECT k.sentiment, CAST(coalesce(x.n, 0) AS BIGINT) AS n, coalesce(x.n, 0) / 20.0 AS rate FROM k LEFT JOIN x USING (sentiment)""")
def recent_counts(spark, sf):
    return T.recent_counts(_series(spark, sf), CLASSES, NOW, SECS)
