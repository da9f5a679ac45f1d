"""Short-text sentiment (T1-T12): language filter, normalisation, tokens,
presence features, Naive Bayes classes, per-record programs, totals and
recent windows. A *scored* frame has ``text, sentiment, ts``."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as TX
from fathom.functions.time import ensure_ntz, ntz_literal
from fathom.session import scratch_path


def filter_language(texts: DataFrame, lang: str = "en", lang_col: str = "lang") -> DataFrame:
    """Texts in one language."""
    return texts.where(F.col(lang_col) == F.lit(lang))


def language_counts(texts: DataFrame, lang_col: str = "lang") -> DataFrame:
    """T1 metrics: records per language."""
    return texts.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))


def text_events(lines: DataFrame, text_col: str = "text", ts_col: str | None = None) -> DataFrame:
    """Raw records -> ``text, created_at`` (null texts are ignored)."""
    ts = F.col(ts_col) if ts_col else F.lit(None).cast("timestamp_ntz")
    return lines.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), ts.alias("created_at"))


def text_metrics(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """T2 metrics: accepted records, their characters, ignored (null) records."""
    t = F.col(text_col)
    return lines.agg(F.count(t).alias("n"), F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("chars"),
                     F.sum(t.isNull().cast("long")).alias("ignored"))


def observed_text_events(lines: DataFrame, text_col: str = "text", ts_col: str | None = None, name="feed") -> DataFrame:
    """T2 with its live metrics: :func:`text_events`, counted on the way by ``observe``, in the same pass that moves the
    records. ``name`` is a name (read by :class:`fathom.streaming.metrics.FeedMetrics` per micro-batch) or a
    ``pyspark.sql.Observation`` (read after a batch job): ``accepted`` records, their ``chars``, ``ignored`` nulls."""
    t = F.col(text_col)
    seen = lines.observe(name, F.count(t).alias("accepted"), F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("chars"),
                         F.count_if(t.isNull()).alias("ignored"))
    return text_events(seen, text_col, ts_col)


def normalize_text(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``norm`` (see :func:`fathom.functions.text.normalize`)."""
    return texts.withColumn("norm", TX.normalize(text_col))


def tokenize_text(texts: DataFrame, stopwords=(), norm_col: str = "norm") -> DataFrame:
    """T4: adds ``tokens`` (see :func:`fathom.functions.text.tokens`). With no
    stop words nothing is dropped, as in the reference's scorer."""
    return texts.withColumn("tokens", TX.tokens(norm_col, stopwords))


def presence_pairs(tokenized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T5: the presence features as (id, token) pairs, one per distinct token."""
    return tokenized.select(id_col, F.explode(F.array_distinct("tokens")).alias("token"))


def document_frequency(tokenized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T5 over a corpus: in how many texts each token is present."""
    return presence_pairs(tokenized, id_col).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


@dataclass
class SentimentModel:
    """Bernoulli Naive Bayes: ``classes`` in alphabetical order, ``base`` their score of a text without known tokens,
    ``tokens`` a stored table ``token, w0 .. wk`` of what each token adds to each class's score."""

    classes: list[str]
    base: list[float]
    tokens: DataFrame


def train_sentiment(labelled: DataFrame, label_col: str = "sentiment", smoothing: float = 1.0,
                    id_col: str = "doc_id") -> SentimentModel:
    """T6 training from (text, token) pairs: every token of the labelled texts counts, however many there are. The
    driver sees one row per class and nothing per token."""
    spark = labelled.sparkSession
    docs = labelled.select(id_col, F.col(label_col).alias("c"), F.array_distinct("tokens").alias("tokens"))
    n = {r["c"]: r["n"] for r in docs.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(n)
    pairs = docs.select("c", F.explode("tokens").alias("token"))
    counts = pairs.groupBy("token").agg(*[F.sum((F.col("c") == F.lit(c)).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)])
    total = sum(n.values())
    cols, outside = [], []
    for i, c in enumerate(classes):
        p = (F.col(f"n{i}") + F.lit(smoothing)) / F.lit(n[c] + 2.0 * smoothing)
        cols.append((F.log(p) - F.log1p(-p)).alias(f"w{i}"))
        outside.append(F.log1p(-p).alias(f"o{i}"))
    path = scratch_path(spark, "tokens")
    counts.select("token", *cols, *outside).write.parquet(path)
    table = spark.read.parquet(path)
    absent = table.agg(*[F.coalesce(F.sum(f"o{i}"), F.lit(0.0)).alias(f"o{i}") for i in range(len(classes))]).first()
    base = [math.log((n[c] + smoothing) / (total + smoothing * len(classes))) + absent[f"o{i}"] for i, c in enumerate(classes)]
    return SentimentModel(classes, base, table.select("token", *[f"w{i}" for i in range(len(classes))]))


SHARE = 10_000  # a token in more than one of so many pairs is hot; there are fewer than SHARE of those
BROADCAST_TOKENS = 500_000  # rows of a token table (about 40 bytes each) that go to all tasks


def classify_sentiment(model: SentimentModel, tokenized: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                       broadcast_tokens: int = BROADCAST_TOKENS, share: int = SHARE) -> DataFrame:
    """T6 scoring: the class with the largest score; an exact tie goes to the first name. ``keep`` must tell texts apart.

    A token table of at most ``broadcast_tokens`` rows goes to all tasks: no token is shuffled, and what leaves a task
    is one partial sum per text. Of a larger table only the weights of hot tokens do, counted over the texts that
    are scored: those with more than one in ``share`` of all (text, token) pairs, fewer than ``share`` tokens
    whatever the corpus is. Their pairs are summed where they are; the other pairs meet the table by a shuffle on the
    token, in which no token has more than that share of the rows."""
    k = len(model.classes)
    spark = tokenized.sparkSession
    sets = tokenized.select(*keep, F.array_distinct("tokens").alias("tokens"))
    small = model.tokens.count() <= broadcast_tokens
    if not small:  # read several times from here on, made once
        path = scratch_path(spark, "token-sets")
        sets.write.parquet(path)
        sets = spark.read.parquet(path)
    pairs = sets.select(*keep, F.explode_outer("tokens").alias("token"))
    if small:
        joined = pairs.join(F.broadcast(model.tokens), "token", "left")
    else:
        path = scratch_path(spark, "frequency")
        pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = spark.read.parquet(path)
        hot = n.where(F.col("n") * share > F.lit(n.agg(F.sum("n")).first()[0] or 0)).where(F.col("token").isNotNull())
        weights = model.tokens.join(F.broadcast(hot.select("token")), "token", "left_semi")
        first = pairs.join(F.broadcast(hot.select("token", F.lit(True).alias("_hot"))), "token", "left")
        cols = ["token", *keep]
        near = first.where("_hot").select(*cols).join(F.broadcast(weights), "token", "left")
        # texts without tokens have a null token, which meets nothing and is not to be gathered either
        none = first.where("token IS NULL").select(*cols).select(*cols, *[F.lit(None).cast("double").alias(f"w{i}") for i in range(k)])
        far = first.where("_hot IS NULL AND token IS NOT NULL").select(*cols).join(model.tokens, "token", "left")
        joined = near.unionByName(none).unionByName(far)
    sums = joined.groupBy(*keep).agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(k)])
    score = [F.col(f"w{i}") + F.lit(model.base[i]) for i in range(k)]
    best, name = score[0], F.lit(model.classes[0])
    for i in range(1, k):
        name = F.when(score[i] > best, F.lit(model.classes[i])).otherwise(name)
        best = F.greatest(best, score[i])
    return sums.select(*keep, name.alias("sentiment"))


def per_value(fn: Callable) -> Callable:
    """A batch function from a function of one value."""
    return lambda values: pd.Series([fn(v) for v in values], index=values.index, dtype=object)


def score_with_program(df: DataFrame, load: Callable[[], Callable], input_col: str, output_col: str, keep: tuple[str, ...] = (),
                       output_type: str = "string") -> DataFrame:
    """Run a program over Arrow batches with ``mapInPandas``. ``load()`` runs once per task and returns a function
    from a Series of values to a Series of results. Null inputs are skipped. If a batch raises, its values run
    one by one, and only those that raise get ``status = 'failed'`` and the error text (T12); a null result is
    not emitted."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep),
                        f"`{output_col}` {output_type}", "status string", "error string"])

    def alone(fn, values):
        outs, errs = [], []
        for i in range(len(values)):
            try:
                outs.append(fn(values.iloc[i:i + 1]).iloc[0])
                errs.append(None)
            except Exception as e:  # noqa: BLE001 - quarantined, never fails the batch
                outs.append(None)
                errs.append(f"{type(e).__name__}: {e}")
        return outs, errs

    def run(batches):
        fn = load()
        for pdf in batches:
            pdf = pdf[pdf[input_col].notna()]
            if not len(pdf):
                continue
            try:
                outs, errs = list(fn(pdf[input_col])), [None] * len(pdf)
            except Exception:  # noqa: BLE001
                outs, errs = alone(fn, pdf[input_col])
            res = pd.DataFrame({**{k: pdf[k].values for k in keep}, output_col: pd.Series(outs, dtype=object),
                                "status": ["ok" if e is None else "failed" for e in errs], "error": pd.Series(errs, dtype=object)})
            res = res[~((res["status"] == "ok") & res[output_col].isna())].reset_index(drop=True)
            if len(res):
                yield res

    return df.select(*keep, input_col).mapInPandas(run, schema)


def quarantine_failures(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a program's output into (ok, failed) frames."""
    return scored.where(F.col("status") == "ok"), scored.where(F.col("status") != "ok")


def sentiment_totals(scored: DataFrame, classes=("positive", "negative", "neutral"), total: bool = True) -> DataFrame:
    """Count per sentiment; the given classes appear with 0 when absent,
    and a ``total`` row sums them all."""
    spark = scored.sparkSession
    counts = scored.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(c,) for c in classes], "sentiment string")
    out = known.join(counts, "sentiment", "full_outer").select("sentiment", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if total:
        out = out.unionByName(out.agg(F.lit("total").alias("sentiment"), F.sum("n").cast("long").alias("n")))
    return out


def sentiment_series(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """The append-only series ``sentiment, ts, text`` (every entry kept)."""
    return ensure_ntz(scored, "ts").select(id_col, "sentiment", "ts", "text")


def _in_window(series: DataFrame, start, end) -> DataFrame:
    """Rows with ``start <= ts <= end``; on a date-partitioned series the
    matching ``date`` predicate prunes partitions at the scan."""
    out = series.where((F.col("ts") >= start) & (F.col("ts") <= end))
    if "date" in series.columns:
        out = out.where((F.col("date") >= F.to_date(start)) & (F.col("date") <= F.to_date(end)))
    return out


def recent_texts(series: DataFrame, sentiment: str, now, seconds: float = 300, limit: int = 10,
                 id_col: str = "id") -> DataFrame:
    """Entries of one sentiment with ts in ``[now - seconds, now]``: the
    first ``limit`` by ascending ts, then the latest ts per distinct text."""
    end = ntz_literal(now)
    start = F.timestamp_add("MICROSECOND", F.lit(-int(seconds * 1_000_000)), end)
    s = _in_window(series.where(F.col("sentiment") == F.lit(sentiment)), start, end)
    first = s.orderBy("ts", id_col).limit(limit)
    return first.groupBy("text").agg(F.max("ts").alias("ts"))


def recent_counts(series: DataFrame, sentiments, now, seconds: float = 300, rate_divisor: float = 20.0) -> DataFrame:
    """Per requested sentiment, entries in ``[now - seconds, now]`` (0 when
    none) and the dashboard's rate ``n / rate_divisor``."""
    spark = series.sparkSession
    end = ntz_literal(now)
    start = F.timestamp_add("MICROSECOND", F.lit(-int(seconds * 1_000_000)), end)
    s = _in_window(series, start, end).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    want = spark.createDataFrame([(x,) for x in sentiments], "sentiment string")
    out = want.join(s, "sentiment", "left").select("sentiment", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("rate", F.col("n") / F.lit(float(rate_divisor)))
