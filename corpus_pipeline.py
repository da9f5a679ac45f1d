"""Training-data pipeline: rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` applies them to the
table ``documents``, writing every stage's rows as Parquet in the shared folder and reading them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, jaccard, mixing, quality, substrings
from fathom.llm.queries import table, vocab
from fathom.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return substrings.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, vocab(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("BPE encoding", token_ids),
]

ORACLE_SQL = None  # the line labeller and the tokenizer have no SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
