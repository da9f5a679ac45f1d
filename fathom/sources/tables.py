"""Reading tables, time slices, key ranges and SQL views.

All reads go through ``spark.read`` so Catalyst pushes the filters and the
column pruning into the parquet scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.time import ntz_literal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (lazy; nothing is read yet)."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_slice(spark: SparkSession, path: str, ts_col: str, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """X1 batch form: rows with ``start <= ts < end`` (either bound optional).

    The predicate is a plain comparison on the column, so it reaches the scan
    as a pushed filter (row-group skipping) and prunes date partitions when the
    data is partitioned by a column derived from ``ts``.
    """
    df = spark.read.format(fmt).load(path)
    if start is not None:
        df = df.where(F.col(ts_col) >= ntz_literal(start))
    if end is not None:
        df = df.where(F.col(ts_col) < ntz_literal(end))
    return df


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                file_glob: str | None = None) -> DataFrame:
    """X1 streaming form: the files of a folder as an append-only stream
    (``file_glob`` keeps only matching file names)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.load(path)


def read_series(df: DataFrame, key_col: str, key, ts_col: str, start=None, end=None) -> DataFrame:
    """One key's rows with ``start <= ts <= end`` (both ends included), ascending."""
    out = df.where(F.col(key_col) == F.lit(key))
    if start is not None:
        out = out.where(F.col(ts_col) >= _lit_like(start))
    if end is not None:
        out = out.where(F.col(ts_col) <= _lit_like(end))
    return out.orderBy(ts_col)


def scan_prefix(df: DataFrame, **leading_keys) -> DataFrame:
    """All rows whose leading key columns equal the given values."""
    out = df
    for c, v in leading_keys.items():
        out = out.where(F.col(c) == F.lit(v))
    return out


def write_keyed(df: DataFrame, keys: list[str], path: str, buckets: int = 64) -> str:
    """Store rows so that those of one leading key are together: a catalog table over ``path``, hashed into ``buckets``
    files by the first key and sorted by ``keys`` inside. Returns its name; :func:`read_keyed` reads it. Rows are dealt
    by the same hash before they are written, so every bucket is one file."""
    name = f"keyed_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, keys[0]).write.option("path", path).bucketBy(buckets, keys[0]).sortBy(*keys).saveAsTable(name)
    return name


def read_keyed(spark: SparkSession, name: str, **leading_keys) -> DataFrame:
    """X4 on a stored table: rows of the given leading keys. An equality on the first key opens one bucket
    (``SelectedBucketsCount`` in the plan), and inside it the sorted row groups are skipped by their statistics."""
    return scan_prefix(spark.table(name), **leading_keys)


def register_views(frames: dict) -> None:
    """Make results queryable by ``spark.sql`` under the given names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def _lit_like(v):
    return v if not isinstance(v, str) else ntz_literal(v)
