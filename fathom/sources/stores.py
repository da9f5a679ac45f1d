"""Counter stores that survive replays.

A store is a DataFrame of increments keyed by ``(batch, *keys)``. Adding a
delta replaces the rows of the same batch instead of adding to them, so a
rerun of a slice or a replayed micro-batch does not double its counts; the
totals are a plain ``groupBy(keys).sum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_counters(store: DataFrame | None, delta: DataFrame, keys: list[str], value_cols: list[str],
                 batch_col: str = "batch", batches: list | None = None) -> DataFrame:
    """Store + delta, where delta rows replace any stored rows of the same batch. ``batches`` names the batches
    that the delta is for; a rerun of a batch that has no rows any more then removes the old ones, too. Without
    it they are read from the delta's rows."""
    delta = delta.select(batch_col, *keys, *value_cols)
    if store is None:
        return delta
    if batches is None:
        kept = store.join(delta.select(batch_col).distinct(), batch_col, "left_anti")
    else:
        kept = store.where(~F.col(batch_col).isin(*batches))
    return kept.unionByName(delta)


def counter_totals(store: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    return store.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in value_cols])


class CounterStore:
    """X2 as a stored table of bounded size: increments per batch, folded into a snapshot from time to time.

    ``add`` writes a batch's increments under its id (a replay overwrites them). ``compact(upto)`` folds all batches up to
    ``upto`` into a new snapshot and moves the increments of later ones to a new folder; both are written before the one
    row of the manifest that names them. Readers follow the newest manifest row and see the snapshot plus the open
    batches only, so totals cost the distinct keys and what came since, not the history. A crash before the manifest
    row changes nothing (the next ``compact`` writes the same folders again), and a replay of a batch that the
    snapshot holds is ignored, because increments up to ``upto`` no longer count. Batch ids are integers; one writer."""

    MANIFEST = "version long, upto long"

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], values: tuple[str, ...] = ("n",)):
        """``keys``: name -> type of the key columns."""
        self.spark, self.path, self.keys, self.values = spark, path, list(keys), list(values)
        self.row = ", ".join([f"`{k}` {t}" for k, t in keys.items()] + [f"`{v}` long" for v in values])
        # folders exist from the start, so that a store without rows can be read
        self.spark.createDataFrame([], "upto long").write.mode("append").parquet(f"{path}/manifest/version=-1")

    def _manifest(self) -> tuple[int, int | None]:
        """(version, last folded batch); (0, None) before the first compaction. One row per compaction is read."""
        rows = self.spark.read.schema("upto long, version long").parquet(f"{self.path}/manifest").where("upto IS NOT NULL")
        last = rows.orderBy(F.col("version").desc()).first()
        return (last["version"], last["upto"]) if last else (0, None)

    def _open(self, version: int) -> str:
        return f"{self.path}/open/version={version}"

    def add(self, batch_id: int, delta: DataFrame) -> None:
        """Increments ``keys, values`` of one batch; ids that a snapshot already holds are left alone."""
        version, upto = self._manifest()
        if upto is None or batch_id > upto:
            delta.select(*self.keys, *self.values).write.mode("overwrite").parquet(f"{self._open(version)}/batch={batch_id}")

    def _increments(self, version: int, upto: int | None) -> DataFrame:
        self.spark.createDataFrame([], self.row).write.mode("append").parquet(f"{self._open(version)}/batch=-1")
        t = self.spark.read.schema(f"{self.row}, batch long").parquet(self._open(version)).where("batch >= 0")
        return t if upto is None else t.where(F.col("batch") > F.lit(upto))

    def _snapshot(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], self.row)
        return self.spark.read.schema(self.row).parquet(f"{self.path}/snapshots/version={version}")

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(v).cast("long").alias(v) for v in self.values])

    def totals(self) -> DataFrame:
        version, upto = self._manifest()
        return self._sum(self._snapshot(version).unionByName(self._increments(version, upto).drop("batch")))

    def fold(self, upto: int) -> int | None:
        """First half of ``compact``: the new folders, which no reader looks at yet. Returns their version."""
        version, folded = self._manifest()
        if folded is not None and upto <= folded:
            return None
        new, increments = version + 1, self._increments(version, folded)
        closed = increments.where(F.col("batch") <= F.lit(upto)).drop("batch")
        self._sum(self._snapshot(version).unionByName(closed)).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={new}")
        later = increments.where(F.col("batch") > F.lit(upto)).hint("rebalance", "batch")
        later.write.mode("overwrite").partitionBy("batch").parquet(self._open(new))
        return new

    def compact(self, upto: int) -> None:
        """Fold all batches up to ``upto``; the manifest row makes it count."""
        new = self.fold(upto)
        if new is not None:
            self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={new}")


def write_dated(df: DataFrame, path: str, ts_col: str = "ts") -> DataFrame:
    """Store a result by the date of ``ts_col`` and return the stored table: later reads with bounds on ``ts_col``
    that repeat them on ``date`` open only those dates' folders. The table is read back with the result's own schema,
    so a result without rows is an empty table. Rows are rebalanced by date before they are written: a date has one
    file where it is small, however many tasks the result had, and a crowded date is split over tasks (AQE)."""
    dated = df.withColumn("date", F.to_date(ts_col)).hint("rebalance", "date")
    dated.write.mode("overwrite").partitionBy("date").parquet(path)
    return read_dated(df.sparkSession, path, df.schema)


def read_dated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of :func:`write_dated`; ``schema`` is the stored result's, without the date."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType())])).parquet(path)
