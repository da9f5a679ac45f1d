"""Live metrics of a text feed (T2): what ``observe`` counted in each micro-batch, as it ends."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from fathom.operators.text import observed_text_events
from fathom.streaming.streams import run_available_now

METRICS = "batch long, accepted long, chars long, ignored long"


class FeedMetrics(StreamingQueryListener):
    """Collects the observed counts of micro-batches, one small row each, while the stream runs; ``report`` may be
    given to be told of each at once. A micro-batch that is run again replaces its row."""

    def __init__(self, name: str = "feed", report=None):
        self.name, self.report = name, report
        self.rows: dict[int, tuple[int, int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None or event.progress.numInputRows == 0:
            return
        self.rows[event.progress.batchId] = (seen["accepted"], seen["chars"], seen["ignored"])
        if self.report:
            self.report(event.progress.batchId, seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_text_events(lines: DataFrame, out_path: str, checkpoint: str, metrics: FeedMetrics, text_col: str = "text", ts_col: str = "ts",
                       wait: float = 30.0) -> None:
    """Streaming T2: accepted records are appended to ``out_path`` (exactly once), their counts per micro-batch go to
    ``metrics``. Events reach a listener a little after the micro-batch; the call returns when the last one did, or
    after ``wait`` seconds."""
    spark = lines.sparkSession
    spark.streams.addListener(metrics)
    try:
        events = observed_text_events(lines, text_col, ts_col, metrics.name)
        q = run_available_now(events.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint), metrics.name)
        last, until = q.lastProgress, time.monotonic() + wait
        while last is not None and last["numInputRows"] and last["batchId"] not in metrics.rows and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(metrics)


def as_table(spark: SparkSession, metrics: FeedMetrics) -> DataFrame:
    """``batch, accepted, chars, ignored``: one row per micro-batch of this run."""
    return spark.createDataFrame([(b, *r) for b, r in sorted(metrics.rows.items())], METRICS)
