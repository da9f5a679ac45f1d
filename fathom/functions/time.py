"""Time helpers that do not depend on the session time zone.

Every operator works on ``TIMESTAMP_NTZ`` columns holding UTC wall-clock time
(that is what parquet timestamps without a zone read as). Buckets are integer
indexes ``floor(epoch / width)``; the same arithmetic is used by the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_UNITS = {
    "us": 1e-6, "microsecond": 1e-6, "microseconds": 1e-6,
    "ms": 1e-3, "millisecond": 1e-3, "milliseconds": 1e-3,
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
}


def seconds_of(x) -> float:
    """``600``, ``'10 minutes'``, ``'5s'`` -> seconds."""
    if isinstance(x, (int, float)):
        return float(x)
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]+)\s*", str(x))
    if not m or m.group(2).lower() not in _UNITS:
        raise ValueError(f"cannot read a duration from {x!r}")
    return float(m.group(1)) * _UNITS[m.group(2).lower()]


def micros_of(x) -> int:
    return int(round(seconds_of(x) * 1_000_000))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sql(col) -> str:
    """SQL text for a column given by name (backticked) or as SQL text in parentheses."""
    if isinstance(col, str):
        return col if col.startswith("(") else f"`{col}`"
    raise TypeError("pass a column name or a parenthesised SQL expression")


def epoch_us(col) -> Column:
    """Microseconds since 1970-01-01 of a UTC ``TIMESTAMP_NTZ`` column."""
    return F.expr(epoch_us_sql(col))


def epoch_us_sql(col) -> str:
    return f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {_sql(col)})"


def from_epoch_us(col) -> Column:
    """Inverse of :func:`epoch_us`, as ``TIMESTAMP_NTZ``."""
    return F.timestamp_add("MICROSECOND", _c(col), F.expr(EPOCH_NTZ))


def bucket_index_sql(col, width) -> str:
    d = micros_of(width)
    x = epoch_us_sql(col)
    # exact floor division, also for times before 1970
    return f"(({x} - pmod({x}, {d})) div {d})"


def bucket_index(col, width) -> Column:
    """``floor(epoch / width)`` as BIGINT; width in seconds or as text."""
    return F.expr(bucket_index_sql(col, width))


def bucket_start(index_col, width) -> Column:
    """Start of bucket ``index`` as ``TIMESTAMP_NTZ``."""
    return from_epoch_us(_c(index_col) * F.lit(micros_of(width)))


def ntz_literal(value) -> Column:
    """A ``TIMESTAMP_NTZ`` literal from text like ``'2024-01-05 00:00:00'``."""
    return F.lit(str(value)).cast("timestamp_ntz")


def ensure_ntz(df: DataFrame, col: str) -> DataFrame:
    """Turn a zone-aware ``TIMESTAMP`` column into UTC ``TIMESTAMP_NTZ``."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return df
    if isinstance(dt, T.TimestampType):
        return df.withColumn(col, from_epoch_us(F.unix_micros(F.col(col))))
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
