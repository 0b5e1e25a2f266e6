"""Event time and watermarks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.functions.times import from_epoch
from rillcask.sources.tables import values_table


def with_event_time(
    df: DataFrame, column: str, form: str | None = None, name: str = "event_time"
) -> DataFrame:
    """Event time from the payload or from the time a record was appended.

    ``form`` is ``s``, ``ms`` or ``us`` for epoch numbers, a pattern for text, or None
    for a timestamp column. The result is TIMESTAMP, which watermarks require.
    """
    if form is None:
        time = F.col(column).cast("timestamp")
    elif form in ("s", "ms", "us"):
        time = from_epoch(F.col(column), form)
    else:
        time = F.try_to_timestamp(F.col(column), F.lit(form)).cast("timestamp")
    return df.withColumn(name, time)


def watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows later than ``delay`` behind the newest event time may be dropped by windows."""
    return df.withWatermark(ts, delay)


def heartbeat_rows(df: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """Literal rows in the shape of ``df``, to be fed to the source of a quiet stream.

    A window closes only when a later event arrives; a row that only carries a time
    moves the watermark past the last real event.
    """
    return values_table(df.sparkSession, rows, df.schema)


def without_heartbeats(df: DataFrame, key: str) -> DataFrame:
    """Drop results that stem from heartbeat rows, whose key is NULL."""
    return df.where(F.col(key).isNotNull())
