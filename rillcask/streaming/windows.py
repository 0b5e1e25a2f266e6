"""Time-window aggregates: one body for tables and streams where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcask.functions.times import seconds
from rillcask.operators.ordered import Limit, cumulated, lagged
from rillcask.operators.skew import find_hot


def _flat(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, *names,
    )


def tumbling(
    df: DataFrame, ts: str, size: str, keys: list[str], aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates per fixed window and key, with the window's bounds."""
    grouped = df.groupBy(F.window(ts, size).alias("window"), *keys)
    return _flat(grouped.agg(*[a.alias(n) for n, a in aggs.items()]), keys, list(aggs))


def hopping(
    df: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates per overlapping window; a row counts in each window that covers it."""
    grouped = df.groupBy(F.window(ts, size, slide).alias("window"), *keys)
    return _flat(grouped.agg(*[a.alias(n) for n, a in aggs.items()]), keys, list(aggs))


def second_stage(
    df: DataFrame, ts: str, first: str, second: str, keys: list[str],
    first_aggs: dict[str, Column], second_aggs: dict[str, Column],
) -> DataFrame:
    """Windows over windows: ``window_time`` keeps the time attribute of the first stage."""
    grouped = df.groupBy(F.window(ts, first).alias("w"), *keys).agg(
        *[a.alias(n) for n, a in first_aggs.items()]
    )
    timed = grouped.withColumn("__time", F.window_time("w")).drop("w")
    outer = timed.groupBy(F.window("__time", second).alias("window"), *keys)
    return _flat(outer.agg(*[a.alias(n) for n, a in second_aggs.items()]), keys, list(second_aggs))


SessionAggs = dict[str, tuple[str, str | None]]
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _partial(fn: str, column: str | None) -> Column:
    if fn == "count":
        return F.count(column or F.lit(1))
    return _MERGE[fn](column)


def _session_columns(df: DataFrame, keys: list[str], aggs: SessionAggs) -> DataFrame:
    length = F.unix_millis(F.col("session_end").cast("timestamp")) - F.unix_millis(
        F.col("session_start").cast("timestamp")
    )
    return df.select(
        *keys, "session_start", "session_end", length.alias("session_length_ms"), *aggs
    )


def session(
    df: DataFrame, ts: str, gap: str, keys: list[str], aggs: SessionAggs, hot: Limit = None
) -> DataFrame:
    """Sessions per key: rows no further apart than ``gap``. The end is the last event.

    ``aggs`` maps a name to (count | sum | min | max, column). A stream uses Spark's
    session window in append mode. A table is first reduced to one row per key and
    slot of ``gap`` length, map-side: rows of one slot always share a session. Only
    these slot rows are sorted per key, and a key with many of them is cut into chunks.
    """
    if df.isStreaming:
        grouped = df.groupBy(F.session_window(ts, gap), *keys).agg(
            F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
            *[_partial(fn, c).alias(n) for n, (fn, c) in aggs.items()],
        )
        return _session_columns(grouped, keys, aggs)
    micros = seconds(gap) * 1_000_000
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / micros)
    slots = df.where(F.col(ts).isNotNull()).groupBy(*keys, slot.alias("__slot")).agg(
        F.min(ts).alias("__first"), F.max(ts).alias("__last"),
        *[_partial(fn, c).alias(n) for n, (fn, c) in aggs.items()],
    )
    # Both windows go through ``ordered``: a key with many slots is cut into chunks.
    hot = find_hot(slots, keys, hot)
    before = lagged(slots, keys, ["__slot"], "__last", 1, "__before", hot)
    pause = F.unix_micros(F.col("__first").cast("timestamp")) - F.unix_micros(
        F.col("__before").cast("timestamp")
    )
    opens = before.withColumn("__new", F.when(pause <= micros, 0).otherwise(1))
    grouped = (
        cumulated(opens, keys, ["__slot"], "__new", "__earlier", hot)
        .withColumn("__session", F.col("__earlier") + F.col("__new"))
        .groupBy(*keys, "__session")
        .agg(
            F.min("__first").alias("session_start"), F.max("__last").alias("session_end"),
            *[_MERGE[fn](n).alias(n) for n, (fn, _) in aggs.items()],
        )
    )
    return _session_columns(grouped, keys, aggs)
