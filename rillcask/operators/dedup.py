"""Latest and first rows per key. All of them aggregate map-side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank_key(order: list[str]) -> Column:
    return F.struct(*order)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the greatest ``order`` per key; end ``order`` in a unique column.

    Works on streams too (update mode), where a ROW_NUMBER filter does not.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), _rank_key(order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def earliest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), _rank_key(order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def latest_value(value: str, order: list[str], skip_nulls: bool = False) -> Column:
    """Aggregate: the value of the last row, or the last non-null value."""
    key = _rank_key(order)
    return F.max_by(value, F.when(F.col(value).isNotNull(), key) if skip_nulls else key)


def earliest_value(value: str, order: list[str], skip_nulls: bool = False) -> Column:
    key = _rank_key(order)
    return F.min_by(value, F.when(F.col(value).isNotNull(), key) if skip_nulls else key)


def latest_agg(
    df: DataFrame, keys: list[str], values: list[str], order: list[str],
    skip_nulls: bool = False,
) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[latest_value(v, order, skip_nulls).alias(v) for v in values]
    )


def earliest_agg(
    df: DataFrame, keys: list[str], values: list[str], order: list[str],
    skip_nulls: bool = False,
) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[earliest_value(v, order, skip_nulls).alias(v) for v in values]
    )


# Changelog operations. Before-images carry no state of their own.
INSERTS = ("+I", "INSERT", "+U", "UPDATE_AFTER")
DELETES = ("-D", "DELETE")
BEFORE_IMAGES = ("-U", "UPDATE_BEFORE")


def apply_changelog(df: DataFrame, keys: list[str], op: str, seq: list[str]) -> DataFrame:
    """Current rows of a changelog: the last change per key unless that is a delete."""
    changes = df.where(~F.col(op).isin(*BEFORE_IMAGES))
    return latest_by_key(changes, keys, seq).where(~F.col(op).isin(*DELETES)).drop(op)


def dedup_window(
    df: DataFrame, keys: list[str], ts: str, size: str, tiebreak: str, count: str = "n"
) -> DataFrame:
    """First row per key in each tumbling window, with the window and the key's row count.

    On a stream set a watermark first; append mode emits a window once it closes.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(F.window(ts, size).alias("__w"), *keys)
        .agg(
            F.min_by(F.struct(*rest), F.struct(ts, tiebreak)).alias("__row"),
            F.count(F.lit(1)).alias(count),
        )
        .select(
            *keys, "__row.*", count,
            F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
        )
    )


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def distinct_within(df: DataFrame, columns: list[str], ts: str, ttl: str) -> DataFrame:
    """Distinct rows of a stream, remembered for ``ttl`` of event time.

    Without a lifetime the state would grow for ever. A row repeated later than that counts as
    new. When that happens depends on the watermark, which a table does not have: use
    ``distinct`` there.
    """
    if not df.isStreaming:
        raise TypeError("a lifetime needs a stream; a table has distinct()")
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(columns)
