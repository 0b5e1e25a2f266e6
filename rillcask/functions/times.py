"""Date and time expressions. None of them reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(interval: str) -> int:
    """Length of an interval like ``"6 hours"``."""
    n, unit = interval.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(n) * sizes[unit.lower().rstrip("s")]


def date_parts(ts: Column) -> dict[str, Column]:
    """Calendar parts; day_of_week runs from 1 = Sunday to 7 = Saturday."""
    return {
        "event_date": F.to_date(ts),
        "event_hour": F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "week_of_year": F.weekofyear(ts),
        "event_month": F.month(ts),
        "event_quarter": F.quarter(ts),
    }


def trunc_to(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def fmt_ts(ts: Column, pattern: str, zone: str = "UTC") -> Column:
    """Text of a UTC instant in ``zone``."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from ``start`` to ``end``."""
    return F.timestamp_diff(unit, start, end)


def shift(ts: Column, n: int | Column, unit: str) -> Column:
    """``ts`` moved by ``n`` units; months keep the day or fall back to the month's end."""
    return F.timestamp_add(unit, F.lit(n) if isinstance(n, int) else n, ts)


def from_epoch(value: Column, unit: str) -> Column:
    """Timestamp of an epoch number in seconds ``s``, milliseconds ``ms`` or ``us``."""
    make = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}
    return make[unit](value)


def to_epoch(ts: Column, unit: str) -> Column:
    make = {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros}
    return make[unit](ts.cast("timestamp"))


def convert_tz(ts: Column, source: str, target: str) -> Column:
    """Wall clock of ``source`` shown as wall clock of ``target``."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def parse_ts(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ssX") -> Column:
    """Timestamp of a text in ``pattern``; NULL when it does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern))


def time_category(ts: Column) -> Column:
    """weekend, business_hours (9 to 17 on weekdays) or after_hours."""
    return (
        F.when(F.dayofweek(ts).isin(1, 7), "weekend")
        .when(F.hour(ts).between(9, 17), "business_hours")
        .otherwise("after_hours")
    )


def season(ts: Column) -> Column:
    """Northern season of the month."""
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("fall")
    )


def is_late_night(ts: Column, literal: bool = False) -> Column:
    """1 from 22:00 to 6:59. ``literal`` keeps BETWEEN 22 AND 6, which is never true."""
    hour = F.hour(ts)
    night = hour.between(22, 6) if literal else (hour >= 22) | (hour <= 6)
    return F.when(night, 1).otherwise(0)


def whole_months(start: Column, end: Column, literal: bool = False) -> Column:
    """Months between two month starts. ``literal`` gives days / 30 instead."""
    if literal:
        return F.datediff(end, start) / F.lit(30)
    return F.round(F.months_between(F.trunc(end, "month"), F.trunc(start, "month"))).cast("int")
