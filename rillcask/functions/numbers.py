"""Numeric, currency and distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least_one(rows: int) -> int:
    """A row count as asked for by a caller; anything below 1 is a mistake."""
    if rows < 1:
        raise ValueError(f"cannot return {rows} rows: ask for 1 or more")
    return rows

# US dollars per unit of a currency; any other currency counts as dollars.
USD_RATES = {"EUR": 1.1, "GBP": 1.25, "JPY": 0.0075}

EARTH_RADIUS = {"km": 6371.0, "miles": 3959.0}


def safe_ratio(
    top: Column, bottom: Column, scale: float = 1, else_: float | None = 0
) -> Column:
    """``top * scale / bottom`` where the bottom is positive, otherwise ``else_``."""
    return F.when(bottom > 0, top * scale / bottom).otherwise(F.lit(else_))


def log10_plus_one(value: Column) -> Column:
    return F.log10(value + 1)


def square_root(value: Column) -> Column:
    return F.sqrt(value)


def power(value: Column, exponent: float) -> Column:
    return F.pow(value, F.lit(exponent))


def to_usd(amount: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    out = None
    for code, rate in (rates or USD_RATES).items():
        hit = currency == code
        out = F.when(hit, amount * rate) if out is None else out.when(hit, amount * rate)
    return out.otherwise(amount)


def geo_distance(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km"
) -> Column:
    """Great-circle distance by the haversine formula."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), 2
    )
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS[unit])
