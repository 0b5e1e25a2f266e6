"""Windowed traffic indicators with a spike flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.functions.numbers import safe_ratio
from rillcask.operators.aggregates import (
    avg_where, count_where, distinct_count, max_where, sum_where,
)
from rillcask.operators.ordered import Limit, anomaly_flag
from rillcask.operators.skew import hot_in, same, settled
from rillcask.streaming.windows import tumbling

GROUPS = ["user_segment", "event_type", "source_system"]
# Names of the anomaly classes.
LABELS = ("HIGH_TRAFFIC_SPIKE", "LOW_TRAFFIC_DROP", "NORMAL")


def window_kpis(
    events: DataFrame, size: str = "5 minutes", ts: str = "event_timestamp", approx: bool = False
) -> DataFrame:
    """Indicators per window and group. ``approx`` allows streams and very wide tables.

    Exact distinct counts copy every row once per counted column. They are aggregated on
    their own, so these copies carry no sums and no percentile summaries, and joined to
    the other indicators per window and group.
    """
    kind, device, traffic = F.col("event_type"), F.col("device_type"), F.col("traffic_source")
    revenue, latency = F.col("revenue_amount"), F.col("response_time_ms")
    bought = kind == "purchase"
    aggs = {
        "event_count": F.count(F.lit(1)),
        "total_revenue": sum_where(bought, revenue),
        "avg_purchase_amount": avg_where(bought, revenue),
        "max_purchase_amount": max_where(bought, revenue),
        "page_views": count_where(kind == "page_view"),
        "add_to_cart_events": count_where(kind == "add_to_cart"),
        "purchase_events": count_where(bought),
        "error_count": count_where(F.col("status_code") >= 400),
        "avg_response_time": F.avg(latency),
        "__latency": F.percentile_approx(latency, [0.5, 0.95, 0.99]),
        "mobile_events": count_where(device == "mobile"),
        "desktop_events": count_where(device == "desktop"),
        "tablet_events": count_where(device == "tablet"),
        "organic_traffic": count_where(traffic == "organic"),
        "paid_traffic": count_where(traffic == "paid"),
        "social_traffic": count_where(traffic == "social"),
    }
    distinct = {
        "unique_users": distinct_count("user_id", approx),
        "unique_sessions": distinct_count("session_id", approx),
        "unique_countries": distinct_count("geo_country", approx),
        "unique_cities": distinct_count("geo_city", approx),
        "unique_traffic_sources": distinct_count("traffic_source", approx),
    }
    if approx:
        out = tumbling(events, ts, size, GROUPS, {**aggs, **distinct})
    else:
        keys = ["window_start", "window_end", *GROUPS]
        counts = tumbling(events, ts, size, GROUPS, distinct).select(
            *[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *distinct
        )
        out = tumbling(events, ts, size, GROUPS, aggs)
        out = out.join(counts, same(out, keys, "__j")).drop(
            *[f"__j{i}" for i in range(len(keys))]
        )
    views, carts = F.col("page_views"), F.col("add_to_cart_events")
    return out.withColumns({
        "page_to_cart_conversion_rate": safe_ratio(carts, views, 100, 0.0),
        "cart_to_purchase_conversion_rate": safe_ratio(F.col("purchase_events"), carts, 100, 0.0),
        "error_rate_percent": safe_ratio(F.col("error_count"), F.col("event_count"), 100, 0.0),
        "median_response_time": F.col("__latency")[0],
        "p95_response_time": F.col("__latency")[1],
        "p99_response_time": F.col("__latency")[2],
        "window_hour": F.hour("window_start"),
        "window_day_of_week": F.dayofweek("window_start"),
    }).drop("__latency")


def traffic_kpis(
    events: DataFrame, size: str = "5 minutes", ts: str = "event_timestamp",
    approx: bool = False, hot: Limit = None, as_of: str | None = None, hours: int = 24,
) -> DataFrame:
    """``window_kpis`` with a flag that compares a group with its own last 11 windows.

    Several groups share a window, so a frame ordered by window alone has no fixed
    order; per group it has one and needs no whole-table sort. The indicators are made once,
    and the windows of a group are counted on them. ``as_of`` keeps the ``hours`` before it.
    """
    if as_of is not None:
        events = events.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(
            f"INTERVAL '{hours}' HOUR"
        ))
    kpis, n = settled(window_kpis(events, size, ts, approx))
    return with_spikes(kpis, hot_in(n, kpis, GROUPS, hot))


def with_spikes(kpis: DataFrame, hot: Limit = None) -> DataFrame:
    """Indicators, as made by ``window_kpis`` on a table or kept by a stream, with the flag."""
    return anomaly_flag(
        kpis, GROUPS, ["window_start"], "event_count", 11, 2, 0.5,
        "traffic_anomaly_indicator", LABELS, hot,
    )
