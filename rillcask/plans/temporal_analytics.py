"""Hourly peaks, seasonality and growth of a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillcask.functions.numbers import safe_ratio
from rillcask.functions.times import date_parts, season, time_category, trunc_to
from rillcask.operators.aggregates import (
    avg_where, coefficient_of_variation, count_where, sum_where,
)
from rillcask.operators.joins import vs_global
from rillcask.operators.ordered import growth
from rillcask.operators.rows import recent

TS = "event_timestamp"


def time_series_base(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Events with calendar parts, period starts, time category and season."""
    ts = F.col(TS)
    return recent(events, TS, as_of, days).withColumns({
        **date_parts(ts),
        **{f"{u}_bucket": trunc_to(ts, u) for u in ("hour", "day", "week", "month")},
        "time_category": time_category(ts),
        "season": season(ts),
    })


def hourly_patterns(base: DataFrame, view: str = "page_view") -> DataFrame:
    """Activity per hour and weekday, ranked. At most 24 x 7 x 3 rows reach the windows."""
    kind, amount = F.col("event_type"), F.col("revenue_amount")
    bought = kind == "purchase"
    rows = base.groupBy("event_hour", "day_of_week", "time_category").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("user_id").alias("unique_users"),
        sum_where(bought, amount).alias("hourly_revenue"),
        avg_where(bought, amount).alias("avg_purchase_amount"),
        count_where(kind == view).alias("page_views"),
        count_where(bought).alias("purchases"),
    )
    by_day = Window.partitionBy("day_of_week").orderBy(F.desc("event_count"))
    return rows.withColumns({
        "conversion_rate": safe_ratio(F.col("purchases"), F.col("page_views"), 100, 0.0),
        "hourly_rank_by_day": F.rank().over(by_day),
        "activity_percentile": F.percent_rank().over(Window.orderBy("event_count")),
    })


def daily_trends(base: DataFrame) -> DataFrame:
    """Daily totals with 7-row means and growth. One row per day reaches the windows."""
    rows = base.groupBy("event_date", "day_of_week", "season", "event_month").agg(
        F.count(F.lit(1)).alias("daily_events"),
        F.count_distinct("user_id").alias("daily_active_users"),
        sum_where(F.col("event_type") == "purchase", F.col("revenue_amount")).alias(
            "daily_revenue"
        ),
    )
    days = Window.orderBy("event_date")
    week = days.rowsBetween(-6, 0)
    events = F.col("daily_events")
    return rows.withColumns({
        "rolling_7day_avg_events": F.avg("daily_events").over(week),
        "rolling_7day_avg_revenue": F.avg("daily_revenue").over(week),
        "prev_day_events": F.lag("daily_events", 1).over(days),
        "same_day_last_week_events": F.lag("daily_events", 7).over(days),
        "prev_day_revenue": F.lag("daily_revenue", 1).over(days),
        "day_over_day_growth": growth(events, F.lag("daily_events", 1).over(days)),
        "week_over_week_growth": growth(events, F.lag("daily_events", 7).over(days)),
    })


def seasonality(daily: DataFrame) -> DataFrame:
    """Mean, spread and seasonal index of the days of each month."""
    rows = daily.groupBy("season", "event_month").agg(
        F.avg("daily_events").alias("avg_daily_events"),
        F.avg("daily_revenue").alias("avg_daily_revenue"),
        F.stddev_samp("daily_events").alias("stddev_daily_events"),
        F.stddev_samp("daily_revenue").alias("stddev_daily_revenue"),
        coefficient_of_variation("daily_events").alias("events_coefficient_of_variation"),
    )
    rows = vs_global(rows, {
        "__events": F.avg("daily_events"),
        "__revenue": F.avg(F.when(F.col("daily_revenue") > 0, F.col("daily_revenue"))),
    }, daily)
    return rows.withColumns({
        "seasonal_index_events": F.col("avg_daily_events") / F.col("__events"),
        "seasonal_index_revenue": F.col("avg_daily_revenue") / F.nullif(
            F.col("__revenue"), F.lit(0)
        ),
    }).drop("__events", "__revenue")


def temporal_analytics(
    events: DataFrame, as_of: str, days: int = 90, view: str = "page_view"
) -> DataFrame:
    """Peak weekday hours, index per season and mean weekly growth in one report."""
    base = time_series_base(events, as_of, days)
    daily = daily_trends(base)
    hours = hourly_patterns(base, view).where(F.col("day_of_week").between(2, 6)).groupBy(
        "event_hour"
    ).agg(F.max("event_count").alias("top"))
    peaks = vs_global(hours, {"__all": F.max("top")}).where("top = __all").select(
        F.lit("hourly_peak_analysis").alias("analysis_type"),
        F.col("event_hour").cast("string").alias("time_dimension"),
        F.col("top").cast("string").alias("metric_value"),
        F.lit("Peak hour activity").alias("description"),
    )
    seasons = seasonality(daily).groupBy("season").agg(
        F.round(F.avg("seasonal_index_events"), 3).cast("string").alias("metric_value")
    ).select(
        F.lit("seasonality_analysis").alias("analysis_type"),
        F.col("season").alias("time_dimension"), "metric_value",
        F.lit("Seasonal activity index").alias("description"),
    )
    trend = daily.where("week_over_week_growth is not null").agg(
        F.round(F.avg("week_over_week_growth"), 2).cast("string").alias("metric_value")
    ).select(
        F.lit("growth_trends").alias("analysis_type"),
        F.lit("week_over_week").alias("time_dimension"), "metric_value",
        F.lit("Average weekly growth rate").alias("description"),
    )
    return peaks.unionByName(seasons).unionByName(trend).orderBy(
        "analysis_type", "time_dimension"
    )
