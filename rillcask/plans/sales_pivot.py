"""Monthly sales side by side, growth and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.operators.aggregates import growth_pct, pivot_periods, trend_label
from rillcask.operators.ordered import Limit, ranked
from rillcask.operators.rows import label_rules
from rillcask.operators.skew import hot_in, settled


def pivoted_sales(sales: DataFrame, as_of: str) -> DataFrame:
    """Revenue and transactions of chosen months before ``as_of`` per category and region."""
    amount, one = F.col("sale_amount"), F.lit(1)
    return pivot_periods(sales, ["product_category", "region"], "sale_date", as_of, {
        "last_month_revenue": ([1], amount),
        "two_months_ago_revenue": ([2], amount),
        "three_months_ago_revenue": ([3], amount),
        "last_month_transactions": ([1], one),
        "two_months_ago_transactions": ([2], one),
        "current_quarter_revenue": ([1, 2, 3], amount),
        "previous_quarter_revenue": ([4, 5, 6], amount),
        "same_month_last_year_revenue": ([12], amount),
    })


def sales_pivot(sales: DataFrame, as_of: str, hot: Limit = None) -> DataFrame:
    """Growth, trend and rank of categories and regions with sales last month."""
    # the base table keeps sales from the same day a year ago, so that month is partial
    start = F.add_months(F.lit(as_of).cast("date"), -12).cast("timestamp_ntz")
    # few rows, made once: they are ranked and counted from here
    rows, n = settled(pivoted_sales(sales.where(F.col("sale_date") >= start), as_of))
    last, two, three = (
        F.col(f"{n}_revenue") for n in ("last_month", "two_months_ago", "three_months_ago")
    )
    rows = rows.withColumns({
        "mom_growth_percent": growth_pct(last, two),
        "qoq_growth_percent": growth_pct(
            F.col("current_quarter_revenue"), F.col("previous_quarter_revenue")
        ),
        "yoy_growth_percent": growth_pct(last, F.col("same_month_last_year_revenue")),
        "revenue_trend": trend_label(last, two, three),
    })
    category, value = ["product_category"], "last_month_revenue"
    counted = hot_in(n, rows, category, hot)
    rows = ranked(
        rows, category, value, descending=True, rank="revenue_rank_in_category", hot=counted
    )
    rows = ranked(rows, category, value, percent="__percentile", hot=counted)
    mom = F.col("mom_growth_percent")
    return rows.where(last > 0).select(
        "product_category", "region", "last_month_revenue",
        F.round(mom, 2).alias("mom_growth_percent"),
        F.round("qoq_growth_percent", 2).alias("qoq_growth_percent"),
        F.round("yoy_growth_percent", 2).alias("yoy_growth_percent"),
        "revenue_trend", "revenue_rank_in_category",
        F.round(F.col("__percentile") * 100, 1).alias("revenue_percentile_in_category"),
        label_rules([
            (mom > 10, "high_growth"), (mom > 0, "positive_growth"),
            (mom > -10, "slight_decline"),
        ], "significant_decline").alias("performance_indicator"),
    ).orderBy("product_category", F.col("last_month_revenue").desc())
