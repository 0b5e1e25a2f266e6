"""Grouped aggregates. Spark combines all of them map-side, so hot keys stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcask.functions.numbers import safe_ratio
from rillcask.operators.joins import vs_global
from rillcask.operators.ordered import growth
from rillcask.operators.rows import ago, label_rules


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(
    df: DataFrame, keys: list[str], name: str = "n", column: str | None = None
) -> DataFrame:
    """Rows per key, or non-null values of ``column`` per key."""
    return df.groupBy(*keys).agg(F.count(column or F.lit(1)).alias(name))


def sum_by(df: DataFrame, keys: list[str], column: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias(name))


def minmax_by(
    df: DataFrame, keys: list[str], column: str, low: str = "min", high: str = "max"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias(low), F.max(column).alias(high))


def int_average(column: str) -> Column:
    """Aggregate: whole-number quotient of sum and count; NULL without values."""
    return F.expr(f"sum(`{column}`) div nullif(count(`{column}`), 0)")


def int_avg(df: DataFrame, keys: list[str], column: str, name: str = "avg") -> DataFrame:
    return df.groupBy(*keys).agg(int_average(column).alias(name))


def aggregate(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])


def distinct_count(column: str, approx: bool = False) -> Column:
    """Exact, or a sketch where exact counting is refused (streams) or too wide."""
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def avg_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def max_where(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def cond_agg(
    df: DataFrame, keys: list[str], specs: dict[str, tuple[str, Column, Column | None]]
) -> DataFrame:
    """Conditional aggregates: name -> (count | sum | avg | max, condition, value)."""
    make = {"sum": sum_where, "avg": avg_where, "max": max_where}
    aggs = {
        name: count_where(cond) if fn == "count" else make[fn](cond, value)
        for name, (fn, cond, value) in specs.items()
    }
    return aggregate(df, keys, aggs)


def funnel_rates(
    df: DataFrame, keys: list[str], column: str, steps: list[str], scale: int = 100
) -> DataFrame:
    """Count of each step and the rate from each step to the next; 0 without a base."""
    counts = {f"{s}_count": count_where(F.col(column) == s) for s in steps}
    out = aggregate(df, keys, counts)
    return out.withColumns({
        f"{a}_to_{b}_rate": safe_ratio(F.col(f"{b}_count"), F.col(f"{a}_count"), scale, 0.0)
        for a, b in zip(steps, steps[1:])
    })


def error_rate(
    df: DataFrame, keys: list[str], condition: Column, scale: int = 100
) -> DataFrame:
    out = aggregate(
        df, keys, {"error_count": count_where(condition), "event_count": F.count(F.lit(1))}
    )
    return out.withColumn(
        "error_rate", safe_ratio(F.col("error_count"), F.col("event_count"), scale, 0.0)
    )


def percentiles(
    df: DataFrame, keys: list[str], column: str, ps: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Approximate percentiles from one mergeable summary per group."""
    summary = F.percentile_approx(column, list(ps.values()), accuracy)
    out = df.groupBy(*keys).agg(summary.alias("__p"))
    return out.select(*keys, *[F.col("__p")[i].alias(n) for i, n in enumerate(ps)])


def month_start(as_of: str, back: int) -> Column:
    return F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -back)


def pivot_periods(
    df: DataFrame, keys: list[str], ts: str, as_of: str,
    periods: dict[str, tuple[list[int], Column]],
) -> DataFrame:
    """Sums over chosen months counted back from ``as_of``: name -> (months back, value).

    Rows before the earliest month are filtered out, so old partitions are not read.
    """
    earliest = max(m for back, _ in periods.values() for m in back)
    rows = df.where(F.col(ts) >= month_start(as_of, earliest).cast("timestamp_ntz"))
    month = F.trunc(F.col(ts), "month")
    aggs = {
        name: sum_where(month.isin(*[month_start(as_of, m) for m in back]), value)
        for name, (back, value) in periods.items()
    }
    return aggregate(rows, keys, aggs)


def growth_pct(current: Column, base: Column) -> Column:
    return growth(current, base)


def trend_label(last: Column, middle: Column, first: Column) -> Column:
    """upward_trend, downward_trend or mixed_trend over three consecutive periods."""
    return label_rules([
        ((last > middle) & (middle > first), "upward_trend"),
        ((last < middle) & (middle < first), "downward_trend"),
    ], "mixed_trend")


def peak_groups(
    df: DataFrame, keys: list[str], metric: Column, name: str = "peak"
) -> DataFrame:
    """Groups whose metric equals the largest metric of all groups."""
    groups = aggregate(df, keys, {name: metric})
    return vs_global(groups, {"__top": F.max(name)}).where(F.col(name) == F.col("__top")).drop(
        "__top"
    )


def session_facts(
    df: DataFrame, user: str, session: str, ts: str, page: str, kind: str,
    purchase: str = "purchase",
) -> DataFrame:
    """Start, end, events, distinct pages and purchases of each session."""
    return aggregate(df, [user, session], {
        "session_start": F.min(ts),
        "session_end": F.max(ts),
        "total_events": F.count(F.lit(1)),
        "unique_pages_visited": F.count_distinct(page),
        "purchases_in_session": count_where(F.col(kind) == purchase),
    })


def coefficient_of_variation(column: str, scale: int = 100) -> Column:
    """Aggregate: deviation in percent of a positive mean, otherwise NULL."""
    return F.when(F.avg(column) > 0, F.stddev_samp(column) / F.avg(column) * scale)


def coef_var(df: DataFrame, keys: list[str], column: str, name: str = "cv") -> DataFrame:
    return df.groupBy(*keys).agg(coefficient_of_variation(column).alias(name))


def seasonal_index(
    df: DataFrame, keys: list[str], column: str, name: str = "seasonal_index"
) -> DataFrame:
    """Mean of the group divided by the mean of all rows."""
    means = df.groupBy(*keys).agg(F.avg(column).alias("__mean"))
    out = vs_global(means, {"__all": F.avg(column)}, df)
    return out.withColumn(
        name, F.when(F.col("__all") != 0, F.col("__mean") / F.col("__all"))
    ).drop("__mean", "__all")


def cohort_by_month(
    users: DataFrame, user: str, registered: str, active: str
) -> DataFrame:
    """Registered and active users per month of registration, with the retention rate."""
    out = users.groupBy(F.date_format(registered, "yyyy-MM").alias("registration_month")).agg(
        F.count_distinct(F.when(F.col(active), F.col(user))).alias("active_users"),
        F.count_distinct(user).alias("total_registered_users"),
    )
    rate = F.col("active_users") * 100 / F.col("total_registered_users")
    return out.withColumn("retention_rate", F.round(rate, 2))


def cohort_retention(
    df: DataFrame, user: str, ts: str, unit: str = "month", literal: bool = False
) -> DataFrame:
    """Users of each first-activity cohort who are active n periods later.

    First activity per user is an aggregate joined back on distinct (user, period) rows,
    not a window over all rows of a user. ``literal`` numbers months as days / 30.
    """
    seen = df.select(user, F.date_trunc(unit, ts).alias("__at")).distinct()
    first = seen.groupBy(F.col(user).alias("__u")).agg(F.min("__at").alias("cohort"))
    days = F.datediff("__at", "cohort")
    if unit == "month" and not literal:
        period = F.round(F.months_between("__at", "cohort")).cast("int")
    elif unit == "month":
        period = days / F.lit(30)
    else:
        period = F.floor(days / F.lit({"day": 1, "week": 7}[unit])).cast("int")
    counts = (
        seen.join(first, F.col(user) == F.col("__u"))
        .groupBy("cohort", period.alias("period_number"))
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    sizes = counts.groupBy(F.col("cohort").alias("__c")).agg(
        F.min_by("active_users", "period_number").alias("cohort_size")
    )
    out = counts.join(sizes, F.col("cohort") == F.col("__c")).drop("__c")
    rate = F.col("active_users") * 100 / F.col("cohort_size")
    return out.withColumn("retention_rate", F.round(rate, 2))


def adoption(
    usage: DataFrame, acts: DataFrame, active: DataFrame, feature: str, used: str, user: str
) -> DataFrame:
    """Users per feature who used it lately, against all active users.

    The count of active users is one number, so nothing is crossed with them. Without
    any active user there is no row, as a product with an empty side would give.
    """
    adopters = usage.select(feature, user).distinct().join(
        acts.select(F.col(user).alias("__u"), F.col(used).alias("__f")).distinct(),
        (F.col(user) == F.col("__u")) & (F.col(feature) == F.col("__f")), "left",
    ).groupBy(feature).agg(F.count_distinct("__u").alias("adopters"))
    out = vs_global(adopters, {"total_active_users": F.count_distinct(user)}, active)
    rate = F.col("adopters") * 100 / F.nullif(F.col("total_active_users"), F.lit(0))
    return out.where(F.col("total_active_users") > 0).withColumn(
        "adoption_rate", F.round(rate, 2)
    )


def segment_summary(
    segments: dict[str, DataFrame], registered: str, as_of: str, weight: str = "matches"
) -> DataFrame:
    """Rows and mean days since registration per segment; ``weight`` counts a row often."""
    out = None
    for label, df in segments.items():
        times = F.col(weight) if weight in df.columns else F.lit(1)
        age = F.datediff(F.lit(as_of).cast("date"), registered)
        row = df.agg(
            F.coalesce(F.sum(times), F.lit(0)).cast("long").alias("user_count"),
            (F.sum(age * times) / F.nullif(F.sum(F.when(age.isNotNull(), times)), F.lit(0)))
            .cast("double").alias("avg_days_since_registration"),
        ).select(F.lit(label).alias("segment_type"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def pct_of_total(df: DataFrame, column: str, name: str = "pct_of_total") -> DataFrame:
    """Share of the grand total in percent, without a whole-table window."""
    out = vs_global(df, {"__total": F.sum(column)})
    share = F.col(column) * 100 / F.nullif(F.col("__total"), F.lit(0))
    return out.withColumn(name, share).drop("__total")


def purchase_history(
    df: DataFrame, key: str, amount: str, day: str, as_of: str, days: int
) -> DataFrame:
    """Number, sum, mean, first and last date of purchases within ``days`` of ``as_of``."""
    return aggregate(df.where(F.col(day) >= ago(as_of, days)), [key], {
        "total_purchases": F.count(F.lit(1)),
        "total_spent": F.sum(amount),
        "avg_purchase_amount": F.avg(amount),
        "last_purchase_date": F.max(day),
        "first_purchase_date": F.min(day),
    })


def recency_counts(days: str, recent: int = 7, risk: int = 30) -> dict[str, Column]:
    """Aggregates: rows with at most ``recent`` and with more than ``risk`` days."""
    return {
        "recent_purchasers": count_where(F.col(days) <= recent),
        "at_risk_customers": count_where(F.col(days) > risk),
    }
