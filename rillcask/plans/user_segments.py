"""New, churned, retained and reactivated users, and cohorts by registration month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.operators.aggregates import cohort_by_month, pct_of_total, segment_summary
from rillcask.operators.joins import anti, flag_in, not_in, retained, semi
from rillcask.operators.rows import between_ago, recent
from rillcask.operators.skew import pinned

COLUMNS = ["user_id", "email", "registration_date", "last_activity_date"]


def user_groups(
    acts: DataFrame, as_of: str, near: int = 30, middle: int = 60, far: int = 90
) -> dict[str, DataFrame]:
    """Users by activity ``near``, ``middle`` and ``far`` days back.

    Churned users are those active far to near days ago and not since, compared by user.
    A row-wise EXCEPT over the activity date could never remove a row, since the two
    periods do not share a date.
    """
    day = "last_activity_date"
    acts = acts.select(*COLUMNS).distinct()
    current = recent(acts, day, as_of, near).select(*COLUMNS).distinct()
    past = between_ago(acts, day, as_of, far, near).select(*COLUMNS).distinct()
    older = acts.where(F.col(day) < F.lit(as_of).cast("timestamp_ntz") - F.expr(
        f"INTERVAL '{middle}' DAY"
    ))
    between = acts.where(F.col(day).between(
        F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{middle}' DAY"),
        F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{near}' DAY"),
    ))
    dormant = not_in(older.select("user_id").distinct(), between, "user_id")
    return {
        "current": current,
        "new_users": recent(current, "registration_date", as_of, near),
        "churned_users": anti(past, current, ["user_id"]),
        "retained_users": retained(past, current, "user_id"),
        "reactivated_users": semi(current, dormant, "user_id"),
    }


def user_segments(
    acts: DataFrame, as_of: str, near: int = 30, middle: int = 60, far: int = 90,
    months: int = 12,
) -> DataFrame:
    """Size, age and share of each segment, then the retention of each cohort."""
    # the activity table is read once; every segment and cohort uses its distinct narrow rows
    acts = pinned(acts.select(*COLUMNS).distinct())
    groups = user_groups(acts, as_of, near, middle, far)
    current = groups.pop("current")
    segments = pct_of_total(
        segment_summary(groups, "registration_date", as_of), "user_count", "__share"
    ).select(
        "segment_type", "user_count",
        F.round("avg_days_since_registration", 1).alias("avg_days_since_registration"),
        F.round("__share", 2).alias("percentage_of_total"),
    )
    since = F.add_months(F.lit(as_of).cast("date"), -months).cast("timestamp_ntz")
    users = acts.where(F.col("registration_date") >= since).select(
        "user_id", "registration_date"
    ).distinct()
    cohorts = cohort_by_month(
        flag_in(users, current, "user_id", "is_active"), "user_id", "registration_date",
        "is_active",
    ).where("retention_rate is not null").select(
        F.concat(F.lit("cohort_"), "registration_month").alias("segment_type"),
        F.col("active_users").alias("user_count"),
        F.lit(None).cast("double").alias("avg_days_since_registration"),
        F.col("retention_rate").alias("percentage_of_total"),
    )
    return segments.unionByName(cohorts).orderBy("segment_type")
