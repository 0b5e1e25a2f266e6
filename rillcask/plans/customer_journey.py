"""Sessions, profiles and purchases rolled up to customer segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.operators.aggregates import purchase_history, recency_counts, session_facts
from rillcask.operators.joins import enrich_many
from rillcask.operators.rows import label_rules, recent


def registration_segment(registered: str, as_of: str):
    """new within 30 days, regular within 365, else veteran."""
    age = F.datediff(F.lit(as_of).cast("date"), registered)
    return label_rules([(age <= 30, "new"), (age <= 365, "regular")], "veteran")


def customer_metrics(
    web_events: DataFrame, profiles: DataFrame, purchases: DataFrame, as_of: str
) -> DataFrame:
    """One row per customer with a session in the last 7 days.

    Sessions are reduced to customers before the look-ups, so the joins see one row per
    customer on every side.
    """
    sessions = session_facts(
        recent(web_events, "event_timestamp", as_of, 7), "customer_id", "session_id",
        "event_timestamp", "page_url", "event_type",
    )
    customers = sessions.groupBy("customer_id").agg(
        F.count_distinct("session_id").alias("total_sessions"),
        F.avg("total_events").alias("avg_events_per_session"),
        F.sum("purchases_in_session").alias("total_web_purchases"),
    )
    segments = profiles.select(
        F.col("customer_id").alias("p_id"), "membership_tier", "location",
        registration_segment("registration_date", as_of).alias("customer_segment"),
    )
    history = purchase_history(
        purchases, "customer_id", "amount", "purchase_date", as_of, 90
    ).withColumnRenamed("customer_id", "h_id")
    joined = enrich_many(customers, [
        (segments, [("customer_id", "p_id")]), (history, [("customer_id", "h_id")]),
    ])
    return joined.select(
        "customer_id", "customer_segment", "membership_tier", "location", "total_sessions",
        "avg_events_per_session", "total_web_purchases",
        F.coalesce("total_purchases", F.lit(0)).alias("total_purchases"),
        F.coalesce("total_spent", F.lit(0)).alias("total_spent"),
        F.coalesce("avg_purchase_amount", F.lit(0)).alias("avg_purchase_amount"),
        F.datediff(F.lit(as_of).cast("date"), "last_purchase_date").alias(
            "days_since_last_purchase"
        ),
    )


def customer_journey(
    web_events: DataFrame, profiles: DataFrame, purchases: DataFrame, as_of: str
) -> DataFrame:
    """Customers, activity, spending and recency per segment, tier and location."""
    return (
        customer_metrics(web_events, profiles, purchases, as_of)
        .groupBy("customer_segment", "membership_tier", "location")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.avg("total_sessions").alias("avg_sessions"),
            F.avg("avg_events_per_session").alias("avg_events_per_session"),
            F.avg("total_spent").alias("avg_total_spent"),
            F.percentile_approx("total_spent", 0.5).alias("median_total_spent"),
            *[c.alias(n) for n, c in recency_counts("days_since_last_purchase").items()],
        )
        .orderBy("customer_segment", "membership_tier", "location")
    )
