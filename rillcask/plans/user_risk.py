"""Fraud features per transaction and a risk profile per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from rillcask.functions.numbers import log10_plus_one, power, safe_ratio, square_root, to_usd
from rillcask.functions.strings import json_fields
from rillcask.functions.times import is_late_night
from rillcask.operators.aggregates import count_where
from rillcask.operators.ordered import (
    Limit, encode_category, outlier_flag, ranked, tiled, windowed,
)
from rillcask.operators.rows import bucketize, label_rules, recent
from rillcask.operators.skew import Hot, find_hot

TS, ID = "transaction_timestamp", "transaction_id"

# Upper limits of the amount buckets in dollars.
AMOUNT_BUCKETS = [(10, "micro"), (100, "small"), (1000, "medium"), (10000, "large")]


METADATA = (
    "device struct<fingerprint: string>, location struct<ip_address: string>, "
    "risk_scores struct<fraud_score: string>, tags string"
)


def enriched(
    transactions: DataFrame, as_of: str, days: int = 30, ranks: bool = True,
    hot: Limit = None,
) -> DataFrame:
    """Parsed metadata, dollars, risk class and amount transforms of recent rows."""
    meta, amount = F.col("__meta"), F.col("amount")
    score = meta["risk_scores"]["fraud_score"].try_cast("double")
    parsed = json_fields(F.col("transaction_metadata"), METADATA)
    rows = recent(transactions, TS, as_of, days).withColumn("__meta", parsed).withColumns({
        "device_fingerprint": meta["device"]["fingerprint"],
        "ip_address": meta["location"]["ip_address"],
        "fraud_score": meta["risk_scores"]["fraud_score"],
        "clean_merchant_category": F.regexp_replace("merchant_category", "[^a-zA-Z0-9]", "_"),
        "transaction_tags": F.split(meta["tags"], ","),
        "unix_timestamp": F.unix_timestamp(TS),
        "formatted_timestamp": F.date_format(TS, "yyyy-MM-dd HH:mm:ss"),
        "week_number": F.weekofyear(TS),
        "amount_usd": to_usd(amount, F.col("currency")),
        "risk_category": label_rules(
            [(score > 0.8, "high_risk"), (score > 0.5, "medium_risk")], "low_risk"
        ),
        "log_amount": log10_plus_one(amount),
        "sqrt_amount": square_root(amount),
        "power_transform": power(amount, 0.5),
    }).drop("__meta")
    if not ranks:
        return rows
    tile_limit = hot.limit if isinstance(hot, Hot) else hot
    rows = tiled(rows, ["merchant_category"], ["amount", ID], 10, "amount_decile", tile_limit)
    return ranked(rows, ["user_id"], TS, percent="user_transaction_percentile", hot=hot)


def fraud_features(
    transactions: DataFrame, as_of: str, days: int = 30, literal_night: bool = False,
    ranks: bool = True, hot: Limit = None,
) -> DataFrame:
    """Rolling behaviour, gaps, z-score and flags per transaction.

    All per-user frames share one partitioning and order, so Spark sorts the rows once.
    """
    hot = find_hot(recent(transactions, TS, as_of, days), ["user_id"], hot)
    rows = enriched(transactions, as_of, days, ranks, hot).withColumns({
        "is_late_night": is_late_night(F.col(TS), literal_night),
        "is_weekend": F.when(F.dayofweek(TS).isin(1, 7), 1).otherwise(0),
    })
    amount, merchant = F.col("amount_usd"), "clean_merchant_category"

    def last7(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(-6, 0)

    def last30(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(-29, 0)

    rows = windowed(rows, ["user_id"], [TS, ID], {
        "transactions_last_7": lambda w: F.count(F.lit(1)).over(last7(w)),
        "spending_last_7": lambda w: F.sum("amount_usd").over(last7(w)),
        "avg_spending_30d": lambda w: F.avg("amount_usd").over(last30(w)),
        "stddev_spending_30d": lambda w: F.stddev_samp("amount_usd").over(last30(w)),
        "unique_merchants_30d": lambda w: F.size(F.collect_set(merchant).over(last30(w))),
        "late_night_transactions_30d": lambda w: F.sum("is_late_night").over(last30(w)),
        "__previous": lambda w: F.lag(TS).over(w),
    }, reach=29, hot=hot)
    sd = F.col("stddev_spending_30d")
    rows = rows.withColumns({
        "days_since_last_transaction": F.datediff(TS, "__previous"),
        "hours_since_last_transaction": (
            F.unix_timestamp(TS) - F.unix_timestamp("__previous")
        ) / F.lit(3600.0),
        "amount_zscore": F.when(
            sd > 0, (amount - F.col("avg_spending_30d")) / sd
        ).otherwise(0.0),
    }).drop("__previous")
    rows = encode_category(rows, merchant, "merchant_category_encoded", hot.limit)
    return outlier_flag(rows, [merchant], "amount_usd", 3, "is_large_amount")


def risk_features(features: DataFrame) -> DataFrame:
    """Interactions, buckets, combined risk classes and the rapid-spending flag."""
    amount, mean = F.col("amount_usd"), F.col("avg_spending_30d")
    days, risk = F.col("days_since_last_transaction"), F.col("risk_category")
    hours = F.col("hours_since_last_transaction")
    return features.withColumns({
        "amount_velocity_interaction": amount * F.col("transactions_last_7"),
        "amount_per_day_gap": safe_ratio(amount, days, 1, 0.0),
        "amount_bucket": bucketize(amount, AMOUNT_BUCKETS, "very_large"),
        # The names of the classes here and below.
        "composite_risk_category": label_rules([
            ((risk == "high_risk") & (F.col("is_late_night") == 1), "high_risk_night"),
            ((risk == "high_risk") & (F.col("is_weekend") == 1), "high_risk_weekend"),
            ((risk == "medium_risk") & (F.col("is_large_amount") == 1), "medium_risk_large"),
        ], F.concat(risk, F.lit("_normal"))),
        "amount_to_avg_ratio": safe_ratio(amount, mean, 1, 0.0),
        "amount_deviation_score": F.when(
            F.col("stddev_spending_30d") > 0, F.abs("amount_zscore")
        ).otherwise(0.0),
        "rapid_high_spending_flag": F.when((hours < 1) & (amount > mean * 2), 1).otherwise(0),
    })


def user_risk(
    transactions: DataFrame, as_of: str, days: int = 30, literal_night: bool = False,
    min_transactions: int = 5, hot: Limit = None,
) -> DataFrame:
    """Spending, anomaly and behaviour profile of users with enough transactions."""
    rows = risk_features(
        fraud_features(transactions, as_of, days, literal_night, ranks=False, hot=hot)
    )
    users = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("amount_usd").alias("total_spending"),
        F.avg("amount_usd").alias("avg_transaction_amount"),
        F.stddev_samp("amount_usd").alias("spending_volatility"),
        count_where(F.col("risk_category") == "high_risk").alias("high_risk_transactions"),
        F.avg("amount_deviation_score").alias("avg_anomaly_score"),
        F.max("amount_deviation_score").alias("max_anomaly_score"),
        F.avg("rapid_high_spending_flag").alias("rapid_spending_rate"),
        F.count_distinct("amount_bucket").alias("spending_diversity"),
        F.count_distinct("composite_risk_category").alias("risk_pattern_diversity"),
        F.avg("late_night_transactions_30d").alias("avg_late_night_activity"),
        F.stddev_samp("days_since_last_transaction").alias("transaction_timing_variance"),
    ).where(F.col("total_transactions") >= min_transactions)
    c = F.col
    return users.select(
        "user_id", "total_transactions",
        F.round("total_spending", 2).alias("total_spending"),
        F.round("avg_transaction_amount", 2).alias("avg_transaction_amount"),
        F.round("spending_volatility", 2).alias("spending_volatility"),
        "high_risk_transactions",
        F.round("avg_anomaly_score", 3).alias("avg_anomaly_score"),
        F.round("rapid_spending_rate", 3).alias("rapid_spending_rate"),
        "spending_diversity", "risk_pattern_diversity",
        label_rules([
            ((c("high_risk_transactions") > c("total_transactions") * 0.3)
             & (c("avg_anomaly_score") > 1.5), "user_high_risk"),
            ((c("rapid_spending_rate") > 0.1)
             & (c("spending_volatility") > c("avg_transaction_amount")), "user_medium_risk"),
        ], "user_low_risk").alias("final_user_risk_category"),
        label_rules([
            ((c("spending_diversity") <= 2) & (c("transaction_timing_variance") < 1),
             "routine_spender"),
            ((c("spending_diversity") > 4) & (c("avg_late_night_activity") > 2),
             "diverse_night_spender"),
            ((c("avg_transaction_amount") > 1000) & (c("total_transactions") < 10),
             "high_value_occasional"),
        ], "regular_spender").alias("spending_behavior_type"),
    ).orderBy(F.desc("total_spending"), F.desc("avg_anomaly_score"))
