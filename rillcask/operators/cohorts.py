"""Cohorts kept up to date period by period, with exact bitmaps of the users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDED = "added"  # the period whose rows wrote a folder
_MEMBERS = T.StructType([
    T.StructField("user", T.LongType()), T.StructField("cohort", T.DateType()),
    T.StructField(ADDED, T.DateType()),
])
_ACTIVE = T.StructType([
    T.StructField("cohort", T.DateType()), T.StructField("period", T.DateType()),
    T.StructField("bucket", T.LongType()), T.StructField("users", T.BinaryType()),
    T.StructField(ADDED, T.DateType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def add_period(spark: SparkSession, path: str, rows: DataFrame, user: str, period: str) -> None:
    """Add the rows of one period (its first day), periods in the order of time.

    Only these rows are read. Users unknown so far found the period's cohort; all users of the
    period go into one bitmap per cohort and 32,768 user numbers. ``user`` is a whole number;
    numbers that lie close make few bitmaps. Adding a period again replaces what it wrote.
    """
    members, active = f"{path}/members", f"{path}/active"
    now = F.lit(period).cast("date")
    users = rows.where(F.col(user).isNotNull()).select(F.col(user).cast("long").alias("user")).distinct()
    # an empty first folder, so that the table of members can be read
    spark.createDataFrame([], T.StructType(_MEMBERS.fields[:2])).write.mode("overwrite").parquet(
        f"{members}/{ADDED}=0001-01-01"
    )
    known = _read(spark, members, _MEMBERS).where(F.col(ADDED) < now).select("user", "cohort")
    users.join(known, "user", "left_anti").withColumn("cohort", now).write.mode("overwrite").parquet(
        f"{members}/{ADDED}={period}"
    )
    known = _read(spark, members, _MEMBERS).where(F.col(ADDED) <= now).select("user", "cohort")
    users.join(known, "user").groupBy(
        "cohort", F.bitmap_bucket_number("user").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user")).alias("users")).withColumn(
        "period", now
    ).select("cohort", "period", "bucket", "users").write.mode("overwrite").parquet(f"{active}/{ADDED}={period}")


def retention(spark: SparkSession, path: str, days: int = 1) -> DataFrame:
    """cohort, period_number, active_users, cohort_size, retention_rate, from the bitmaps alone.

    ``days`` is the length of a reported period; shorter stored periods are merged by OR, so a user
    counts once.
    """
    rows = _read(spark, f"{path}/active", _ACTIVE)
    number = F.floor(F.datediff("period", "cohort") / F.lit(days)).cast("int").alias("period_number")
    merged = rows.groupBy("cohort", number, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    counts = merged.groupBy("cohort", "period_number").agg(F.sum(F.bitmap_count("users")).alias("active_users"))
    sizes = counts.groupBy(F.col("cohort").alias("__c")).agg(
        F.min_by("active_users", "period_number").alias("cohort_size")
    )
    out = counts.join(sizes, F.col("cohort") == F.col("__c")).drop("__c")
    rate = F.col("active_users") * 100 / F.col("cohort_size")
    return out.withColumn("retention_rate", F.round(rate, 2))
