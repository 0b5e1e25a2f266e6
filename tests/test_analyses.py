"""Composite analyses on small rows, and with every group treated as too large."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rillcask import catalog
from rillcask.plans import (
    customer_journey, event_processing, product_analytics, sales_pivot, temporal_analytics,
    traffic_kpis, user_risk,
)
from rillcask.session import new_folder
from rillcask.sources.streams import read_stream
from rillcask.streaming import events as times
from rillcask.streaming import sinks

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
AS_OF = "2024-02-01"


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def same_rows(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def journey_tables(spark):
    def at(text):
        return dt.datetime.fromisoformat(text)

    web = make(spark, [
        (1, "s1", at("2024-01-30 10:00:00"), "page_view", "/a"),
        (1, "s1", at("2024-01-30 10:05:00"), "purchase", "/b"),
        (1, "s2", at("2024-01-31 10:00:00"), "page_view", "/a"),
        (2, "s3", at("2024-01-31 11:00:00"), "page_view", "/a"),
        (3, "s4", at("2024-01-01 11:00:00"), "page_view", "/a"),
    ], "customer_id long, session_id string, event_timestamp timestamp_ntz, event_type string, "
       "page_url string")
    profiles = make(spark, [
        (1, "gold", "x", dt.date(2024, 1, 20)), (2, "gold", "x", dt.date(2020, 1, 1)),
    ], "customer_id long, membership_tier string, location string, registration_date date")
    purchases = make(spark, [
        (1, 10.0, dt.date(2024, 1, 30)), (1, 20.0, dt.date(2024, 1, 10)),
        (1, 5.0, dt.date(2023, 12, 1)), (1, 99.0, dt.date(2023, 1, 1)),
        (2, 7.0, dt.date(2023, 12, 20)),
    ], "customer_id long, amount double, purchase_date date")
    return web, profiles, purchases


def test_customer_metrics(journey_tables, rows):
    out = customer_journey.customer_metrics(*journey_tables, AS_OF)
    assert rows(out, "customer_id", "customer_segment", "total_sessions", "total_web_purchases",
                "total_purchases", "total_spent", "days_since_last_purchase") == [
        (1, "new", 2, 1, 3, 35.0, 2), (2, "veteran", 1, 0, 1, 7.0, 43)]


def test_customer_journey(journey_tables, rows):
    out = customer_journey.customer_journey(*journey_tables, AS_OF)
    assert out.columns == [
        "customer_segment", "membership_tier", "location", "customer_count", "avg_sessions",
        "avg_events_per_session", "avg_total_spent", "median_total_spent", "recent_purchasers",
        "at_risk_customers"]
    for row in out.collect():
        assert row["recent_purchasers"] + row["at_risk_customers"] <= row["customer_count"]
    assert rows(out, "customer_segment", "recent_purchasers", "at_risk_customers") == [
        ("new", 1, 0), ("veteran", 0, 1)]


def test_event_processing(spark):
    schema = ("event_id int, user_id string, event_timestamp timestamp_ntz, event_type string, "
              "event_properties struct<tags:array<string>,custom_fields:map<string,string>>, "
              "event_metadata struct<device_info:struct<os:string,browser:string>,"
              "location:struct<country:string,city:string>>, raw_event_data string")
    now = dt.datetime(2024, 1, 31, 12)
    meta = (("ios", "web"), ("FR", "Lyon"))
    raw = '{"user": {"preferences": {"language": "fr"}}, "session": {"duration": 9}}'
    out = event_processing.event_processing(make(spark, [
        (1, "u", now, "view", (["vip", "premium"], {"source": "mail"}), meta, raw),
        (2, "u", now, "buy", ([], {}), meta, "{}"),
        (3, "u", now, "buy", None, meta, raw),
        (4, "u", now - dt.timedelta(days=9), "buy", ([], {}), meta, raw),
    ], schema), AS_OF)
    first, second = out.orderBy("event_id").collect()
    assert (first["tag_count"], first["has_premium_tag"], first["first_tag"]) == (2, True, "vip")
    assert (first["vip_user_country"], second["vip_user_country"]) == ("FR", "unknown")
    assert (first["user_language"], first["session_duration"]) == ("fr", "9")
    assert second["first_tag"] is None and second["campaign_id"] is None
    assert second["recent_event_types"] == ["view", "buy"]
    assert second["all_user_countries"] == ["FR"]


def test_sales_of_this_month_only_give_no_rows(spark):
    sales = make(spark, [("a", "n", 5.0, dt.date(2024, 2, 3))],
                 "product_category string, region string, sale_amount double, sale_date date")
    assert sales_pivot.sales_pivot(sales, "2024-02-20").isEmpty()


def test_sales_over_a_year(spark):
    data = []
    for region, months in (("n", (100, 80, 60)), ("s", (10, 20, 30))):
        for back, amount in zip((1, 2, 3), months):
            data.append(("a", region, float(amount), dt.date(2024, 6 - back, 15)))
    data.append(("a", "n", 50.0, dt.date(2023, 6, 25)))
    data.append(("a", "n", 1000.0, dt.date(2023, 6, 2)))
    sales = make(spark, data, "product_category string, region string, sale_amount double, "
                              "sale_date date")
    north, south = sales_pivot.sales_pivot(sales, "2024-06-20").orderBy("region").collect()
    assert (north["mom_growth_percent"], north["yoy_growth_percent"]) == (25.0, 100.0)
    assert (north["revenue_trend"], south["revenue_trend"]) == ("upward_trend", "downward_trend")
    assert (north["revenue_rank_in_category"], south["revenue_rank_in_category"]) == (1, 2)
    assert (north["performance_indicator"], south["performance_indicator"]) == (
        "high_growth", "significant_decline")
    assert south["qoq_growth_percent"] is None


@needs_tables
def test_traffic_indicators_on_a_stream(spark):
    """Sketches replace exact distinct counts; every other column is the same."""
    catalog.load()
    from rillcask.catalog import plans

    batch = traffic_kpis.window_kpis(plans._traffic(spark, FOLDER), "1 day")
    path = new_folder(spark, "traffic")
    plans._traffic(spark, FOLDER).repartition(3).write.parquet(path)
    schema = plans._traffic(spark, FOLDER).schema
    stream = times.with_event_time(
        read_stream(spark, path, schema), "event_timestamp", name="event_timestamp")
    kpis = traffic_kpis.window_kpis(
        times.watermark(stream, "event_timestamp", "60 days"), "1 day", approx=True)
    keys = ["window_start", *traffic_kpis.GROUPS]
    out = sinks.run_upsert(kpis, keys, keys, "traffic")
    columns = ["event_count", "total_revenue", "page_views", "error_rate_percent",
               "mobile_events", "p95_response_time", *traffic_kpis.GROUPS]
    same_rows(batch.select(*columns), out.select(*columns))


@needs_tables
@pytest.mark.parametrize("limit", [25])
def test_analyses_agree_when_groups_are_cut(spark, limit):
    catalog.load()
    from rillcask.catalog import plans

    rows_ = catalog.events(spark, FOLDER)
    products = rows_.select(
        (F.col("k") % 3).alias("product_id"), F.col("event_type").alias("category"),
        F.col("ts").alias("event_timestamp"), "event_type", F.col("cents").alias("revenue"),
        "event_id")
    run = product_analytics.product_analytics
    same_rows(run(products, "2024-01-31", "event_id"), run(products, "2024-01-31", "event_id", limit))

    money = plans._transactions(spark, FOLDER)
    same_rows(user_risk.user_risk(money, "2024-01-31"),
              user_risk.user_risk(money, "2024-01-31", hot=limit))

    nested = plans._raw_events(spark, FOLDER)
    run = event_processing.event_processing
    same_rows(run(nested, "2024-01-20").drop("custom_field_values"),
              run(nested, "2024-01-20", hot=limit).drop("custom_field_values"))


def test_literal_night_flag_is_never_set(spark):
    money = make(spark, [(i, "u", dt.datetime(2024, 1, 20 + i, 23), 5.0, "USD", "m", "{}")
                         for i in range(6)],
                 "transaction_id int, user_id string, transaction_timestamp timestamp_ntz, "
                 "amount double, currency string, merchant_category string, "
                 "transaction_metadata string")
    on = user_risk.fraud_features(money, AS_OF, ranks=False)
    off = user_risk.fraud_features(money, AS_OF, literal_night=True, ranks=False)
    assert on.agg(F.sum("is_late_night")).first()[0] == 6
    assert off.agg(F.sum("is_late_night")).first()[0] == 0


def test_temporal_report_has_three_parts(spark):
    data = [("u", dt.datetime(2024, 1, d, h), "purchase", 1) for d in range(1, 30) for h in (9, 20)]
    data += [("v", dt.datetime(2024, 1, d, 9), "page_view", 1) for d in range(1, 30)]
    df = make(spark, data, "user_id string, event_timestamp timestamp_ntz, event_type string, "
                           "revenue_amount long")
    out = {r["analysis_type"]: r for r in temporal_analytics.temporal_analytics(df, AS_OF).collect()}
    assert out["hourly_peak_analysis"]["time_dimension"] == "9"
    assert out["seasonality_analysis"]["time_dimension"] == "winter"
    assert float(out["growth_trends"]["metric_value"]) == 0.0
