"""The plans must keep the shape that scales."""

import os

import pytest
from pyspark.sql import functions as F

from rillcask import catalog
from rillcask.operators import dedup, joins, ordered, rows as ops, sets
from rillcask.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture
def events(spark):
    return read_table(spark, FOLDER, "events")


def test_time_filters_and_columns_reach_the_scan(events):
    text = plan(ops.recent(events, "ts", "2024-01-31", 7).select("event_id"))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_top_rows_are_cut_before_the_shuffle(events):
    text = plan(sets.top_n(events, ["user_id"], [F.desc("value"), F.asc("event_id")], 3))
    partial = text.index("Partial")
    assert text.index("Exchange") < partial and "WindowGroupLimit" in text


def test_latest_row_is_aggregated_before_the_shuffle(events):
    df = dedup.latest_by_key(events, ["user_id"], ["ts", "event_id"])
    assert "partial_max_by" in plan(df) and shuffles(df) == 1


def test_plain_windows_over_one_group_share_a_shuffle(events):
    df = ordered.rolling(events, ["user_id"], ["ts", "event_id"], 6, {
        "a": F.sum("value"), "b": F.avg("value")})
    df = ordered.gap_features(df, ["user_id"], "ts", "event_id")
    assert shuffles(df) == 1 and plan(df).count("Sort [") == 1


def test_counting_groups_reads_only_their_columns(spark, events):
    counted = events.groupBy("user_id").count()
    assert "ReadSchema: struct<user_id:bigint>" in plan(counted)


def test_asof_join_needs_one_shuffle(events):
    views = ops.prefix_columns(events.where("event_type = 'view'"), "v_")
    bought = ops.prefix_columns(events.where("event_type = 'purchase'"), "p_")
    df = joins.asof_join(bought, views, [("p_user_id", "v_user_id")], "p_ts", "v_ts", "v_event_id")
    assert shuffles(df) == 1 and "Join" not in plan(df)


@pytest.mark.parametrize("name", ["interval_join", "theta_join", "ttl_join", "not_in", "anti_join",
                                  "compare_with_global", "feature_adoption", "user_segments",
                                  "pct_of_total", "retained_users", "temporal_analytics"])
def test_no_nested_loops_or_products(spark, name):
    catalog.load()
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_no_python_in_any_batch_plan(spark):
    """All expressions are Spark's own."""
    catalog.load()
    for name in ("fraud_features", "event_processing", "string_functions", "dead_letters"):
        text = plan(catalog.QUERIES[name](spark, FOLDER))
        assert "Python" not in text and "MapInPandas" not in text, name
