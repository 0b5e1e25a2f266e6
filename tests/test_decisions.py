
import pytest
from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillcask.functions import numbers, strings, times
from rillcask.operators import aggregates, dedup, joins, ordered, sets
from rillcask.plans import traffic_kpis, user_segments
from rillcask.streaming import events


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def timed(spark, data, schema="id int, k string, s long"):
    return events.with_event_time(make(spark, data, schema), "s", "s").drop("s")


def test_d1_keys_seen_twice_still_have_a_first_row(spark, rows):
    df = timed(spark, [(1, "a", 0), (2, "a", 1)])
    assert rows(dedup.dedup_window(df, ["k"], "event_time", "2 minutes", "id"), "id") == [(1,)]


def test_d2_each_window_has_its_own_first_row_and_bounds(spark):
    df = timed(spark, [(1, "a", 0), (2, "a", 500)])
    out = dedup.dedup_window(df, ["k"], "event_time", "2 minutes", "id")
    assert out.count() == 2 and {"window_start", "window_end"} <= set(out.columns)


def test_d3_join_keeps_its_time_bound(spark):
    left = timed(spark, [(1, "a", 0)], "l int, k string, s long")
    right = timed(spark, [(1, "a", 8 * 86400)], "r int, rk string, s long").withColumnRenamed(
        "event_time", "rt")
    out = joins.interval_join(left, right, [("k", "rk")], "event_time", "rt", "7 days", "7 days")
    assert out.isEmpty()


def test_d4_unmatched_rows_keep_their_own_id(spark, rows):
    out = joins.enrich_many(make(spark, [(1, 9)], "o int, c int"), [
        (make(spark, [(1, "x")], "cid int, n string"), [("c", "cid")])])
    assert rows(out) == [(1, 9, None)]


def test_d5_night_spans_midnight(spark, rows):
    df = make(spark, [(h,) for h in (5, 6, 7, 21, 22, 23)], "h int").select(
        "h", F.make_timestamp(*[F.lit(x) for x in (2024, 1, 1)], "h", F.lit(0), F.lit(0)).alias("t"))
    t = F.col("t")
    assert rows(df.where(times.is_late_night(t) == 1), "h") == [(22,), (23,), (5,), (6,)]
    assert df.where(times.is_late_night(t, literal=True) == 1).isEmpty()


def test_d6_unit_is_explicit(spark):
    one = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]
    row = spark.range(1).select(numbers.geo_distance(*one, "km"),
                                numbers.geo_distance(*one, "miles")).first()
    assert row[0] / row[1] == pytest.approx(1.609, abs=0.001)


@pytest.fixture
def acts(spark):
    """u1 active then gone, u2 active in both periods twice, u3 back after a long break."""
    data = [("u1", "2024-01-01", 50), ("u2", "2024-01-01", 50), ("u2", "2024-01-01", 45),
            ("u2", "2024-01-01", 3), ("u2", "2024-01-01", 2), ("u3", "2023-06-01", 100),
            ("u3", "2023-06-01", 1), ("u4", "2024-05-20", 4)]
    return make(spark, data, "user_id string, reg string, ago int").select(
        "user_id", F.concat("user_id", F.lit("@x.org")).alias("email"),
        F.col("reg").cast("timestamp_ntz").alias("registration_date"),
        (F.lit("2024-06-01").cast("timestamp_ntz") - F.make_interval(days="ago")).alias(
            "last_activity_date"))


def test_d7_churn_compares_users_not_rows(acts, rows):
    groups = user_segments.user_groups(acts, "2024-06-01")
    assert rows(groups["churned_users"], "user_id") == [("u1",)]
    past = acts.where("last_activity_date < timestamp_ntz'2024-05-02'")
    current = acts.where("last_activity_date >= timestamp_ntz'2024-05-02'")
    literal = sets.set_op(past, current, "except")
    assert {r["user_id"] for r in literal.collect()} == {"u1", "u2", "u3"}


def test_retained_rows_count_like_a_join(acts, rows):
    groups = user_segments.user_groups(acts, "2024-06-01")
    assert rows(groups["retained_users"], "user_id", "matches") == [("u2", 2), ("u2", 2)]
    report = {r["segment_type"]: r for r in user_segments.user_segments(acts, "2024-06-01").collect()}
    assert report["retained_users"]["user_count"] == 4
    assert report["reactivated_users"]["user_count"] == 1
    assert report["new_users"]["user_count"] == 1


def test_d8_periods_are_whole_months(spark, rows):
    df = make(spark, [("2024-01-01", "2024-02-01")], "a string, b string").select(
        F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    whole = times.whole_months(F.col("a"), F.col("b"))
    literal = times.whole_months(F.col("a"), F.col("b"), literal=True)
    assert df.select(whole, literal).first()[:] == (1, pytest.approx(31 / 30))


def test_d9_adoption_equals_the_product_form(spark, rows):
    usage = make(spark, [("f", "a"), ("f", "b"), ("g", "c"), ("g", "a")], "feature string, u string")
    acts = make(spark, [("a", "f"), ("a", "f"), ("b", "g")], "u string, used string")
    out = aggregates.adoption(usage, acts, acts, "feature", "used", "u")
    assert rows(out) == [("f", 1, 2, 50.0), ("g", 0, 2, 0.0)]
    assert aggregates.adoption(usage, acts, acts.where("false"), "feature", "used", "u").isEmpty()


def test_d10_spikes_compare_a_group_with_itself(spark, rows):
    data = [(i, "quiet", 1, i) for i in range(3)] + [(i, "busy", 100, i) for i in range(3)]
    df = make(spark, data, "w int, g string, n int, x int")
    out = ordered.anomaly_flag(df, ["g"], ["w"], "n", 11, 2, 0.5, "flag", traffic_kpis.LABELS)
    assert {r["flag"] for r in out.collect()} == {"NORMAL"}


def test_d11_no_single_task_for_totals(spark):
    df = spark.range(10).withColumn("c", F.col("id") % 3)
    for out in (aggregates.pct_of_total(df, "id"), ordered.outlier_flag(df, ["c"], "id", 2, "o")):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_d12_rows_back_or_days_back(spark, rows):
    df = make(spark, [("2024-01-01", 10), ("2024-01-02", 20), ("2024-01-05", 40)],
              "d string, n int").withColumn("d", F.to_date("d"))
    by_rows = ordered.lag_growth(df, [], ["d"], "n", 1, "g")
    by_date = ordered.date_growth(df, [], "d", "n", 1, "g")
    assert [r["g"] for r in by_rows.orderBy("d").collect()] == [None, 100.0, 100.0]
    assert [r["g"] for r in by_date.orderBy("d").collect()] == [None, 100.0, None]


def test_d13_rolling_counts_rows(spark):
    df = make(spark, [(i, i * 100) for i in range(9)], "id int, t int")
    out = ordered.rolling(df, [], ["t", "id"], 6, {"n": F.count("*")})
    assert max(r["n"] for r in out.collect()) == 7


def test_d14_units_bases_and_whole_division(spark, rows):
    df = make(spark, [(1, 47), (1, 48)], "k int, v int")
    assert rows(aggregates.int_avg(df, ["k"], "v")) == [(1, 47)]
    one = spark.range(1)
    same = times.from_epoch(F.lit(1), "s") == times.from_epoch(F.lit(1000), "ms")
    assert one.select(same, strings.split_part(F.lit("a::b"), "::", 1)).first()[:] == (True, "a")


def test_d17_one_null_empties_not_in(spark, rows):
    df = make(spark, [(1,), (2,), (None,)], "k int")
    listed = make(spark, [(2,)], "k int")
    assert rows(joins.not_in(df, listed, "k")) == [(1,)]
    assert joins.not_in(df, listed.union(make(spark, [(None,)], "k int")), "k").isEmpty()
    assert joins.not_in(df, listed.where("false"), "k").count() == 3
    assert rows(joins.anti(df, listed, ["k"])) == [(1,), (None,)]
    for name, keys in (("with", listed), ("without", listed.where("false"))):
        df.createOrReplaceTempView("d17_rows")
        keys.createOrReplaceTempView("d17_keys")
        literal = spark.sql("select * from d17_rows where k not in (select k from d17_keys)")
        assert rows(literal) == rows(joins.not_in(df, keys, "k")), name


def test_d18_ansi_is_on_and_ratios_are_guarded(spark, rows):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = make(spark, [(1, 0)], "a int, b int")
    with pytest.raises(ArithmeticException):
        df.select(F.col("a") / F.col("b")).collect()
    assert rows(df.select(numbers.safe_ratio(F.col("a"), F.col("b")),
                          numbers.safe_ratio(F.col("a"), F.col("b"), 100, None),
                          strings.to_type(F.lit("x"), "int"))) == [(0.0, None, None)]


def test_ordered_windows_are_refused_on_streams(spark, tmp_path):
    stream = spark.readStream.schema("k int, t int").json(str(tmp_path))
    with pytest.raises(AnalysisException):
        stream.withColumn("n", F.row_number().over(
            Window.partitionBy("k").orderBy("t")
        )).writeStream.format("noop").start()
