"""Sketches and bitmaps against the rows they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from rillcask.operators import aggregates, cohorts, incremental, ordered, sketches
from rillcask.session import new_folder


def test_merged_quantiles_stay_within_their_error(spark):
    rnd = random.Random(1)
    rows = [(i % 50, int(rnd.expovariate(0.001))) for i in range(40_000)] + [(None, None), (3, None)]
    df = spark.createDataFrame(rows, "part int, v bigint")
    parts = sketches.quantile_sketches(df, ["part"], "v")
    ps = {"p50": 0.5, "p99": 0.99}
    merged = sketches.merged_quantiles(parts.withColumn("all", F.lit(1)), ["all"], ps)
    out = sketches.rank_errors(df.withColumn("all", F.lit(1)), ["all"], "v", merged, ps).first()
    assert out.rows == 40_000
    assert out.p50_error <= 0.0085 and out.p99_error <= 0.0085
    assert out.p50_error + out.p99_error > 0  # it is a sketch, not the rows


def test_rank_error_is_zero_inside_a_tie(spark):
    df = spark.createDataFrame([(1, 5)] * 10, "g int, v bigint")
    guess = spark.createDataFrame([(1, 5), (2, 7)], "g int, p50 bigint")
    out = {r.g: r.p50_error for r in sketches.rank_errors(df, ["g"], "v", guess, {"p50": 0.5}).collect()}
    assert out == {1: 0.0, 2: None}


@pytest.mark.parametrize("lg_k,limit", [(14, 0.0), (8, 0.25)])
def test_kept_and_lost(spark, lg_k, limit):
    periods = {1: set(range(3000)), 2: set(range(1000, 4500)), 4: set(range(10))}
    df = spark.createDataFrame([(p, u) for p, us in periods.items() for u in us], "p int, u bigint")
    out = sketches.kept_and_lost(
        sketches.distinct_sketches(df, ["p"], "u", lg_k), "p", F.col("p") + 1, lg_k
    ).collect()
    assert [r.p for r in out] == [2]
    want = {"total": 3500, "kept": 2000, "lost": 1000, "new": 1500}
    for name, n in want.items():
        assert abs(out[0][name] - n) <= limit * 4500


def test_cohorts_grow_period_by_period(spark, rows):
    rnd = random.Random(2)
    seen = [(rnd.choice([7, 40_000, 2**40 + 3, *range(20)]), f"2024-03-{d:02d}") for d in range(1, 9) for _ in range(6)]
    seen += [(None, "2024-03-02")]
    df = spark.createDataFrame(seen, "u bigint, day string").withColumn("ts", F.to_timestamp("day"))
    path = new_folder(spark, "cohorts")
    for day in sorted({d for _, d in seen}):
        cohorts.add_period(spark, path, df.where(F.col("day") == day), "u", day)
    # adding a day again changes nothing
    cohorts.add_period(spark, path, df.where("day = '2024-03-08'"), "u", "2024-03-08")
    want = aggregates.cohort_retention(df.where("u is not null"), "u", "ts", "day")
    columns = ["cohort", "period_number", "active_users", "cohort_size", "retention_rate"]
    got = cohorts.retention(spark, path).withColumn("cohort", F.col("cohort").cast("timestamp"))
    assert rows(got, *columns) == rows(want, *columns)


def chain(spark, edges):
    return {r.name: r.level for r in incremental.run_order(spark.createDataFrame(edges, "child string, parent string")).collect()}


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    written = []
    real = incremental.pinned
    monkeypatch.setattr(incremental, "pinned", lambda df: written.append(1) or real(df))
    got = chain(spark, [(f"t{i}", f"t{i - 1}") for i in range(1, 5001)])
    assert got == {f"t{i}": i for i in range(5001)}
    assert len(written) < 20


def test_levels_equal_the_longest_way(spark):
    rnd = random.Random(3)
    edges = [(f"n{i}", f"n{rnd.randrange(max(0, i - 6), i)}") for i in range(1, 60) for _ in range(2)]
    edges = [e for e in edges if rnd.random() < 0.8]
    level = {}
    for name in sorted({n for e in edges for n in e}, key=lambda n: int(n[1:])):
        level[name] = max([level[p] + 1 for c, p in edges if c == name], default=0)
    assert chain(spark, edges) == level


@pytest.mark.parametrize("edges", [[("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("b", "root")]])
def test_cycles_are_refused(spark, edges):
    with pytest.raises(ValueError):
        chain(spark, edges)


def test_no_edges(spark):
    assert chain(spark, []) == {}


def test_time_frames_of_a_hot_group_are_cut(spark, rows):
    rnd = random.Random(4)
    data = [(rnd.choice("aab"), i, f"2024-01-{rnd.randint(1, 28):02d} {rnd.choice(['00', '12'])}:00:00") for i in range(400)]
    data += [("a", 1000 + i, None) for i in range(5)] + [(None, 2000, "2024-01-05 00:00:00")]
    df = spark.createDataFrame(data, "g string, v int, at string").withColumn("ts", F.to_timestamp("at"))
    aggs = {"total": F.sum("v"), "n": F.count(F.lit(1)), "low": F.min("v")}
    plain = ordered.rolling_days(df, ["g"], "ts", 3, aggs)
    cut = ordered.rolling_days(df, ["g"], "ts", 3, aggs, hot=50)
    assert rows(cut) == rows(plain)
    assert "__slice" in cut._jdf.queryExecution().toString()


@pytest.mark.parametrize("pieces", [1, 4])
def test_time_frames_of_a_hot_group_are_merged_from_parts(spark, rows, monkeypatch, pieces):
    """No frame is walked row by row: a row's cost does not grow with the rows in its frame."""
    monkeypatch.setattr(ordered, "SLICE_ROWS", 500 // pieces, raising=False)
    rnd = random.Random(5)
    data = [(rnd.choice("aaab"), rnd.choice([None, i]), rnd.randint(0, 20 * 86_400)) for i in range(600)]
    data += [("a", 7000, 5 * 86_400), ("a", 7001, 7 * 86_400), ("a", 7002, -86_400), ("a", 7003, None), (None, 1, 3)]
    data += [("a", None, None)] * 2
    df = spark.createDataFrame(data, "g string, v int, s long").select(
        "g", "v", F.timestamp_seconds("s").alias("ts"), (F.col("v") / 3).cast("decimal(9,2)").alias("d")
    )
    aggs = {"total": F.sum("v"), "money": F.sum("d"), "n": F.count(F.lit(1)), "low": F.min("v"), "high": F.max("ts")}
    plain = ordered.rolling_days(df, ["g"], "ts", 2, aggs)
    cut = ordered.rolling_days(df, ["g"], "ts", 2, aggs, hot=50)
    assert rows(cut) == rows(plain)
    assert cut.schema.simpleString() == plain.schema.simpleString()
    walked = [df._jdf.queryExecution().analyzed().toString().count("-172800000000") for df in (plain, cut)]
    assert walked[0] == walked[1] > 0  # by the groups that are not hot, as without a limit; the hot ones add none
    assert ("__0_between" in cut._jdf.queryExecution().toString()) == (pieces > 1)


def test_other_aggregates_of_time_frames_keep_their_frames(spark, rows):
    rnd = random.Random(6)
    data = [(1, rnd.randint(0, 9), 997 * i) for i in range(200)]
    df = spark.createDataFrame(data, "g int, v int, s long").withColumn("ts", F.timestamp_seconds("s"))
    aggs = {"last": F.nth_value("v", 1), "mean": F.avg("v"), "wide": F.sum(F.col("v").cast("decimal(38,0)"))}
    assert rows(ordered.rolling_days(df, ["g"], "ts", 3, aggs, hot=50)) == rows(ordered.rolling_days(df, ["g"], "ts", 3, aggs))
