"""Groups above the limit must give the same rows as a plain window."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillcask.operators import joins, ordered
from rillcask.operators.skew import find_hot

LIMIT = 40
KEYS = ["k"]
ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def skewed(spark):
    """1,200 rows: two thirds in one group, a NULL group, many ties in v and t."""
    ids = spark.range(1200)
    key = F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.col("id") % 11 + 2
    )
    return ids.select(
        "id", key.cast("int").alias("k"), (F.col("id") * 37 % 101).alias("t"),
        (F.col("id") * 13 % 9).alias("v"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("sparse"),
    ).cache()


def same_rows(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_the_hot_groups_are_found(skewed):
    hot = find_hot(skewed, KEYS, LIMIT)
    assert {r[0] for r in hot.groups.select("__h0").collect()} >= {1, None}
    assert not find_hot(skewed, KEYS, 10_000)


def test_row_numbers(skewed):
    w = Window.partitionBy("k").orderBy(F.desc("t"), "id")
    expected = skewed.withColumn("n", F.row_number().over(w).cast("long")).withColumn(
        "z", F.count("*").over(Window.partitionBy("k"))
    )
    got = ordered.numbered(skewed, KEYS, [F.desc("t"), F.asc("id")], "n", "z", LIMIT)
    same_rows(expected, got)


def test_row_numbers_without_groups(skewed):
    expected = skewed.withColumn("n", F.row_number().over(Window.orderBy("t", "id")).cast("long"))
    same_rows(expected, ordered.numbered(skewed, [], ORDER, "n", hot=LIMIT))


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(skewed, descending):
    w = Window.partitionBy("k").orderBy(F.desc("v") if descending else F.asc("v"))
    expected = skewed.select(
        "*", F.rank().over(w).alias("r"), F.percent_rank().over(w).alias("p"),
        F.dense_rank().over(w).alias("d"),
    )
    got = ordered.ranked(
        skewed, KEYS, "v", descending=descending, rank="r", percent="p", dense="d", hot=LIMIT
    )
    same_rows(expected, got)


def test_ranks_of_many_distinct_values(skewed):
    """The distinct values of a hot group are themselves too many for one task."""
    w = Window.partitionBy("k").orderBy("id")
    expected = skewed.select(
        "*", F.rank().over(w).alias("r"), F.percent_rank().over(w).alias("p"),
        F.dense_rank().over(w).alias("d"),
    )
    same_rows(expected, ordered.ranked(
        skewed, KEYS, "id", rank="r", percent="p", dense="d", hot=LIMIT
    ))


@pytest.mark.parametrize("n", [1, 7, 10, 2000])
def test_tiles(skewed, n):
    expected = skewed.withColumn(
        "tile", F.ntile(n).over(Window.partitionBy("k").orderBy("v", "id"))
    )
    same_rows(expected, ordered.tiled(skewed, KEYS, ["v", "id"], n, "tile", LIMIT))
    same_rows(expected, ordered.tiled(skewed, KEYS, ["v", "id"], n, "tile"))


@pytest.mark.parametrize("reach", [1, 39, 40, 150])
def test_frames_longer_than_a_chunk(skewed, reach):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = skewed.withColumn("s", F.sum("id").over(w.rowsBetween(-reach, 0))).withColumn(
        "l", F.lag("id", reach).over(w)
    )
    got = ordered.windowed(skewed, KEYS, ORDER, {
        "s": lambda x: F.sum("id").over(x.rowsBetween(-reach, 0)),
        "l": lambda x: F.lag("id", reach).over(x),
    }, reach, LIMIT)
    same_rows(expected, got)


def test_running_totals(skewed):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.withColumn("c", F.coalesce(F.sum("v").over(w), F.lit(0)))
    same_rows(expected, ordered.cumulated(skewed, KEYS, ORDER, "v", "c", LIMIT))
    same_rows(expected, ordered.cumulated(skewed, KEYS, ORDER, "v", "c"))


def test_tiles_of_values_with_nulls(skewed):
    w = Window.partitionBy("k").orderBy("sparse", "id")
    expected = skewed.withColumn("tile", F.ntile(4).over(w))
    same_rows(expected, ordered.tiled(skewed, KEYS, ["sparse", "id"], 4, "tile", LIMIT))


def test_last_value_carries_over_chunks(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = skewed.withColumn("f", F.last("sparse", ignorenulls=True).over(w))
    same_rows(expected, ordered.filled(skewed, KEYS, ORDER, "sparse", "f", LIMIT))


def test_running_set(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = skewed.withColumn("f", F.array_sort(F.collect_set("v").over(w)))
    same_rows(expected, ordered.seen_so_far(skewed, KEYS, ORDER, "v", "f", LIMIT))
    sparse = skewed.withColumn("f", F.array_sort(F.collect_set("sparse").over(w)))
    same_rows(sparse, ordered.seen_so_far(skewed, KEYS, ORDER, "sparse", "f", LIMIT))


def test_encoding_of_many_categories(skewed):
    expected = skewed.withColumn("c", F.dense_rank().over(Window.orderBy("id")))
    same_rows(expected, ordered.encode_category(skewed, "id", "c", LIMIT))


def test_outliers_per_group(skewed):
    mean = F.avg("id").over(Window.partitionBy("k"))
    expected = skewed.withColumn("o", F.when(F.col("id") > mean * 1.5, 1).otherwise(0))
    same_rows(expected, ordered.outlier_flag(skewed, KEYS, "id", 1.5, "o"))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(skewed, forward, strict):
    left = skewed.where("id % 4 <> 0").select(F.col("id").alias("l"), "k", "t")
    right = skewed.where("id % 4 = 0").select(
        F.col("id").alias("r"), F.col("k").alias("rk"), F.col("t").alias("rt")
    )
    if forward:
        near = F.col("rt") > F.col("t") if strict else F.col("rt") >= F.col("t")
        best = F.min_by("r", F.struct("rt", "r"))
    else:
        near = F.col("rt") < F.col("t") if strict else F.col("rt") <= F.col("t")
        best = F.max_by("r", F.struct("rt", "r"))
    expected = left.join(right, (F.col("k") == F.col("rk")) & near, "left").groupBy("l").agg(
        best.alias("r")
    )
    for limit in (LIMIT, None):
        got = joins.asof_join(
            left, right, [("k", "rk")], "t", "rt", "r", forward, strict, limit
        ).select("l", "r")
        same_rows(expected, got)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(-3, 3)), min_size=1, max_size=60
))
def test_any_rows(spark, data):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(data)], "id long, k int, t int, v int"
    )
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = df.withColumn("s", F.sum("v").over(w.rowsBetween(-3, 0)))
    got = ordered.rolling(df, KEYS, ORDER, 3, {"s": F.sum("v")}, 4)
    same_rows(expected, got)


def test_any_number_of_hot_groups(spark):
    """The list of hot groups has no bound: here every one of 12,000 groups is above the limit."""
    rows = spark.range(36_000).select("id", (F.col("id") % 12_000).alias("k"))
    hot = find_hot(rows, ["k"], 2)
    assert hot.groups.count() == 12_000
    few = rows.where("k < 20")
    w = Window.partitionBy("k").orderBy("id")
    same_rows(few.withColumn("p", F.lag("id").over(w)), ordered.lagged(few, ["k"], ["id"], "id", 1, "p", 2))


def test_wide_values_are_not_broadcast_by_their_number(spark):
    """Whether a table is sent to all tasks follows from its bytes, not its rows."""
    wide = spark.range(3000).select(F.concat(F.col("id").cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(100))).alias("v"))
    text = ordered.encode_category(wide, "v", "code")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in text and "UnresolvedHint" not in text


def test_running_sums_of_doubles_are_refused(skewed):
    rows = skewed.withColumn("d", F.col("v").cast("double"))
    with pytest.raises(TypeError):
        ordered.cumulated(rows, KEYS, ORDER, "d", "c")
    exact = rows.withColumn("d", F.col("d").cast("decimal(20,4)"))
    same_rows(ordered.cumulated(exact, KEYS, ORDER, "d", "c"), ordered.cumulated(exact, KEYS, ORDER, "d", "c", LIMIT))


def test_frames_over_doubles_agree_on_both_paths(skewed):
    """Sums, means and deviations of bounded frames add the same rows in the same order."""
    rows = skewed.withColumn("d", F.col("v") / 7.0 + F.col("id") * 0.1)
    aggs = {"s": F.sum("d"), "m": F.avg("d"), "n": F.count("d")}
    same_rows(ordered.rolling(rows, KEYS, ORDER, 5, aggs), ordered.rolling(rows, KEYS, ORDER, 5, aggs, LIMIT))
    same_rows(ordered.rolling_zscore(rows, KEYS, ORDER, 5, "d", "z"),
              ordered.rolling_zscore(rows, KEYS, ORDER, 5, "d", "z", LIMIT))
    same_rows(ordered.filled(rows, KEYS, ORDER, "d", "f"), ordered.filled(rows, KEYS, ORDER, "d", "f", LIMIT))


def test_groups_of_one_input_are_counted_once(spark, skewed):
    rows = skewed.where("id < 1100")
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, "")
        run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs("first", lambda: ordered.lagged(rows, KEYS, ORDER, "v", 1, "p")) > 0
    assert jobs("second", lambda: ordered.rolling(rows, KEYS, ORDER, 3, {"s": F.sum("v")})) == 0
    assert jobs("third", lambda: ordered.numbered(rows, KEYS, ORDER, "n")) == 0


def test_sequences_equal_chained_searches(skewed):
    """One pass against three nested searches, with ties in time and a step that comes twice."""
    rows = skewed.select(
        "id", "k", (F.col("t") * 60).cast("timestamp").alias("at"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("v") % 3 + 1).cast("int")).alias("kind"),
    )
    data = [r for r in rows.collect() if r.k is not None]
    for steps in (["a", "b", "c"], ["a", "b", "a"]):
        want = []
        for r in data:
            times = [r["at"]]
            if r.kind != steps[0]:
                continue
            for step in steps[1:]:
                later = [x["at"] for x in data if x.k == r.k and x.kind == step and x["at"] > times[-1]]
                if not later:
                    break
                times.append(min(later))
            if len(times) == 3 and (times[-1] - times[0]).total_seconds() <= 1200:
                want.append((r.k, r.id, *times))
        for hot in (None, LIMIT):
            got = joins.sequence_match(rows, "k", "at", "kind", steps, "20 minutes", "id", hot)
            assert sorted(map(tuple, got.collect())) == sorted(want)


def test_null_keys_go_past_the_asof_window(spark):
    left = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 6, 9), (None, 5, 8)], "rk string, rt int, v int")
    got = joins.asof_join(left, right, [("k", "rk")], "t", "rt", "v")
    assert sorted(map(tuple, got.collect())) == [
        (1, None, 5, None, None, None), (2, None, 6, None, None, None), (3, "a", 7, "a", 6, 9)]


def test_sorting_blocks_do_not_follow_a_small_limit(spark):
    """Each block is a file and a part of every task's output; 20,000 rows once made 2,000 of them."""
    rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("blocks", "")
    got = ordered.numbered(rows, ["k"], ["id"], "n", hot=10)
    same_rows(rows.withColumn("n", F.floor(F.col("id") / 2) + 1), got)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("blocks")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s)]
    assert 0 < max(tasks) <= 100
