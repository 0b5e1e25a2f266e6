"""Streams fed by several files, compared with the batch result of the same rows."""

import time

import pytest
from pyspark.sql import functions as F

from rillcask.operators import dedup, joins
from rillcask.session import new_folder, shared_dir
from rillcask.sources.streams import read_stream, stream_query, with_record_metadata
from rillcask.streaming import events as times
from rillcask.streaming import sequences, sinks, windows

SCHEMA = "id int, k string, at string, v int"
PATTERN = "yyyy-MM-dd HH:mm:ss"
FILES = [
    [(1, "a", "2024-05-01 00:00:10", 5), (2, "b", "2024-05-01 00:01:00", 7)],
    [(3, "a", "2024-05-01 00:04:00", 1), (4, "a", "2024-05-01 00:11:00", 9)],
    [(5, "b", "2024-05-01 00:12:30", 2), (6, None, "2024-05-01 09:00:00", 0)],
]


def write_files(spark, files, schema=SCHEMA):
    path = new_folder(spark, "source")
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)
    return path


def open_stream(spark, files=FILES, one_by_one=True):
    options = {"maxFilesPerTrigger": str(int(one_by_one))} if one_by_one else {}
    rows_ = read_stream(spark, write_files(spark, files), SCHEMA, "json", options=options)
    return times.watermark(times.with_event_time(rows_, "at", PATTERN), "event_time", "5 seconds")


def as_table(spark, files=FILES):
    rows_ = spark.createDataFrame([r for part in files for r in part], SCHEMA)
    return times.with_event_time(rows_, "at", PATTERN)


def count_sum():
    return {"n": F.count(F.lit(1)), "total": F.sum("v")}


def test_tumbling_append_equals_batch(spark, rows):
    out = sinks.run_append(
        windows.tumbling(open_stream(spark), "event_time", "5 minutes", ["k"], count_sum()), "t"
    )
    batch = windows.tumbling(as_table(spark), "event_time", "5 minutes", ["k"], count_sum())
    assert rows(times.without_heartbeats(out, "k")) == rows(times.without_heartbeats(batch, "k"))


def test_last_window_stays_open_without_later_events(spark):
    out = sinks.run_append(windows.tumbling(
        open_stream(spark, FILES[:2]), "event_time", "5 minutes", [], count_sum()
    ), "open")
    assert out.count() == 1
    kept = sinks.run_upsert(windows.tumbling(
        open_stream(spark, FILES[:2]), "event_time", "5 minutes", [], count_sum()
    ), ["window_start"], ["window_start"], "update")
    assert kept.count() == 2


def test_session_append_equals_batch(spark, rows):
    aggs = {"n": ("count", None), "total": ("sum", "v")}
    out = sinks.run_append(
        windows.session(open_stream(spark), "event_time", "5 minutes", ["k"], aggs), "s"
    )
    batch = windows.session(as_table(spark), "event_time", "5 minutes", ["k"], aggs)
    assert rows(times.without_heartbeats(out, "k")) == rows(times.without_heartbeats(batch, "k"))


def test_row_behind_the_watermark_is_dropped(spark, rows):
    """Late rows are judged by the watermark that the batch before the last one set."""
    files = [
        [(1, "a", "2024-05-01 00:00:10", 1)], [(2, "a", "2024-05-01 00:20:00", 1)],
        [(5, "a", "2024-05-01 00:26:00", 1)], [(3, "a", "2024-05-01 00:00:14", 1)],
        [(4, "a", "2024-05-01 01:00:00", 1)],
    ]
    stream = windows.tumbling(
        open_stream(spark, files), "event_time", "5 minutes", [], {"n": F.count(F.lit(1))}
    )
    path, state = new_folder(spark, "late"), new_folder(spark, "late-state")
    late = sinks.LateRows()
    spark.streams.addListener(late)
    query = sinks.write_append(stream, path, state)
    query.awaitTermination()
    assert rows(spark.read.parquet(path), "n") == [(1,), (1,), (1,)]
    for _ in range(50):
        if late.dropped.get(str(query.id)):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped[str(query.id)] == 1


def test_first_row_per_window_equals_batch(spark, rows):
    def first(df):
        return dedup.dedup_window(df, ["k"], "event_time", "5 minutes", "id")

    out = sinks.run_append(first(open_stream(spark)), "first")
    batch = first(as_table(spark)).select(*out.columns)
    assert rows(times.without_heartbeats(out, "k")) == rows(times.without_heartbeats(batch, "k"))


def test_latest_per_key_upsert(spark, rows):
    out = sinks.run_upsert(
        dedup.latest_by_key(open_stream(spark), ["k"], ["event_time", "id"]),
        ["k"], ["event_time", "id"], "latest",
    )
    assert rows(out, "k", "id") == [("a", 4), ("b", 5), (None, 6)]


def test_upsert_batch_can_be_repeated_and_folded(spark, rows):
    """The same batch written twice leaves one copy; folding keeps the rows."""
    path = new_folder(spark, "repeat")
    df = open_stream(spark).select("k", "id", "event_time")
    sinks.write_upsert(df, ["k"], ["event_time"], path, new_folder(spark, "s1")).awaitTermination()
    first = rows(sinks.read_upsert(spark, path, ["k"], df.schema, ["event_time"]))
    again = open_stream(spark).select("k", "id", "event_time")
    sinks.write_upsert(again, ["k"], ["event_time"], path, new_folder(spark, "s2")).awaitTermination()
    assert rows(sinks.read_upsert(spark, path, ["k"], df.schema, ["event_time"])) == first
    target = new_folder(spark, "folded")
    sinks.fold_upsert(spark, path, ["k"], df.schema, ["event_time"], target)
    assert "batch_id" not in df.schema.names  # the caller's schema stays as it was
    assert rows(sinks.read_upsert(spark, target, ["k"], df.schema, ["event_time"])) == first


@pytest.mark.parametrize("files_per_batch", [1, 2])
def test_upsert_does_not_depend_on_the_batches(spark, rows, files_per_batch):
    """A newer row that arrives first stays, and a deletion that is last by time wins."""
    files = [
        [(1, "a", "2024-05-01 00:00:10", 1)], [(2, "a", "2024-05-01 00:00:05", 1)],
        [(3, "b", "2024-05-01 00:00:01", 1)], [(4, "b", "2024-05-01 00:00:09", 0)],
        [(5, "b", "2024-05-01 00:00:03", 1)],
    ]
    df = open_stream(spark, files, files_per_batch)
    order = ["event_time", "id"]
    out = sinks.run_upsert(df, ["k"], order, "shuffled", deleted=F.col("v") == 0, mode="append")
    assert rows(out, "k", "id") == [("a", 1)]


def test_append_restart_reads_only_new_files(spark):
    source = write_files(spark, FILES[:1])
    path, state = new_folder(spark, "restart"), new_folder(spark, "restart-state")
    for more in (None, FILES[1]):
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").json(source)
        sinks.write_append(read_stream(spark, source, SCHEMA, "json"), path, state).awaitTermination()
    assert spark.read.parquet(path).count() == 4


def pairs(left, right):
    left = left.select(F.col("id").alias("l"), F.col("k").alias("lk"), F.col("event_time").alias("lt"))
    right = right.select(F.col("id").alias("r"), F.col("k").alias("rk"), F.col("event_time").alias("rt"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_stream_equals_batch(spark, rows, how):
    left_files = [[(1, "a", "2024-05-01 00:00:00", 0)], [(2, "b", "2024-05-01 00:10:00", 0)],
                  [(3, "a", "2024-05-02 00:00:00", 0)]]
    right_files = [[(7, "a", "2024-05-01 00:05:00", 0)], [(8, "b", "2024-05-01 00:15:01", 0)],
                   [(9, "z", "2024-05-02 00:00:00", 0)]]

    def run(left, right):
        return joins.interval_join(
            *pairs(left, right), [("lk", "rk")], "lt", "rt", "5 minutes", "5 minutes", how=how
        ).select("l", "r")

    out = sinks.run_append(
        run(open_stream(spark, left_files), open_stream(spark, right_files)), "join"
    )
    batch = run(as_table(spark, left_files), as_table(spark, right_files))
    # the last left row is still open: the watermark has not passed its interval
    assert rows(out) == [r for r in rows(batch) if r[0] != 3]


def test_either_side_may_be_spread(spark, rows):
    left = as_table(spark, [[(i, "a", f"2024-05-01 00:{i:02}:00", 0) for i in range(0, 60, 3)]])
    right = as_table(spark, [[(i, "a", f"2024-05-01 00:{i:02}:00", 0) for i in range(0, 60, 4)]])

    def run(**spread):
        return rows(joins.interval_join(
            *pairs(left, right), [("lk", "rk")], "lt", "rt", "7 minutes", "2 minutes", **spread
        ).select("l", "r"))

    wanted = sorted(((a, b) for a in range(0, 60, 3) for b in range(0, 60, 4)
                     if a - 7 <= b <= a + 2), key=repr)
    assert run(spread="left") == run(spread="right") == wanted
    with pytest.raises(ValueError):
        run(spread="left", how="left")


def test_lifetimes_of_a_regular_join(spark, rows):
    left = as_table(spark, [[(1, "a", "2024-05-01 00:00:00", 0)]])
    right = as_table(spark, [[(i, "a", f"2024-05-01 0{i}:00:00", 0) for i in range(1, 6)]])
    before = as_table(spark, [[(8, "a", "2024-04-30 23:30:00", 0), (9, "a", "2024-04-30 22:00:00", 0)]])
    out = joins.ttl_join(
        *pairs(left, right.union(before)), [("lk", "rk")], "lt", "rt", "3 hours", "1 hour"
    )
    assert rows(out, "r") == [(1,), (2,), (3,), (8,)]


def test_steps_over_several_batches_with_a_late_one(spark, rows):
    def at(minute):
        return f"2024-05-01 00:{minute:02}:00"

    files = [[(1, "view", at(0), 1)], [(2, "buy", at(9), 1)], [(3, "click", at(5), 1)],
             [(4, "buy", at(7), 1), (5, "view", at(30), 1)], [(6, "click", at(50), 1)]]
    stream = times.with_event_time(
        read_stream(spark, write_files(spark, files), SCHEMA, "json",
                    options={"maxFilesPerTrigger": "1"}), "at", PATTERN)
    path, steps = new_folder(spark, "steps"), ["view", "click", "buy"]
    args = ("v", "event_time", "k", steps, "15 minutes", "id")
    sequences.write_sequences(
        stream, *args, path, new_folder(spark, "steps-state")
    ).awaitTermination()
    out = sequences.read_sequences(spark, stream, "v", "event_time", steps, "id", path)
    batch = joins.sequence_match(as_table(spark, files), *args)
    assert rows(out) == rows(batch.select(*out.columns)) and out.count() == 1
    assert out.first()["step_3"].minute == 7


def test_stream_stops_after_rows(spark):
    out = sinks.run_append(stream_query(open_stream(spark), ["id"], "v >= 0", 4), "limit")
    assert out.count() == 4
    with pytest.raises(ValueError):
        stream_query(open_stream(spark), max_rows=0)


def test_stream_keeps_file_metadata(spark):
    source = write_files(spark, FILES)
    out = sinks.run_append(
        with_record_metadata(read_stream(spark, source, SCHEMA, "json")).select(
            "id", "source_file"
        ), "meta",
    )
    assert out.where("source_file is null").count() == 0 and out.count() == 6


def test_heartbeat_rows_close_the_last_window(spark, rows):
    quiet = FILES[:2]
    stream = read_stream(spark, write_files(spark, quiet), SCHEMA, "json")
    beat = times.heartbeat_rows(stream, [{"at": "2024-06-01 00:00:00"}])
    folder = new_folder(spark, "beat")
    beat.write.json(folder)
    both = stream.unionByName(read_stream(spark, folder, SCHEMA, "json"))
    timed = times.watermark(times.with_event_time(both, "at", PATTERN), "event_time", "5 seconds")
    out = sinks.run_append(
        windows.tumbling(timed, "event_time", "5 minutes", ["k"], count_sum()), "closed"
    )
    assert rows(times.without_heartbeats(out, "k"), "k", "n") == [("a", 1), ("a", 2), ("b", 1)]


def test_distinct_rows_with_a_lifetime(spark, rows):
    files = [[(1, "a", "2024-05-01 00:00:00", 0)], [(2, "a", "2024-05-01 00:05:00", 0)],
             [(3, "b", "2024-05-01 02:00:00", 0)], [(4, "b", "2024-05-01 02:00:01", 0)],
             [(5, "a", "2024-05-01 02:00:02", 0)]]
    source = read_stream(spark, write_files(spark, files), SCHEMA, "json",
                         options={"maxFilesPerTrigger": "1"})
    timed = times.with_event_time(source, "at", PATTERN)
    out = sinks.run_append(dedup.distinct_within(timed, ["k"], "event_time", "1 hour"), "seen")
    assert rows(out, "id") == [(1,), (3,), (5,)]
    assert dedup.distinct(as_table(spark, files), ["k"]).count() == 2
    with pytest.raises(TypeError):
        dedup.distinct_within(as_table(spark, files), ["k"], "event_time", "1 hour")


def test_event_time_sources(spark, rows):
    df = spark.createDataFrame([(1673560175029, "2023-01-12T21:49:35Z")], "ms long, text string")
    df = times.with_event_time(df, "ms", "ms", "a")
    df = times.with_event_time(df, "text", "yyyy-MM-dd'T'HH:mm:ssX", "b")
    assert rows(df.select(
        F.date_format("a", "yyyy-MM-dd HH:mm:ss.SSS"), F.date_format("b", "yyyy-MM-dd HH:mm:ss")
    )) == [("2023-01-12 21:49:35.029", "2023-01-12 21:49:35")]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert new_folder(spark, "x").startswith(f"{named}/x-")
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(named)


def test_sinks_at_an_interval_take_files_that_come_later(spark):
    """With ``every`` the query stays up; stopped and started again it repeats nothing."""
    path, out, state = (new_folder(spark, name) for name in ("every-in", "every-out", "every-state"))

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)

    def run():
        return sinks.write_append(read_stream(spark, path, SCHEMA, "json"), out, state, every="1 second")

    put(FILES[0])
    query = run()
    try:
        query.processAllAvailable()
        assert spark.read.parquet(out).count() == 2 and query.isActive
        put(FILES[1])
        query.processAllAvailable()
        assert spark.read.parquet(out).count() == 4
    finally:
        query.stop()
    put(FILES[2])
    query = run()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "k", "at", "v").collect())
    assert got == sorted(r for part in FILES for r in part)


def test_append_time_of_files_as_event_time(spark):
    """When a file came is a time like any other: windows over it hold all of its rows."""
    source = with_record_metadata(read_stream(spark, write_files(spark, FILES), SCHEMA, "json"))
    marked = times.watermark(source.withColumnRenamed("source_timestamp", "came"), "came", "5 seconds")
    counts = windows.tumbling(marked, "came", "1 day", [], {"n": F.count(F.lit(1))})
    name, state = "append_time_counts", new_folder(spark, "came-state")
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").option(
        "checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table(name).agg(F.sum("n")).first()[0] == 6
