"""Event-time windows on tables, and the same bodies run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS, cents, events, plans, query, table
from rillcask.catalog.joins import BUYING, SEQUENCES, STRICT
from rillcask.functions.numbers import safe_ratio
from rillcask.functions.times import to_epoch
from rillcask.operators import dedup, joins, rows, sets, sketches
from rillcask.operators.aggregates import count_where, int_average
from rillcask.operators.rows import prefix_columns
from rillcask.plans import traffic_kpis as traffic
from rillcask.session import new_folder, rocksdb_state
from rillcask.sources.streams import read_stream, stream_query
from rillcask.streaming import events as times
from rillcask.streaming import lifetimes, ranking, sequences, sinks, temporal, upsert, windows

SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
BUCKET = "time_bucket(interval {0}, ts, timestamp '1970-01-01')"


def kpi_aggs():
    kind = F.col("event_type")
    return {
        "n_events": F.count(F.lit(1)),
        "views": count_where(kind == "view"),
        "clicks": count_where(kind == "click"),
        "purchases": count_where(kind == "purchase"),
        "errors": count_where(kind == "error"),
        "revenue_cents": F.sum(F.when(kind == "purchase", F.col("cents")).otherwise(0)),
        "p95_value": F.percentile_approx("value", 0.95),
    }


def with_rates(df):
    views, clicks = F.col("views"), F.col("clicks")
    return df.withColumns({
        "view_to_click_rate": safe_ratio(clicks, views, 100, 0.0),
        "click_to_purchase_rate": safe_ratio(F.col("purchases"), clicks, 100, 0.0),
        "error_rate": safe_ratio(F.col("errors"), F.col("n_events"), 100, 0.0),
    })


KPIS = f"""
    select *, case when views > 0 then clicks * 100::double / views else 0 end as view_to_click_rate,
      case when clicks > 0 then purchases * 100::double / clicks else 0 end
        as click_to_purchase_rate, errors * 100::double / n_events as error_rate
    from (select {BUCKET.format("6 hour")} as window_start,
      {BUCKET.format("6 hour")} + interval 6 hour as window_end, count(*) as n_events,
      count(case when event_type = 'view' then 1 end) as views,
      count(case when event_type = 'click' then 1 end) as clicks,
      count(case when event_type = 'purchase' then 1 end) as purchases,
      count(case when event_type = 'error' then 1 end) as errors,
      sum(case when event_type = 'purchase' then cents else 0 end)::bigint as revenue_cents,
      quantile_disc(value, 0.95) as p95_value
    from {EVENTS} group by 1, 2)"""


def plain_times(df, *names):
    """Window bounds as plain timestamps, as the tables store theirs."""
    names = names or ("window_start", "window_end")
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("tumbling_kpis", KPIS)
def tumbling_kpis(spark, folder):
    return plain_times(with_rates(windows.tumbling(
        events(spark, folder), "ts", "6 hours", [], kpi_aggs()
    )))


HOPPING = f"""
    select start as window_start, start + interval 12 hour as window_end, user_id,
      sum(cents)::bigint // count(*) as avg_cents
    from (select *, unnest([{BUCKET.format("6 hour")}, {BUCKET.format("6 hour")} - interval 6 hour])
      as start from {EVENTS}) group by 1, 2, 3"""


@query("hopping_avg", HOPPING)
def hopping_avg(spark, folder):
    return plain_times(windows.hopping(
        events(spark, folder), "ts", "12 hours", "6 hours", ["user_id"],
        {"avg_cents": int_average("cents")},
    ))


SESSIONS = """
    select user_id, min(ts) as session_start, max(ts) as session_end,
      epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as session_length_ms,
      count(*) as clicks, max(value) as top
    from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
      (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id)
        <= interval 6 hour then 0 else 1 end as new from events))
    group by user_id, s"""
SESSION_AGGS = {"clicks": ("count", None), "top": ("max", "value")}


@query("session_clicks", SESSIONS)
def session_clicks(spark, folder):
    return windows.session(
        table(spark, folder, "events"), "ts", "6 hours", ["user_id"], SESSION_AGGS
    )


@query("session_in_blocks", """
    select view, min(ts) as session_start, max(ts) as session_end,
      epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as session_length_ms,
      count(*) as clicks, max(value) as top
    from (select *, sum(new) over (partition by view order by ts, event_id) as s from
      (select *, event_type = 'view' as view, case when ts - lag(ts) over (partition by
        event_type = 'view' order by ts, event_id) <= interval 1 minute then 0 else 1 end as new
       from events))
    group by view, s""")
def session_in_blocks(spark, folder):
    """Two keys, cut into chunks of slots."""
    rows_ = table(spark, folder, "events").withColumn("view", F.col("event_type") == "view")
    return windows.session(rows_, "ts", "1 minute", ["view"], SESSION_AGGS, hot=100)


@query("two_stage_windows", f"""
    select day as window_start, day + interval 1 day as window_end, max(n) as busiest,
      count(*) as hours from (select date_trunc('hour', ts) as hour,
      time_bucket(interval 1 day, ts, timestamp '1970-01-01') as day, count(*) as n
      from events group by 1, 2) group by 1, 2""")
def two_stage_windows(spark, folder):
    return plain_times(windows.second_stage(
        times.with_event_time(table(spark, folder, "events"), "ts", name="at"), "at", "1 hour",
        "1 day", [], {"n": F.count(F.lit(1))},
        {"busiest": F.max("n"), "hours": F.count(F.lit(1))},
    ))


@query("event_time_from_payload", f"""
    select date_trunc('day', ts) as window_start, count(*) as n from events group by 1""")
def event_time_from_payload(spark, folder):
    """The event time travels as epoch milliseconds in one column and as text in another."""
    payload = table(spark, folder, "events").select(
        to_epoch(F.col("ts"), "ms").alias("ms"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"),
    )
    timed = times.with_event_time(payload, "ms", "ms")
    timed = times.with_event_time(timed, "text", "yyyy-MM-dd HH:mm:ss", "from_text")
    same = F.date_trunc("second", "event_time") == F.col("from_text")
    return plain_times(windows.tumbling(
        timed.where(same), "event_time", "1 day", [], {"n": F.count(F.lit(1))}
    )).drop("window_end")


_FILES: dict[tuple[str, str, bool], str] = {}
BOUNDS = ("2024-01-11", "2024-01-21")


def event_files(spark, folder, heartbeat: bool = False) -> str:
    """The events as three files in the order of time, written once per session and folder.

    With ``heartbeat`` a last file brings events of no user a month later, which close all
    windows.
    """
    key = (spark.sparkContext.applicationId, folder, heartbeat)
    if key not in _FILES:
        path, rows_ = new_folder(spark, "event-files"), table(spark, folder, "events")
        at = F.col("ts")
        low, high = (F.lit(b).cast("timestamp_ntz") for b in BOUNDS)
        parts = [rows_.where(p) for p in (at < low, (at >= low) & (at < high), at >= high)]
        if heartbeat:
            parts.append(rows_.agg(F.max("ts").alias("ts")).select(
                F.lit(None).cast("bigint").alias("event_id"),
                (F.col("ts") + F.expr("INTERVAL 30 DAY")).alias("ts"),
                F.lit(None).cast("bigint").alias("user_id"),
                F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias("event_type"),
                F.lit(None).cast("double").alias("value"),
                F.lit(None).cast("string").alias("props"),
            ))
        for part in parts:
            part.select(*rows_.columns).coalesce(1).write.mode("append").parquet(path)
        _FILES[key] = path
    return _FILES[key]


def stream(spark, folder, heartbeat: bool = False):
    """The events as a stream of one micro-batch per file in TIMESTAMP event time, with a
    watermark of ten minutes."""
    rows_ = read_stream(
        spark, event_files(spark, folder, heartbeat), SCHEMA, options={"maxFilesPerTrigger": "1"}
    )
    timed = times.with_event_time(rows_, "ts", name="ts").withColumn("cents", cents("value"))
    return times.watermark(timed, "ts", "10 minutes")


@query("stream_tumbling", KPIS)
def stream_tumbling(spark, folder):
    """Update mode into an upsert table: open windows show their latest state."""
    kpis = windows.tumbling(stream(spark, folder), "ts", "6 hours", [], kpi_aggs())
    keys = ["window_start", "window_end"]
    return plain_times(with_rates(sinks.run_upsert(kpis, keys, keys, "tumbling")))


@query("stream_hopping", HOPPING)
def stream_hopping(spark, folder):
    """Append mode: a window is written once, when the heartbeat has closed it."""
    out = windows.hopping(
        stream(spark, folder, heartbeat=True), "ts", "12 hours", "6 hours", ["user_id"],
        {"avg_cents": int_average("cents")},
    )
    return plain_times(times.without_heartbeats(sinks.run_append(out, "hopping"), "user_id"))


@query("stream_session", SESSIONS)
def stream_session(spark, folder):
    out = windows.session(
        stream(spark, folder, heartbeat=True), "ts", "6 hours", ["user_id"], SESSION_AGGS
    )
    return plain_times(
        times.without_heartbeats(sinks.run_append(out, "session"), "user_id"),
        "session_start", "session_end",
    )


@query("stream_two_stage", f"""
    select day as window_start, max(n) as busiest from (select date_trunc('hour', ts) as hour,
      time_bucket(interval 1 day, ts, timestamp '1970-01-01') as day, count(*) as n
      from events group by 1, 2) group by 1""")
def stream_two_stage(spark, folder):
    """The heartbeat's own day stays open, so only real days are written."""
    out = windows.second_stage(
        stream(spark, folder, heartbeat=True), "ts", "1 hour", "1 day", [],
        {"n": F.count(F.lit(1))}, {"busiest": F.max("n")},
    )
    return plain_times(sinks.run_append(out, "two-stage")).drop("window_end")


@query("stream_dedup_window", """
    select user_id, event_type, first_id, n, window_start from (
      select user_id, event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01')
        as window_start, arg_min(event_id, ts) as first_id, count(*) as n
      from events group by 1, 2, 3)""")
def stream_dedup_window(spark, folder):
    rows_ = stream(spark, folder, heartbeat=True).withColumnRenamed("event_id", "first_id")
    out = dedup.dedup_window(
        rows_.select("user_id", "event_type", "first_id", "ts"), ["user_id", "event_type"],
        "ts", "6 hours", "first_id",
    )
    done = times.without_heartbeats(sinks.run_append(out, "dedup"), "user_id")
    return plain_times(done).select("user_id", "event_type", "first_id", "n", "window_start")


@query("stream_distinct", "select distinct user_id, event_type from events")
def stream_distinct(spark, folder):
    """Pairs are remembered for longer than the events last."""
    rows_ = read_stream(spark, f"{folder}/events[.]parquet", SCHEMA)
    rows_ = times.with_event_time(rows_, "ts", name="ts").select("user_id", "event_type", "ts")
    out = dedup.distinct_within(rows_, ["user_id", "event_type"], "ts", "60 days")
    return sinks.run_append(out, "distinct").drop("ts")


@query("stream_latest", """
    select user_id, event_id, event_type from (select *, row_number() over
      (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def stream_latest(spark, folder):
    rows_ = stream(spark, folder).select("user_id", "event_id", "event_type", "ts")
    out = dedup.latest_by_key(rows_, ["user_id"], ["ts", "event_id"])
    return sinks.run_upsert(out, ["user_id"], ["ts", "event_id"], "latest").drop("ts")


CHANGES = """
    select user_id, event_id, value from (select *, row_number() over
      (partition by user_id order by ts desc, event_id desc) as rn from events)
    where rn = 1 and event_type <> 'error'"""


@query("stream_changelog", CHANGES)
def stream_changelog(spark, folder):
    """An error deletes the user's row; files and batches come in any order of time."""
    rows_ = read_stream(spark, shuffled_files(spark, folder), SCHEMA, options={"maxFilesPerTrigger": "2"})
    rows_ = rows_.select("user_id", "event_id", "value", "event_type", "ts")
    out = sinks.run_upsert(
        rows_, ["user_id"], ["ts", "event_id"], "changes", "append", F.col("event_type") == "error"
    )
    return out.select("user_id", "event_id", "value")


def shuffled_files(spark, folder) -> str:
    """The events in five files that each hold all times."""
    path = new_folder(spark, "shuffled-events")
    table(spark, folder, "events").repartition(5, F.hash("event_id")).write.parquet(path)
    return path


@query("stream_upsert", """
    select user_id, event_type, event_id, value from (select *, row_number() over
      (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
    where rn = 1""")
def stream_upsert(spark, folder):
    """Raw rows into a table with a composite key."""
    rows_ = stream(spark, folder).select("user_id", "event_type", "event_id", "value", "ts")
    keys = ["user_id", "event_type"]
    return sinks.run_upsert(rows_, keys, ["ts", "event_id"], "upsert").drop("ts")


@query("stream_upsert_compacted", CHANGES)
def stream_upsert_compacted(spark, folder):
    """Five batches in any order of time; key ranges are rewritten between them."""
    rows_ = read_stream(spark, shuffled_files(spark, folder), SCHEMA, options={"maxFilesPerTrigger": "1"})
    rows_ = rows_.select("user_id", "event_id", "value", "event_type", "ts")
    target = upsert.UpsertTable(
        spark, new_folder(spark, "upsert"), ["user_id"], rows_.schema, ["ts", "event_id"], ranges=4, max_files=2
    )
    upsert.write_table(rows_, target, new_folder(spark, "upsert-state"), mode="append").awaitTermination()
    return target.read(F.col("event_type") == "error").select("user_id", "event_id", "value")


TOP = """
    select event_type, user_id, event_id, value from (select *, row_number() over
      (partition by event_type, user_id order by value desc, event_id) as rn from events) where rn <= 3"""


@query("stream_top_n", TOP)
def stream_top_n(spark, folder):
    """The first rows of each group, folded from the changes that the batches made."""
    rows_ = read_stream(spark, shuffled_files(spark, folder), SCHEMA, options={"maxFilesPerTrigger": "2"})
    rows_ = rows_.select("event_type", "user_id", "event_id", "value")
    path = new_folder(spark, "top")
    ranking.write_top_n(
        rows_, ["event_type", "user_id"], "event_id", [F.desc("value"), F.asc("event_id")], 3, path,
        new_folder(spark, "top-state"),
    ).awaitTermination()
    return ranking.folded(ranking.read_changes(spark, rows_.schema, path), "event_id")


@query("stream_lasting_join", """
    with v as (select * from events where event_type = 'view'),
      p as (select * from events where event_type = 'purchase')
    select p.user_id, v.event_id as v_event_id, p.event_id as p_event_id, p.ts as at
    from p asof join v on p.user_id = v.user_id and p.ts >= v.ts where p.ts - v.ts <= interval 12 hour
    union all select p.user_id, v.event_id, p.event_id, v.ts from p join v
      on p.user_id = v.user_id and v.ts > p.ts and v.ts <= p.ts + interval 2 hour""")
def stream_lasting_join(spark, folder):
    """A user's last view lives for twelve hours and is renewed by the next, a purchase for two."""
    rows_ = stream(spark, folder)
    out = lifetimes.lasting_join(
        _side(rows_, "view", "v_"), _side(rows_, "purchase", "p_"), [("v_user_id", "p_user_id")],
        "v_user_id", "p_event_id", "v_ts", "p_ts", "12 hours", "2 hours",
    )
    with rocksdb_state(spark):
        done = sinks.run_append(out, "lasting")
    return plain_times(done.select(F.col("p_user_id").alias("user_id"), "v_event_id", "p_event_id", "at"), "at")


@query("stream_distinct_users", """
    select ts::date as day, count(distinct user_id) as users, true as close from events group by 1""")
def stream_distinct_users(spark, folder):
    """Sketches of six hours from the stream, added up to days and held against the exact counts."""
    made = windows.tumbling(
        stream(spark, folder), "ts", "6 hours", [], {sketches.SKETCH: F.hll_sketch_agg("user_id", 14)}
    )
    kept = sinks.run_upsert(made, ["window_start"], ["window_start"], "users")
    days = sketches.merged_users(kept, [F.to_date("window_start").alias("day")], "guess")
    exact = table(spark, folder, "events").groupBy(F.to_date("ts").alias("__day")).agg(
        F.count_distinct("user_id").alias("users")
    )
    off = F.abs(F.col("guess") - F.col("users")) / F.col("users")
    return days.join(exact, F.col("day") == F.col("__day")).select("day", "users", (off <= 0.03).alias("close"))


@query("stream_count", "select count(*) as n from events")
def stream_count(spark, folder):
    """Global count in complete mode."""
    out = stream(spark, folder).groupBy(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.run_upsert(out, ["one"], ["n"], "count", mode="complete").drop("one")


PAIRS = """select c.event_id as c_event_id, p.event_id as p_event_id from
    (select * from events where event_type = 'click') c {how} join
    (select * from events where event_type = 'purchase') p
    on c.user_id = p.user_id and p.ts between c.ts - interval 6 hour and c.ts + interval 6 hour"""


def _side(rows_, kind, prefix):
    rows_ = rows_.where(F.col("event_type") == kind)
    return prefix_columns(rows_.select("event_id", "user_id", "ts"), prefix)


def _open_pairs(spark, folder, how, heartbeat=False):
    rows_ = stream(spark, folder, heartbeat)
    return joins.interval_join(
        _side(rows_, "click", "c_"), _side(rows_, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "6 hours", "6 hours", how=how,
    ).select("c_event_id", "p_event_id")


@query("stream_interval_join", PAIRS.format(how=""))
def stream_interval_join(spark, folder):
    return sinks.run_append(_open_pairs(spark, folder, "inner"), "pairs")


@query("stream_interval_left_join", PAIRS.format(how="left"))
def stream_interval_left_join(spark, folder):
    """A click without a purchase is written once the watermark rules one out."""
    out = sinks.run_append(_open_pairs(spark, folder, "left", heartbeat=True), "left-pairs")
    return times.without_heartbeats(out, "c_event_id")


@query("stream_ttl_join", """
    select c.event_id as c_event_id, p.event_id as p_event_id from
      (select * from events where event_type = 'click') c join
      (select * from events where event_type = 'purchase') p on c.user_id = p.user_id
      and p.ts >= c.ts - interval 1 hour and p.ts <= c.ts + interval 5 hour""")
def stream_ttl_join(spark, folder):
    """A click is remembered for five hours, a purchase for one."""
    rows_ = stream(spark, folder)
    out = joins.ttl_join(
        _side(rows_, "click", "c_"), _side(rows_, "purchase", "p_"), [("c_user_id", "p_user_id")],
        "c_ts", "p_ts", "5 hours", "1 hour",
    ).select("c_event_id", "p_event_id")
    return sinks.run_append(out, "ttl")


@query("stream_asof_join", """
    select p.event_id as p_event_id, v.event_id as v_event_id, v.ts as v_ts from
      (select * from events where event_type = 'purchase') p asof left join
      (select * from events where event_type = 'view') v
      on p.user_id = v.user_id and p.ts >= v.ts""")
def stream_asof_join(spark, folder):
    """Purchases as they arrive, with the view that was the latest at their time."""
    def views(session):
        rows_ = times.with_event_time(table(session, folder, "events"), "ts", name="ts")
        return _side(rows_, "view", "v_")

    path = new_folder(spark, "asof")
    facts = _side(stream(spark, folder), "purchase", "p_")
    temporal.write_asof(
        facts, views, [("p_user_id", "v_user_id")], "p_ts", "v_ts", "v_event_id", path,
        new_folder(spark, "asof-state"),
    ).awaitTermination()
    return plain_times(
        spark.read.parquet(path).select("p_event_id", "v_event_id", "v_ts"), "v_ts"
    )


@query("stream_enrich", """
    select event_id, user_id, c_name from events left join customer on user_id = c_custkey""")
def stream_enrich(spark, folder):
    out = joins.enrich(
        stream(spark, folder), table(spark, folder, "customer"), [("user_id", "c_custkey")]
    ).select("event_id", "user_id", "c_name")
    return sinks.run_append(out, "enriched")


@query("stream_routes", """
    select case event_type when 'purchase' then 'buy' when 'error' then 'other' else 'look' end
      as route, event_id from events""")
def stream_routes(spark, folder):
    """One pass writes one folder per route."""
    kind = F.col("event_type")
    routed = rows.route(stream(spark, folder), {
        "buy": kind == "purchase", "look": kind.isin("view", "click", "signup"),
    }).select("event_id", "route")
    path, state = new_folder(spark, "routes"), new_folder(spark, "routes-state")
    sinks.write_append(routed, path, state, partition_by=["route"]).awaitTermination()
    return spark.read.parquet(path).select("route", "event_id")


@query("stream_merge", """
    select event_id, 'shop' as origin from events where event_type = 'purchase'
    union all select event_id, 'web' from events where event_type <> 'purchase'""")
def stream_merge(spark, folder):
    rows_ = stream(spark, folder)
    return sinks.run_append(sets.merge_tagged({
        "shop": rows_.where("event_type = 'purchase'").select("event_id"),
        "web": rows_.where("event_type <> 'purchase'").select("event_id"),
    }, "origin"), "merged")


@query("stream_first_rows", """
    select least(count(*), 500) as n, least(count(*), 500) as fitting from events where value > 10""")
def stream_first_rows(spark, folder):
    """A streaming query that ends after 500 rows."""
    out = stream_query(stream(spark, folder), ["event_id", "value"], "value > 10", 500)
    return sinks.run_append(out, "first-rows").agg(
        F.count_distinct("event_id").alias("n"), F.count_if(F.col("value") > 10).alias("fitting")
    )


@query("stream_sequence_match", SEQUENCES)
def stream_sequence_match(spark, folder):
    rows_, steps = stream(spark, folder), ["view", "click", "purchase"]
    path = new_folder(spark, "sequences")
    sequences.write_sequences(
        rows_, "user_id", "ts", "event_type", steps, "12 hours", "event_id", path,
        new_folder(spark, "sequences-state"),
    ).awaitTermination()
    out = sequences.read_sequences(spark, rows_, "user_id", "ts", steps, "event_id", path)
    return plain_times(out, "step_1", "step_2", "step_3")


COUNTED = [
    "unique_users", "unique_sessions", "unique_countries", "unique_cities", "unique_traffic_sources",
]


@query("stream_traffic_kpis", f"select * exclude ({', '.join(COUNTED)}) from ({plans.TRAFFIC})")
def stream_traffic_kpis(spark, folder):
    """Open windows are upserted batch by batch; the spike flag compares a group's windows so far.

    Distinct counts are sketches on a stream and are left out of the comparison.
    """
    rows_ = stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kpis = traffic.window_kpis(plans.traffic_columns(rows_), "6 hours", approx=True)
    keys = ["window_start", "window_end", *traffic.GROUPS]
    kept = sinks.run_upsert(kpis, keys, keys, "traffic")
    return plain_times(traffic.with_spikes(kept)).drop(*COUNTED)


@query("stream_patterns", STRICT.format("user_id", "5 day"))
def stream_patterns(spark, folder):
    """The strict pattern from five batches that each hold all times: late rows end and undo matches."""
    rows_ = read_stream(spark, shuffled_files(spark, folder), SCHEMA, options={"maxFilesPerTrigger": "1"})
    path = new_folder(spark, "patterns")
    sequences.write_patterns(
        rows_, ["user_id"], "ts", "event_type", BUYING, "5 days", "event_id", path,
        new_folder(spark, "patterns-state"), "none",
    ).awaitTermination()
    return sequences.read_patterns(spark, rows_, ["user_id"], "ts", "event_id", path)


def table_stream(spark, folder, name):
    """Any driver table as a stream."""
    schema = table(spark, folder, name).schema
    return read_stream(spark, f"{folder}/{name}[.]parquet", schema)
