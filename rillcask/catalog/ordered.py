"""OVER functions. The ``_in_blocks`` queries cut even these small groups into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS, events, query, rounded, table
from rillcask.operators import joins, ordered
from rillcask.operators.rows import prefix_columns

BY_USER = ["user_id"]
BY_TIME = ["ts", "event_id"]
W = "partition by user_id order by ts, event_id"


def block_rows(df) -> int:
    """A limit that splits the table into about twenty blocks."""
    return max(50, df.count() // 20)


ROW_NUMBERS = """select event_id, user_id, row_number() over (partition by user_id
    order by ts desc, event_id desc) as recency from events"""


@query("row_numbers", ROW_NUMBERS)
def row_numbers(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    order = [F.desc("ts"), F.desc("event_id")]
    return ordered.numbered(rows, BY_USER, order, "recency").drop("ts")


RANKS = f"""select event_id, event_type, rank() over (partition by event_type order by cents desc)
    as place, percent_rank() over (partition by event_type order by cents desc) as share,
    dense_rank() over (partition by event_type order by cents desc) as dense
    from {EVENTS}"""


def _ranks(rows, hot=None):
    out = ordered.ranked(
        rows.select("event_id", "event_type", "cents"), ["event_type"], "cents",
        descending=True, rank="place", percent="share", dense="dense", hot=hot,
    )
    return out.drop("cents")


@query("ranks", RANKS)
def ranks(spark, folder):
    return _ranks(events(spark, folder))


@query("ranks_in_blocks", RANKS)
def ranks_in_blocks(spark, folder):
    rows = events(spark, folder)
    return _ranks(rows, block_rows(rows))


DECILES = f"""select event_id, ntile(10) over (partition by event_type order by cents, event_id)
    as decile from {EVENTS}"""


def _deciles(rows, hot=None):
    rows = rows.select("event_id", "event_type", "cents")
    return ordered.tiled(
        rows, ["event_type"], ["cents", "event_id"], 10, "decile", hot
    ).select("event_id", "decile")


@query("deciles", DECILES)
def deciles(spark, folder):
    return _deciles(events(spark, folder))


@query("deciles_in_blocks", DECILES)
def deciles_in_blocks(spark, folder):
    rows = events(spark, folder)
    return _deciles(rows, block_rows(rows))


@query("encode_category", """
    select p_partkey, dense_rank() over (order by p_brand) as brand_code from part""")
def encode_category(spark, folder):
    return ordered.encode_category(
        table(spark, folder, "part"), "p_brand", "brand_code"
    ).select("p_partkey", "brand_code")


DAILY = "(select ts::date as day, count(*) as n from events group by 1)"


def _daily(spark, folder):
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("lag_growth", f"""
    select strftime(day, '%Y-%m-%d') as day, n, case when lag(n, 7) over (order by day) > 0 then
      (n - lag(n, 7) over (order by day)) * 100::double / lag(n, 7) over (order by day) end as weekly
    from {DAILY}""")
def lag_growth(spark, folder):
    out = ordered.lag_growth(_daily(spark, folder), [], ["day"], "n", 7, "weekly")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("date_growth", f"""
    select strftime(a.day, '%Y-%m-%d') as day, a.n, case when b.n > 0 then
      (a.n - b.n) * 100::double / b.n end as weekly
    from {DAILY} a left join {DAILY} b on b.day = a.day - 7""")
def date_growth(spark, folder):
    out = ordered.date_growth(_daily(spark, folder), [], "day", "n", 7, "weekly")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("lagged", f"select event_id, lag(cents, 3) over ({W}) as third_last from {EVENTS}")
def lagged(spark, folder):
    rows = events(spark, folder).select("event_id", "user_id", "ts", "cents")
    return ordered.lagged(rows, BY_USER, BY_TIME, "cents", 3, "third_last").select(
        "event_id", "third_last"
    )


@query("gap_features", f"""
    select event_id, date_diff('day', lag(ts) over ({W}), ts) as days_since_last,
      (epoch_us(ts) // 1000000 - epoch_us(lag(ts) over ({W})) // 1000000) / 3600.0::double
        as hours_since_last from events""")
def gap_features(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return ordered.gap_features(rows, BY_USER, "ts", "event_id").select(
        "event_id", "days_since_last", "hours_since_last"
    )


ROLLING = f"""select event_id, sum(cents) over ({W} rows between 6 preceding and current row)
    ::bigint as total, avg(cents) over ({W} rows between 6 preceding and current row) as mean,
    count(*) over ({W} rows between 6 preceding and current row) as n from {EVENTS}"""


def _rolling(rows, hot=None):
    rows = rows.select("event_id", "user_id", "ts", "cents")
    return ordered.rolling(rows, BY_USER, BY_TIME, 6, {
        "total": F.sum("cents"), "mean": F.avg("cents"), "n": F.count(F.lit(1)),
    }, hot).select("event_id", "total", "mean", "n")


@query("rolling", ROLLING)
def rolling(spark, folder):
    return _rolling(events(spark, folder))


@query("rolling_days", f"""
    select event_id, sum(cents) over (partition by user_id order by ts
      range between interval 7 day preceding and current row)::bigint as total,
      count(*) over (partition by user_id order by ts
      range between interval 7 day preceding and current row) as n from {EVENTS}""")
def rolling_days(spark, folder):
    return ordered.rolling_days(events(spark, folder), BY_USER, "ts", 7, {
        "total": F.sum("cents"), "n": F.count(F.lit(1)),
    }).select("event_id", "total", "n")


@query("rolling_days_in_slices", f"""
    select event_id, (sum(cents) over w)::bigint as total, min(cents) over w as least, count(*) over w as n
    from {EVENTS} window w as (partition by event_type = 'view' order by ts
      range between interval 2 day preceding and current row)""")
def rolling_days_in_slices(spark, folder):
    """Two groups that hold the whole table, cut into slices of time."""
    rows = events(spark, folder).withColumn("view", F.col("event_type") == "view")
    return ordered.rolling_days(rows, ["view"], "ts", 2, {
        "total": F.sum("cents"), "least": F.min("cents"), "n": F.count(F.lit(1)),
    }, hot=100).select("event_id", "total", "least", "n")


@query("rolling_in_blocks", f"""
    select event_id, sum(cents) over (w rows between 6 preceding and current row)::bigint as total,
      avg(cents) over (w rows between 6 preceding and current row) as mean,
      count(*) over (w rows between 6 preceding and current row) as n from {EVENTS}
    window w as (partition by event_type = 'view' order by ts, event_id)""")
def rolling_in_blocks(spark, folder):
    """Two groups, one with four fifths of all rows."""
    rows = events(spark, folder).withColumn("user_id", F.col("event_type") == "view")
    return _rolling(rows, block_rows(rows))


@query("rolling_zscore", f"""
    select event_id, {rounded(f'''coalesce(case when stddev_samp(cents) over w > 0 then
      (cents - avg(cents) over w) / stddev_samp(cents) over w end, 0)''', 6)} as zscore
    from {EVENTS} window w as ({W} rows between 29 preceding and current row)""")
def rolling_zscore(spark, folder):
    rows = events(spark, folder).select("event_id", "user_id", "ts", "cents")
    out = ordered.rolling_zscore(rows, BY_USER, BY_TIME, 29, "cents", "zscore")
    return out.select("event_id", F.round("zscore", 6).alias("zscore"))


@query("rolling_ndv", f"""
    select event_id, len(list_distinct(list(k) over
      ({W} rows between 29 preceding and current row))) as ndv from {EVENTS}""")
def rolling_ndv(spark, folder):
    rows = events(spark, folder).select("event_id", "user_id", "ts", "k")
    return ordered.rolling_ndv(rows, BY_USER, BY_TIME, 29, "k", "ndv").select("event_id", "ndv")


HISTORY = f"""select event_id, array_to_string(list(event_type) over
    ({W} rows between 4 preceding and current row), ',') as recent,
    array_to_string(list_sort(list_distinct(list(event_type) over
    ({W} rows between unbounded preceding and current row))), ',') as seen from events"""


def _history(rows, hot=None):
    rows = rows.select("event_id", "user_id", "ts", "event_type")
    rows = ordered.last_values(rows, BY_USER, BY_TIME, 4, "event_type", "recent", hot)
    rows = ordered.seen_so_far(rows, BY_USER, BY_TIME, "event_type", "seen", hot)
    return rows.select(
        "event_id", F.array_join("recent", ",").alias("recent"),
        F.array_join("seen", ",").alias("seen"),
    )


@query("history_arrays", HISTORY)
def history_arrays(spark, folder):
    return _history(table(spark, folder, "events"))


@query("anomaly_flag", """
    with h as (select date_trunc('hour', ts) as hour, event_type, count(*) as n
      from events group by 1, 2)
    select hour, event_type, n, case when n > m * 2 then 'spike' when n < m * 0.5 then 'drop'
      else 'normal' end as flag
    from (select *, avg(n) over (partition by event_type order by hour
      rows between 11 preceding and 1 preceding) as m from h)""")
def anomaly_flag(spark, folder):
    hourly = table(spark, folder, "events").groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    return ordered.anomaly_flag(
        hourly, ["event_type"], ["hour"], "n", 11, 2, 0.5, "flag", ("spike", "drop", "normal")
    )


@query("outlier_flag", f"""
    select event_id, case when cents > 3 * avg(cents) over (partition by event_type) then 1 else 0
      end as is_large from {EVENTS}""")
def outlier_flag(spark, folder):
    rows = events(spark, folder).select("event_id", "event_type", "cents")
    return ordered.outlier_flag(rows, ["event_type"], "cents", 3, "is_large").select(
        "event_id", "is_large"
    )


@query("asof_join_in_blocks", """
    select p.event_id as p_event_id, max_v as v_event_id from
      (select event_id, event_type, max(case when event_type = 'view' then event_id end) over
        (order by ts, event_id) as max_v from events) p where event_type = 'purchase'""")
def asof_join_in_blocks(spark, folder):
    """The last view of anybody before each purchase: one key holds all rows."""
    rows = table(spark, folder, "events").withColumn("all", F.lit(1)).select(
        "event_id", "ts", "event_type", "all"
    )
    bought = prefix_columns(rows.where("event_type = 'purchase'"), "p_")
    viewed = prefix_columns(rows.where("event_type = 'view'"), "v_")
    return joins.asof_join(
        bought, viewed, [("p_all", "v_all")], "p_ts", "v_ts", "v_event_id",
        hot=block_rows(rows),
    ).select("p_event_id", "v_event_id")
