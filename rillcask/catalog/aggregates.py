"""Grouped aggregates, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS, EVENTS_AS_OF, ORDERS_AS_OF, SQL, cents, events, query, rounded, table
from rillcask.operators import aggregates, cohorts, ordered, sets, sketches
from rillcask.operators.joins import flag_in
from rillcask.operators.rows import between_ago, recent
from rillcask.operators.skew import pinned
from rillcask.session import new_folder


@query("count_all", "select count(*) as n from lineitem")
def count_all(spark, folder):
    return aggregates.count_all(table(spark, folder, "lineitem"))


@query("count_by", "select l_returnflag, count(*) as n from lineitem group by 1")
def count_by(spark, folder):
    return aggregates.count_by(table(spark, folder, "lineitem"), ["l_returnflag"])


@query("count_values", """
    select user_id, count(case when event_type <> 'error' then event_id end) as n
    from events group by 1""")
def count_values(spark, folder):
    good = F.when(F.col("event_type") != "error", F.col("event_id"))
    return aggregates.count_by(
        table(spark, folder, "events").withColumn("good", good), ["user_id"], column="good"
    )


@query("sum_by", "select l_suppkey, sum(l_quantity::integer)::bigint as total from lineitem group by 1")
def sum_by(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_quantity").cast("int").alias("quantity")
    )
    return aggregates.sum_by(items, ["l_suppkey"], "quantity")


@query("minmax_by", """
    select o_custkey, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1""")
def minmax_by(spark, folder):
    return aggregates.minmax_by(
        table(spark, folder, "orders"), ["o_custkey"], "o_totalprice", "low", "high"
    )


@query("int_avg", f"select user_id, sum(k)::bigint // count(k) as avg from {EVENTS} group by 1")
def int_avg(spark, folder):
    return aggregates.int_avg(events(spark, folder), ["user_id"], "k")


@query("aggregate_mix", f"""
    select event_type, avg(cents) as mean, count(distinct user_id) as users,
      {rounded("stddev_samp(cents)", 4)} as sd, count(*) as n from {EVENTS} group by 1""")
def aggregate_mix(spark, folder):
    return aggregates.aggregate(events(spark, folder), ["event_type"], {
        "mean": F.avg("cents"), "users": aggregates.distinct_count("user_id"),
        "sd": F.round(F.stddev_samp("cents"), 4), "n": F.count(F.lit(1)),
    })


@query("conditional_aggregates", f"""
    select user_id, sum(case when event_type = 'purchase' then cents else 0 end)::bigint as revenue,
      avg(case when event_type = 'purchase' then cents end) as mean_purchase,
      max(case when event_type = 'purchase' then cents end) as top_purchase,
      count(case when event_type = 'view' then 1 end) as views
    from {EVENTS} group by 1""")
def conditional_aggregates(spark, folder):
    bought, value = F.col("event_type") == "purchase", F.col("cents")
    return aggregates.cond_agg(events(spark, folder), ["user_id"], {
        "revenue": ("sum", bought, value), "mean_purchase": ("avg", bought, value),
        "top_purchase": ("max", bought, value),
        "views": ("count", F.col("event_type") == "view", None),
    })


@query("funnel_rates", """
    select user_id, v as view_count, c as click_count, p as purchase_count,
      case when v > 0 then c * 100::double / v else 0 end as view_to_click_rate,
      case when c > 0 then p * 100::double / c else 0 end as click_to_purchase_rate
    from (select user_id, count(case when event_type = 'view' then 1 end) as v,
      count(case when event_type = 'click' then 1 end) as c,
      count(case when event_type = 'purchase' then 1 end) as p from events group by 1)""")
def funnel_rates(spark, folder):
    return aggregates.funnel_rates(
        table(spark, folder, "events"), ["user_id"], "event_type", ["view", "click", "purchase"]
    )


@query("error_rate", """
    select user_id, count(case when event_type = 'error' then 1 end) as error_count,
      count(*) as event_count,
      count(case when event_type = 'error' then 1 end) * 100::double / count(*) as error_rate
    from events group by 1""")
def error_rate(spark, folder):
    return aggregates.error_rate(
        table(spark, folder, "events"), ["user_id"], F.col("event_type") == "error"
    )


@query("percentiles", """
    select user_id, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95,
      quantile_disc(value, 0.99) as p99 from events group by 1""")
def percentiles(spark, folder):
    return aggregates.percentiles(
        table(spark, folder, "events"), ["user_id"], "value",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
    )


PS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _close(df, ps, limit):
    """Estimates whose rank misses by at most ``limit`` of the rows."""
    return df.withColumns({f"{n}_close": F.col(f"{n}_error") <= limit for n in ps}).drop(
        *ps, *[f"{n}_error" for n in ps]
    )


@query("merged_percentiles", """
    select year(l_shipdate)::integer as year, count(*) as rows, true as p50_close, true as p95_close,
      true as p99_close from lineitem group by 1""")
def merged_percentiles(spark, folder):
    """Years from stored months; ranks miss by at most 1 % of the rows, measured on all of them."""
    rows = table(spark, folder, "lineitem").select("l_shipdate", cents("l_extendedprice").alias("price"))
    months = pinned(sketches.quantile_sketches(rows, [F.date_trunc("month", "l_shipdate").alias("month")], "price"))
    years = pinned(sketches.merged_quantiles(months, [F.year("month").alias("year")], PS))
    rows = rows.withColumn("year", F.year("l_shipdate"))
    return _close(sketches.rank_errors(rows, ["year"], "price", years, PS), PS, 0.01)


@query("days_from_hours", """
    select event_type, ts::date as day, count(*) as rows, true as p50_close, true as p95_close,
      true as p99_close from events group by 1, 2""")
def days_from_hours(spark, folder):
    """Windows of a day from stored windows of an hour."""
    rows = table(spark, folder, "events").select("event_type", "ts", cents("value").alias("price"))
    keys = ["event_type", F.date_trunc("hour", "ts").alias("hour")]
    hours = pinned(sketches.quantile_sketches(rows, keys, "price"))
    days = pinned(sketches.merged_quantiles(hours, ["event_type", F.to_date("hour").alias("day")], PS))
    rows = rows.withColumn("day", F.to_date("ts"))
    return _close(sketches.rank_errors(rows, ["event_type", "day"], "price", days, PS), PS, 0.01)


@query("distinct_from_months", """
    select year(l_shipdate)::integer as year, count(distinct l_orderkey) as orders, true as close
    from lineitem group by 1""")
def distinct_from_months(spark, folder):
    """Distinct orders per year from monthly sketches, within four standard errors of the count."""
    rows = table(spark, folder, "lineitem").select("l_shipdate", "l_orderkey")
    keys = [F.date_trunc("month", "l_shipdate").alias("month")]
    months = pinned(sketches.distinct_sketches(rows, keys, "l_orderkey", 10))
    years = sketches.merged_distinct(months, [F.year("month").alias("year")], "guess", 10)
    exact = rows.groupBy(F.year("l_shipdate").alias("__y")).agg(F.count_distinct("l_orderkey").alias("orders"))
    off = F.abs(F.col("guess") - F.col("orders")) / F.col("orders")
    return years.join(exact, F.col("year") == F.col("__y")).select(
        "year", "orders", (off <= 4 / 2 ** 5).alias("close")
    )


@query("kept_and_lost", """
    with seen as (select distinct date_trunc('quarter', o_orderdate)::date as period, o_custkey from orders),
      p as (select distinct period from seen)
    select n.period, (select count(*) from seen s where s.period = n.period) as total,
      (select count(*) from seen s join seen b on s.o_custkey = b.o_custkey
        and b.period = n.period - interval 3 month where s.period = n.period) as kept,
      (select count(*) from seen b where b.period = n.period - interval 3 month and not exists
        (select 1 from seen s where s.period = n.period and s.o_custkey = b.o_custkey)) as lost,
      (select count(*) from seen s where s.period = n.period and not exists
        (select 1 from seen b where b.period = n.period - interval 3 month
          and s.o_custkey = b.o_custkey)) as new
    from p n join p b on b.period = n.period - interval 3 month""")
def kept_and_lost(spark, folder):
    """Customers of a quarter and the one before, from monthly sketches; these few count exactly."""
    rows = table(spark, folder, "orders").select("o_orderdate", "o_custkey")
    keys = [F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")]
    months = pinned(sketches.distinct_sketches(rows, keys, "o_custkey"))
    quarter = F.to_date(F.date_trunc("quarter", "month")).alias("period")
    quarters = pinned(sketches.merged_distinct(months, [quarter]).select("period", "sketch"))
    return sketches.kept_and_lost(quarters, "period", F.add_months("period", 3))


@query("pivot_periods", """
    select o_orderpriority, sum(case when m = date '2001-07-01' then c else 0 end)::bigint as last_month,
      sum(case when m = date '2001-06-01' then c else 0 end)::bigint as two_months_ago,
      sum(case when m in (date '2001-07-01', date '2001-06-01', date '2001-05-01') then c else 0 end)
        ::bigint as quarter,
      sum(case when m = date '2000-08-01' then c else 0 end)::bigint as last_year
    from (select o_orderpriority, date_trunc('month', o_orderdate)::date as m,
      cast(round(o_totalprice * 100) as bigint) as c from orders
      where o_orderdate >= timestamp '2000-08-01') group by 1""")
def pivot_periods(spark, folder):
    value = cents("o_totalprice")
    return aggregates.pivot_periods(
        table(spark, folder, "orders"), ["o_orderpriority"], "o_orderdate", ORDERS_AS_OF, {
            "last_month": ([1], value), "two_months_ago": ([2], value),
            "quarter": ([1, 2, 3], value), "last_year": ([12], value),
        },
    )


@query("growth_and_trend", """
    select o_orderpriority, case when b > 0 then (a - b) * 100::double / b end as growth,
      case when a > b and b > c then 'upward_trend' when a < b and b < c then 'downward_trend'
      else 'mixed_trend' end as trend
    from (select o_orderpriority, count(case when m = date '2001-07-01' then 1 end) as a,
      count(case when m = date '2001-06-01' then 1 end) as b,
      count(case when m = date '2001-05-01' then 1 end) as c
      from (select o_orderpriority, date_trunc('month', o_orderdate)::date as m from orders)
      group by 1)""")
def growth_and_trend(spark, folder):
    one = F.lit(1)
    counts = aggregates.pivot_periods(
        table(spark, folder, "orders"), ["o_orderpriority"], "o_orderdate", ORDERS_AS_OF,
        {"a": ([1], one), "b": ([2], one), "c": ([3], one)},
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return counts.select(
        "o_orderpriority", aggregates.growth_pct(a, b).alias("growth"),
        aggregates.trend_label(a, b, c).alias("trend"),
    )


@query("peak_groups", """
    with g as (select hour(ts) as event_hour, count(*) as peak from events group by 1)
    select event_hour, peak from g where peak = (select max(peak) from g)""")
def peak_groups(spark, folder):
    rows = table(spark, folder, "events").select(F.hour("ts").alias("event_hour"))
    return aggregates.peak_groups(rows, ["event_hour"], F.count(F.lit(1)))


@query("session_facts", f"""
    select user_id, day, min(ts) as session_start, max(ts) as session_end,
      count(*) as total_events, count(distinct k) as unique_pages_visited,
      count(case when event_type = 'purchase' then 1 end) as purchases_in_session
    from (select *, strftime(ts, '%Y-%m-%d') as day from {EVENTS}) group by 1, 2""")
def session_facts(spark, folder):
    rows = events(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return aggregates.session_facts(rows, "user_id", "day", "ts", "k", "event_type")


@query("coef_var", f"""
    select event_type, {rounded("case when avg(cents) > 0 then stddev_samp(cents) / avg(cents) * 100 end", 6)}
      as cv from {EVENTS} group by 1""")
def coef_var(spark, folder):
    return aggregates.coef_var(events(spark, folder), ["event_type"], "cents").withColumn(
        "cv", F.round("cv", 6)
    )


@query("seasonal_index", f"""
    select hour(ts) as event_hour, {rounded(f"avg(cents) / (select avg(cents) from {EVENTS})", 8)}
      as seasonal_index from {EVENTS} group by 1""")
def seasonal_index(spark, folder):
    rows = events(spark, folder).withColumn("event_hour", F.hour("ts"))
    return aggregates.seasonal_index(rows, ["event_hour"], "cents").withColumn(
        "seasonal_index", F.round("seasonal_index", 8)
    )


@query("cohort_by_month", """
    with first as (select o_custkey, min(o_orderdate) as since from orders group by 1),
      live as (select distinct o_custkey from orders where o_orderdate >= timestamp '2001-05-03')
    select strftime(since, '%Y-%m') as registration_month, count(live.o_custkey) as active_users,
      count(*) as total_registered_users,
      """ + rounded("count(live.o_custkey) * 100::double / count(*)", 2) + """ as retention_rate
    from first left join live on first.o_custkey = live.o_custkey group by 1""")
def cohort_by_month(spark, folder):
    orders = table(spark, folder, "orders")
    users = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    active = recent(orders, "o_orderdate", ORDERS_AS_OF, 90)
    flagged = flag_in(users, active, "o_custkey", "is_active")
    return aggregates.cohort_by_month(flagged, "o_custkey", "since", "is_active")


@query("cohort_retention", """
    with seen as (select distinct o_custkey, date_trunc('month', o_orderdate)::date as m from orders),
      first as (select o_custkey, min(m) as cohort from seen group by 1),
      counts as (select cohort, date_diff('month', cohort, m) as period_number, count(*) as active_users
        from seen join first using (o_custkey) group by 1, 2)
    select strftime(cohort, '%Y-%m') as cohort, period_number, active_users, first_value(active_users) over
      (partition by cohort order by period_number) as cohort_size,
      """ + rounded("""active_users * 100::double / first_value(active_users) over
      (partition by cohort order by period_number)""", 2) + """ as retention_rate from counts""")
def cohort_retention(spark, folder):
    out = aggregates.cohort_retention(table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    return out.withColumn("cohort", F.date_format("cohort", "yyyy-MM"))


@query("cohort_retention_weekly", """
    with seen as (select distinct user_id, date_trunc('week', ts)::date as w from events),
      first as (select user_id, min(w) as cohort from seen group by 1),
      counts as (select cohort, (date_diff('day', cohort, w) // 7)::integer as period_number,
        count(*) as active_users from seen join first using (user_id) group by 1, 2)
    select strftime(cohort, '%Y-%m-%d') as cohort, period_number, active_users, first_value(active_users)
      over (partition by cohort order by period_number) as cohort_size,
      """ + rounded("""active_users * 100::double / first_value(active_users) over
      (partition by cohort order by period_number)""", 2) + """ as retention_rate from counts""")
def cohort_retention_weekly(spark, folder):
    out = aggregates.cohort_retention(table(spark, folder, "events"), "user_id", "ts", "week")
    return out.withColumn("cohort", F.date_format("cohort", "yyyy-MM-dd"))


@query("cohort_bitmaps", SQL["cohort_retention_weekly"])
def cohort_bitmaps(spark, folder):
    """The same cohorts, week after week added to stored bitmaps."""
    rows = table(spark, folder, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    path = new_folder(spark, "cohorts")
    for week in sorted(r.week for r in rows.select("week").distinct().collect()):
        cohorts.add_period(spark, path, rows.where(F.col("week") == F.lit(week)), "user_id", str(week))
    out = cohorts.retention(spark, path, 7)
    return out.withColumn("cohort", F.date_format("cohort", "yyyy-MM-dd"))


@query("feature_adoption", """
    with usage as (select distinct event_type as feature, user_id from events),
      acts as (select distinct user_id, event_type as used from events where ts >= timestamp '2024-01-24'),
      active as (select count(distinct user_id) as total from events where ts >= timestamp '2024-01-24')
    select feature, count(acts.user_id) as adopters, any_value(total) as total_active_users,
      """ + rounded("count(acts.user_id) * 100::double / any_value(total)", 2) + """ as adoption_rate
    from usage left join acts on usage.user_id = acts.user_id and feature = used, active
    group by 1""")
def feature_adoption(spark, folder):
    rows = table(spark, folder, "events")
    lately = recent(rows, "ts", EVENTS_AS_OF, 7).withColumnRenamed("event_type", "used")
    usage = rows.withColumnRenamed("event_type", "feature")
    return aggregates.adoption(usage, lately, lately, "feature", "used", "user_id")


@query("segment_summary", """
    with first as (select user_id, min(ts)::date as since, max(ts) as last from events group by 1)
    select 'live' as segment_type, count(*) as user_count,
      avg(date_diff('day', since, date '2024-01-31')) as avg_days_since_registration
    from first where last >= timestamp '2024-01-29'
    union all select 'quiet', count(*), avg(date_diff('day', since, date '2024-01-31'))
    from first where last < timestamp '2024-01-29' and last >= timestamp '2024-01-01'""")
def segment_summary(spark, folder):
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("since"), F.max("ts").alias("last")
    )
    return aggregates.segment_summary({
        "live": recent(users, "last", EVENTS_AS_OF, 2),
        "quiet": between_ago(users, "last", EVENTS_AS_OF, 30, 2),
    }, "since", EVENTS_AS_OF)


@query("pct_of_total", """
    with g as (select o_orderpriority, count(*) as n from orders group by 1)
    select o_orderpriority, n, n * 100::double / (select sum(n) from g) as pct_of_total from g""")
def pct_of_total(spark, folder):
    counts = aggregates.count_by(table(spark, folder, "orders"), ["o_orderpriority"])
    return aggregates.pct_of_total(counts, "n")


@query("purchase_history", """
    select o_custkey, count(*) as total_purchases,
      sum(cast(round(o_totalprice * 100) as bigint))::bigint as total_spent,
      avg(cast(round(o_totalprice * 100) as bigint)) as avg_purchase_amount,
      max(o_orderdate) as last_purchase_date, min(o_orderdate) as first_purchase_date
    from orders where o_orderdate >= timestamp '2001-08-01' - interval 90 day group by 1""")
def purchase_history(spark, folder):
    orders = table(spark, folder, "orders").withColumn("amount", cents("o_totalprice"))
    return aggregates.purchase_history(
        orders, "o_custkey", "amount", "o_orderdate", ORDERS_AS_OF, 90
    )


@query("recency_counts", """
    select c_mktsegment, count(case when days <= 7 then 1 end) as recent_purchasers,
      count(case when days > 30 then 1 end) as at_risk_customers from customer left join
      (select o_custkey, date_diff('day', max(o_orderdate), timestamp '2001-08-01') as days
       from orders group by 1) on o_custkey = c_custkey group by 1""")
def recency_counts(spark, folder):
    last = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.datediff(F.lit(ORDERS_AS_OF).cast("date"), F.max("o_orderdate")).alias("days")
    )
    customers = table(spark, folder, "customer")
    joined = customers.join(last, customers.c_custkey == last.o_custkey, "left")
    return aggregates.aggregate(
        joined, ["c_mktsegment"], aggregates.recency_counts("days")
    )


@query("sort_rows", """
    select o_orderstatus, o_orderkey, o_totalprice, row_number() over
      (order by o_orderstatus, o_totalprice desc, o_orderkey) as place from orders""")
def sort_rows(spark, folder):
    """The place is where a row comes out: partition by partition, and in it row by row."""
    out = sets.sort(
        table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"),
        ["o_orderstatus", F.desc("o_totalprice"), "o_orderkey"],
    ).withColumn("__at", F.monotonically_increasing_id())
    return ordered.numbered(out, [], ["__at"], "place").drop("__at")


@query("limit_rows", """
    select least(count(*), 100) as n, least(count(*), 100) as known from lineitem""")
def limit_rows(spark, folder):
    """Any 100 rows, each of them a row of the table."""
    items = table(spark, folder, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    out = sets.limit(items.select(*keys), 100)
    known = items.select(*keys, F.lit(1).alias("known")).distinct()
    return out.join(known, keys, "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("known").alias("known")
    )


@query("top_n_per_group", """
    select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over
      (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders)
    where rn <= 5""")
def top_n_per_group(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return sets.top_n(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("top_n_overall", """
    select l_orderkey, l_linenumber, l_extendedprice from lineitem
    order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 10""")
def top_n_overall(spark, folder):
    rows = table(spark, folder, "lineitem")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"),
             F.asc("l_partkey")]
    return sets.top_n(rows, [], order, 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("merge_tagged", """
    select event_id, user_id, 'shop' as origin from events where event_type = 'purchase'
    union all select event_id, user_id, 'web' from events where event_type <> 'purchase'""")
def merge_tagged(spark, folder):
    rows = table(spark, folder, "events")
    cols = ["event_id", "user_id"]
    return sets.merge_tagged({
        "shop": rows.where("event_type = 'purchase'").select(*cols),
        "web": rows.where("event_type <> 'purchase'").select(*cols),
    }, "origin")


@query("union_all", """
    select c_nationkey as nation, c_acctbal as balance from customer
    union all select s_nationkey, s_acctbal from supplier""")
def union_all(spark, folder):
    people = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    firms = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return sets.union_all([people, firms])


def _active(spark, folder):
    rows = table(spark, folder, "events")
    late = recent(rows, "ts", EVENTS_AS_OF, 4).select("user_id", "event_type")
    early = between_ago(rows, "ts", EVENTS_AS_OF, 14, 4).select("user_id", "event_type")
    return early, late


ACTIVE = """with early as (select user_id, event_type from events where
      ts >= timestamp '2024-01-17' and ts < timestamp '2024-01-27'),
    late as (select user_id, event_type from events where ts >= timestamp '2024-01-27') """


def _halves(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    columns = ["user_id", "event_type"]
    return rows.where(early).select(*columns), rows.where(~early).select(*columns)


HALVES = """with early as (select user_id, event_type from events where ts < timestamp '2024-01-16'),
    late as (select user_id, event_type from events where ts >= timestamp '2024-01-16') """


@query("union_distinct", HALVES + "select * from early union select * from late")
def union_distinct(spark, folder):
    return sets.set_op(*_halves(spark, folder), "union")


@query("intersect_distinct", HALVES + "select * from early intersect select * from late")
def intersect_distinct(spark, folder):
    return sets.set_op(*_halves(spark, folder), "intersect")


@query("except_users", ACTIVE + "select * from early except select * from late")
def except_users(spark, folder):
    return sets.set_op(*_active(spark, folder), "except")
