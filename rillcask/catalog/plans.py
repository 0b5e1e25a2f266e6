"""The composite analyses over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS, EVENTS_AS_OF, ORDERS_AS_OF, cents, events, query, rounded, table
from rillcask.plans import (
    customer_journey as journey, event_processing as nested_events, product_analytics as products,
    sales_pivot as sales, shipped_orders as shipping, temporal_analytics as temporal,
    traffic_kpis as traffic, user_risk as risk, user_segments as segments,
)
from rillcask.streaming import sinks

# Orders end on 2001-08-01; moved by this many days they end with the events.
ORDER_SHIFT = 8218


def _web_events(spark, folder):
    return events(spark, folder).select(
        F.col("user_id").alias("customer_id"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("ts").alias("event_timestamp"), "event_type", F.col("k").alias("page_url"),
    )


def _profiles(spark, folder):
    balance = F.col("c_acctbal")
    tier = F.when(balance < 1000, "bronze").when(balance < 5000, "silver").otherwise("gold")
    age = (F.col("c_custkey") * 13 % 700).cast("int")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), tier.alias("membership_tier"),
        F.col("c_nationkey").alias("location"),
        F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), age).alias("registration_date"),
    )


def _purchases(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"), cents("o_totalprice").alias("amount"),
        F.date_add("o_orderdate", ORDER_SHIFT).alias("purchase_date"),
    )


METRICS = f"""
    with s as (select user_id, strftime(ts, '%Y%m%d') as sid, count(*) as total_events,
        count(case when event_type = 'purchase' then 1 end) as bought
      from events where ts >= timestamp '2024-01-24' group by 1, 2),
    cu as (select user_id, count(distinct sid) as total_sessions, avg(total_events) as avg_events,
        sum(bought)::bigint as web from s group by 1),
    seg as (select c_custkey, case when c_acctbal < 1000 then 'bronze' when c_acctbal < 5000
        then 'silver' else 'gold' end as membership_tier, c_nationkey as location,
        case when (c_custkey * 13) % 700 <= 30 then 'new' when (c_custkey * 13) % 700 <= 365
        then 'regular' else 'veteran' end as customer_segment from customer),
    h as (select o_custkey, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint))::bigint
        as spent, avg(cast(round(o_totalprice * 100) as bigint)) as mean,
        max((o_orderdate + interval {ORDER_SHIFT} day)::date) as last from orders
      where o_orderdate + interval {ORDER_SHIFT} day >= timestamp '2024-01-31' - interval 90 day
      group by 1),
    m as (select user_id as customer_id, customer_segment, membership_tier, location, total_sessions,
        avg_events as avg_events_per_session, web as total_web_purchases,
        coalesce(n, 0) as total_purchases, coalesce(spent, 0) as total_spent,
        coalesce(mean, 0) as avg_purchase_amount,
        date_diff('day', last, date '2024-01-31') as days_since_last_purchase
      from cu left join seg on user_id = c_custkey left join h on user_id = o_custkey) """


@query("customer_metrics", METRICS + "select * from m")
def customer_metrics(spark, folder):
    return journey.customer_metrics(
        _web_events(spark, folder), _profiles(spark, folder), _purchases(spark, folder),
        EVENTS_AS_OF,
    )


@query("customer_journey", METRICS + f"""
    select customer_segment, membership_tier, location, count(*) as customer_count,
      avg(total_sessions) as avg_sessions,
      {rounded("avg(avg_events_per_session)", 6)} as avg_events_per_session,
      avg(total_spent) as avg_total_spent, quantile_disc(total_spent, 0.5) as median_total_spent,
      count(case when days_since_last_purchase <= 7 then 1 end) as recent_purchasers,
      count(case when days_since_last_purchase > 30 then 1 end) as at_risk_customers
    from m group by 1, 2, 3""")
def customer_journey(spark, folder):
    out = journey.customer_journey(
        _web_events(spark, folder), _profiles(spark, folder), _purchases(spark, folder),
        EVENTS_AS_OF,
    )
    return out.withColumn("avg_events_per_session", F.round("avg_events_per_session", 6))


@query("product_analytics", f"""
    select k as product_id, event_type as category, ts as event_timestamp, user_id, event_type,
      cents as revenue, event_id,
      row_number() over (partition by k order by ts desc, event_id desc) as latest_event_rank,
      lag(cents, 1) over (partition by k order by ts, event_id) as prev_revenue,
      sum(cents) over (partition by k order by ts, event_id rows between 6 preceding and current row)
        ::bigint as rolling_7day_revenue,
      rank() over (partition by event_type order by cents desc) as revenue_rank_in_category,
      strftime(ts, '%Y-%m-%d') as event_date, hour(ts) as event_hour, dayofweek(ts) + 1 as day_of_week,
      case when event_type = 'purchase' then cents else 0 end as purchase_revenue,
      case when hour(ts) between 9 and 17 then 'business_hours' else 'off_hours' end as time_category
    from {EVENTS} where ts >= timestamp '2024-01-31' - interval 30 day and cents > 0""")
def product_analytics(spark, folder):
    rows = events(spark, folder).select(
        F.col("k").alias("product_id"), F.col("event_type").alias("category"),
        F.col("ts").alias("event_timestamp"), "user_id", "event_type",
        F.col("cents").alias("revenue"), "event_id",
    )
    return products.product_analytics(rows, EVENTS_AS_OF, "event_id")


def _raw_events(spark, folder):
    k = F.col("k")
    tags = F.when(F.col("value") > 100, F.array(F.lit("premium"), F.col("event_type"))).when(
        k < 50, F.array(F.lit("vip"))
    ).otherwise(F.array().cast("array<string>"))
    fields = F.when(
        k < 30, F.create_map(F.lit("source"), F.col("event_type"), F.lit("campaign_id"),
                             k.cast("string"))
    ).otherwise(F.create_map(F.lit("source"), F.lit("direct")))
    metadata = F.struct(
        F.struct(
            F.when(k % 2 == 0, "ios").otherwise("android").alias("os"), F.lit("web").alias("browser")
        ).alias("device_info"),
        F.struct(
            F.concat(F.lit("country-"), (k % 7).cast("string")).alias("country"),
            F.concat(F.lit("city-"), k.cast("string")).alias("city"),
        ).alias("location"),
    )
    raw = F.concat(
        F.lit('{"user": {"preferences": {"language": "'), F.col("event_type"),
        F.lit('"}}, "session": {"duration": '), k.cast("string"), F.lit("}}"),
    )
    properties = F.struct(tags.alias("tags"), fields.alias("custom_fields"))
    return events(spark, folder).select(
        "event_id", "user_id", F.col("ts").alias("event_timestamp"), "event_type",
        F.when(F.col("event_type") != "error", properties).alias("event_properties"),
        metadata.alias("event_metadata"), raw.alias("raw_event_data"),
    )


@query("event_processing", f"""
    select event_id, user_id, ts as event_timestamp, event_type,
      case when value > 100 then 2 when k < 50 then 1 else 0 end as tag_count,
      value > 100 as has_premium_tag,
      case when value > 100 then 'premium|' || event_type when k < 50 then 'vip' else '' end
        as all_tags,
      case when value > 100 then 'premium' when k < 50 then 'vip' end as first_tag,
      case when k % 2 = 0 then 'ios' else 'android' end as device_os, 'web' as device_browser,
      country as user_country, 'city-' || k::varchar as user_city,
      case when k < 30 then k::varchar end as campaign_id,
      case when k < 30 then event_type else 'direct' end as traffic_source,
      case when k < 30 then 'campaign_id,source' else 'source' end as custom_field_keys,
      case when k < 30 then k::varchar || ',' || event_type else 'direct' end as custom_field_values,
      event_type as user_language, k::varchar as session_duration,
      case when value > 100 then 'premium,' || event_type when k < 50 then 'vip' else '' end
        as tags_concatenated,
      case when value > 100 then 'premium|' || event_type when k < 50 then 'vip' else '' end
        as tags_pipe_separated,
      case when value <= 100 and k < 50 then country else 'unknown' end as vip_user_country,
      array_to_string(list(event_type) over (w rows between 4 preceding and current row), ',')
        as recent_event_types,
      array_to_string(list_sort(list_distinct(list(country) over (w rows between unbounded preceding
        and current row))), ',') as all_user_countries
    from (select *, 'country-' || (k % 7)::varchar as country from {EVENTS}
      where ts >= timestamp '2024-01-20' - interval 1 day and event_type <> 'error')
    window w as (partition by user_id order by ts, event_id)""")
def event_processing(spark, folder):
    out = nested_events.event_processing(_raw_events(spark, folder), "2024-01-20")
    arrays = ["custom_field_keys", "custom_field_values", "recent_event_types",
              "all_user_countries"]
    return out.withColumn("all_tags", F.array_join("all_tags", "|")).withColumns(
        {name: F.array_join(name, ",") for name in arrays}
    )


@query("sales_pivot", f"""
    with monthly as (select p_type as product_category, o_orderpriority as region,
        date_trunc('month', o_orderdate)::date as m,
        sum(cast(round(l_extendedprice * 100) as bigint))::bigint as c
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
      where o_orderdate >= timestamp '2000-08-01' group by 1, 2, 3),
    p as (select product_category, region,
        sum(case when m = date '2001-07-01' then c else 0 end)::bigint as a,
        sum(case when m = date '2001-06-01' then c else 0 end)::bigint as b,
        sum(case when m = date '2001-05-01' then c else 0 end)::bigint as d,
        sum(case when m between date '2001-05-01' and date '2001-07-01' then c else 0 end)::bigint as q,
        sum(case when m between date '2001-02-01' and date '2001-04-01' then c else 0 end)::bigint as r,
        sum(case when m = date '2000-08-01' then c else 0 end)::bigint as y
      from monthly group by 1, 2),
    g as (select *, case when b > 0 then (a - b) * 100::double / b end as mom,
        case when r > 0 then (q - r) * 100::double / r end as qoq,
        case when y > 0 then (a - y) * 100::double / y end as yoy,
        case when a > b and b > d then 'upward_trend' when a < b and b < d then 'downward_trend'
          else 'mixed_trend' end as revenue_trend,
        rank() over (partition by product_category order by a desc) as rk,
        percent_rank() over (partition by product_category order by a) as pr from p)
    select product_category, region, a as last_month_revenue, {rounded("mom", 2)} as mom_growth_percent,
      {rounded("qoq", 2)} as qoq_growth_percent, {rounded("yoy", 2)} as yoy_growth_percent,
      revenue_trend, rk as revenue_rank_in_category,
      {rounded("pr * 100", 1)} as revenue_percentile_in_category,
      case when mom > 10 then 'high_growth' when mom > 0 then 'positive_growth'
        when mom > -10 then 'slight_decline' else 'significant_decline' end as performance_indicator
    from g where a > 0""")
def sales_pivot(spark, folder):
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    parts = table(spark, folder, "part")
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("p_type").alias("product_category"), F.col("o_orderpriority").alias("region"),
        cents("l_extendedprice").alias("sale_amount"), F.col("o_orderdate").alias("sale_date"),
    )
    return sales.sales_pivot(sold, ORDERS_AS_OF)


def _traffic(spark, folder):
    return traffic_columns(events(spark, folder))


def traffic_columns(rows):
    """Events, from a table or a stream, in the shape of web traffic."""
    k, kind = F.col("k"), F.col("event_type")
    return rows.select(
        F.col("ts").alias("event_timestamp"),
        F.when(k < 30, "new").otherwise("known").alias("user_segment"),
        F.when(kind == "view", "page_view").when(kind == "click", "add_to_cart").otherwise(
            F.when(kind == "error", "page_view").otherwise(kind)).alias("event_type"),
        F.when(F.col("user_id") % 2 == 0, "web").otherwise("app").alias("source_system"), "user_id",
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("cents").alias("revenue_amount"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.col("cents").alias("response_time_ms"), (k % 10).alias("geo_country"),
        k.alias("geo_city"),
        F.when(k < 40, "mobile").when(k < 80, "desktop").otherwise("tablet").alias("device_type"),
        F.when(k % 4 == 0, "organic").when(k % 4 == 1, "paid").when(k % 4 == 2, "social")
        .otherwise("direct").alias("traffic_source"),
    )


TRAFFIC = f"""
    with e as (select *, case when k < 30 then 'new' else 'known' end as user_segment,
        case event_type when 'view' then 'page_view' when 'error' then 'page_view'
          when 'click' then 'add_to_cart' else event_type end as kind,
        case when user_id % 2 = 0 then 'web' else 'app' end as source_system,
        time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as window_start from {EVENTS}),
    g as (select window_start, window_start + interval 6 hour as window_end, user_segment,
        kind as event_type, source_system, count(*) as event_count,
        count(distinct user_id) as unique_users,
        count(distinct user_id::varchar || strftime(ts, '-%Y%m%d')) as unique_sessions,
        sum(case when kind = 'purchase' then cents else 0 end)::bigint as total_revenue,
        avg(case when kind = 'purchase' then cents end) as avg_purchase_amount,
        max(case when kind = 'purchase' then cents end) as max_purchase_amount,
        count(case when kind = 'page_view' then 1 end) as page_views,
        count(case when kind = 'add_to_cart' then 1 end) as add_to_cart_events,
        count(case when kind = 'purchase' then 1 end) as purchase_events,
        count(case when event_type = 'error' then 1 end) as error_count,
        avg(cents) as avg_response_time, quantile_disc(cents, 0.5) as median_response_time,
        quantile_disc(cents, 0.95) as p95_response_time,
        quantile_disc(cents, 0.99) as p99_response_time,
        count(distinct k % 10) as unique_countries, count(distinct k) as unique_cities,
        count(case when k < 40 then 1 end) as mobile_events,
        count(case when k >= 40 and k < 80 then 1 end) as desktop_events,
        count(case when k >= 80 then 1 end) as tablet_events,
        count(distinct k % 4) as unique_traffic_sources,
        count(case when k % 4 = 0 then 1 end) as organic_traffic,
        count(case when k % 4 = 1 then 1 end) as paid_traffic,
        count(case when k % 4 = 2 then 1 end) as social_traffic
      from e group by 1, 2, 3, 4, 5)
    select *, case when page_views > 0 then add_to_cart_events * 100::double / page_views else 0 end
        as page_to_cart_conversion_rate,
      case when add_to_cart_events > 0 then purchase_events * 100::double / add_to_cart_events
        else 0 end as cart_to_purchase_conversion_rate,
      error_count * 100::double / event_count as error_rate_percent,
      hour(window_start) as window_hour, dayofweek(window_start) + 1 as window_day_of_week,
      case when event_count > avg(event_count) over w * 2 then 'HIGH_TRAFFIC_SPIKE'
        when event_count < avg(event_count) over w * 0.5 then 'LOW_TRAFFIC_DROP' else 'NORMAL' end
        as traffic_anomaly_indicator
    from g window w as (partition by user_segment, event_type, source_system order by window_start
      rows between 11 preceding and 1 preceding)"""


@query("traffic_kpis", TRAFFIC)
def traffic_kpis(spark, folder):
    return traffic.traffic_kpis(_traffic(spark, folder), "6 hours")


def _acts(spark, folder):
    key = F.col("o_custkey")
    registered = F.date_sub(
        F.lit(ORDERS_AS_OF).cast("date"), (key * 7 % 500).cast("int")
    ).cast("timestamp_ntz")
    return table(spark, folder, "orders").select(
        key.alias("user_id"), F.concat(F.lit("u"), key.cast("string")).alias("email"),
        registered.alias("registration_date"), F.col("o_orderdate").alias("last_activity_date"),
    )


@query("user_segments", f"""
    with ua as (select o_custkey as user_id, (o_custkey * 7) % 500 as age,
        timestamp '2001-08-01' - to_days(((o_custkey * 7) % 500)::integer) as reg, o_orderdate as last
      from orders),
    cur as (select distinct user_id, age, reg, last from ua
      where last >= timestamp '2001-08-01' - interval 30 day),
    his as (select distinct user_id, age, reg, last from ua
      where last >= timestamp '2001-08-01' - interval 90 day
        and last < timestamp '2001-08-01' - interval 30 day),
    seg as (select 'new_users' as segment_type, count(*) as user_count, avg(age) as days from cur
        where reg >= timestamp '2001-08-01' - interval 30 day
      union all select 'churned_users', count(*), avg(age) from his
        where user_id not in (select user_id from cur)
      union all select 'retained_users', count(*), avg(his.age) from his join cur using (user_id)
      union all select 'reactivated_users', count(*), avg(age) from cur where user_id in (
        select user_id from ua where last < timestamp '2001-08-01' - interval 60 day
        and user_id not in (select user_id from ua where last between
          timestamp '2001-08-01' - interval 60 day and timestamp '2001-08-01' - interval 30 day))),
    coh as (select strftime(reg, '%Y-%m') as m, count(distinct case when user_id in
        (select user_id from cur) then user_id end) as a, count(distinct user_id) as t
      from ua where reg >= timestamp '2000-08-01' group by 1)
    select segment_type, user_count, {rounded("days", 1)} as avg_days_since_registration,
      {rounded("user_count * 100::double / nullif((select sum(user_count) from seg), 0)", 2)}
        as percentage_of_total from seg
    union all select 'cohort_' || m, a, null, {rounded("a * 100::double / t", 2)} from coh""")
def user_segments(spark, folder):
    return segments.user_segments(_acts(spark, folder), ORDERS_AS_OF)


def _user_events(spark, folder):
    return events(spark, folder).select(
        "user_id", F.col("ts").alias("event_timestamp"), "event_type",
        F.col("cents").alias("revenue_amount"),
    )


TEMPORAL = f"""
    with base as (select *, ts::date as day, hour(ts) as event_hour, dayofweek(ts) + 1 as dow,
        case when dayofweek(ts) in (0, 6) then 'weekend' when hour(ts) between 9 and 17
          then 'business_hours' else 'after_hours' end as time_category,
        case when month(ts) in (12, 1, 2) then 'winter' when month(ts) in (3, 4, 5) then 'spring'
          when month(ts) in (6, 7, 8) then 'summer' else 'fall' end as season
      from {EVENTS} where ts >= timestamp '2024-01-31' - interval 90 day),
    hourly as (select event_hour, dow, time_category, count(*) as event_count,
        count(distinct user_id) as unique_users,
        sum(case when event_type = 'purchase' then cents else 0 end)::bigint as hourly_revenue,
        avg(case when event_type = 'purchase' then cents end) as avg_purchase_amount,
        count(case when event_type = 'view' then 1 end) as page_views,
        count(case when event_type = 'purchase' then 1 end) as purchases from base group by 1, 2, 3),
    daily as (select day, dow, season, month(day) as event_month, count(*) as daily_events,
        count(distinct user_id) as daily_active_users,
        sum(case when event_type = 'purchase' then cents else 0 end)::bigint as daily_revenue
      from base group by 1, 2, 3, 4),
    trends as (select *, avg(daily_events) over w as rolling_7day_avg_events,
        avg(daily_revenue) over w as rolling_7day_avg_revenue,
        lag(daily_events, 1) over (order by day) as prev_day_events,
        lag(daily_events, 7) over (order by day) as same_day_last_week_events,
        lag(daily_revenue, 1) over (order by day) as prev_day_revenue
      from daily window w as (order by day rows between 6 preceding and current row)),
    growth as (select *, case when prev_day_events > 0 then (daily_events - prev_day_events)
        * 100::double / prev_day_events end as day_over_day_growth,
        case when same_day_last_week_events > 0 then (daily_events - same_day_last_week_events)
        * 100::double / same_day_last_week_events end as week_over_week_growth from trends) """


@query("hourly_patterns", TEMPORAL + """
    select event_hour, dow as day_of_week, time_category, event_count, unique_users, hourly_revenue,
      avg_purchase_amount, page_views, purchases,
      case when page_views > 0 then purchases * 100::double / page_views else 0 end as conversion_rate,
      rank() over (partition by dow order by event_count desc) as hourly_rank_by_day,
      percent_rank() over (order by event_count) as activity_percentile from hourly""")
def hourly_patterns(spark, folder):
    base = temporal.time_series_base(_user_events(spark, folder), EVENTS_AS_OF)
    return temporal.hourly_patterns(base, "view")


@query("temporal_daily", TEMPORAL + """
    select strftime(day, '%Y-%m-%d') as event_date, dow as day_of_week, season, event_month,
      daily_events, daily_active_users, daily_revenue, rolling_7day_avg_events,
      rolling_7day_avg_revenue, prev_day_events, same_day_last_week_events, prev_day_revenue,
      day_over_day_growth, week_over_week_growth from growth""")
def temporal_daily(spark, folder):
    base = temporal.time_series_base(_user_events(spark, folder), EVENTS_AS_OF)
    daily = temporal.daily_trends(base)
    return daily.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query("seasonality", TEMPORAL + f"""
    select season, event_month, avg(daily_events) as avg_daily_events,
      avg(daily_revenue) as avg_daily_revenue, {rounded("stddev_samp(daily_events)", 6)}
        as stddev_daily_events, {rounded("stddev_samp(daily_revenue)", 4)} as stddev_daily_revenue,
      {rounded("case when avg(daily_events) > 0 then stddev_samp(daily_events) / avg(daily_events) * 100 end", 6)}
        as events_coefficient_of_variation,
      avg(daily_events) / (select avg(daily_events) from daily) as seasonal_index_events,
      avg(daily_revenue) / (select avg(daily_revenue) from daily where daily_revenue > 0)
        as seasonal_index_revenue
    from daily group by 1, 2""")
def seasonality(spark, folder):
    base = temporal.time_series_base(_user_events(spark, folder), EVENTS_AS_OF)
    out = temporal.seasonality(temporal.daily_trends(base))
    return out.withColumns({
        "stddev_daily_events": F.round("stddev_daily_events", 6),
        "stddev_daily_revenue": F.round("stddev_daily_revenue", 4),
        "events_coefficient_of_variation": F.round("events_coefficient_of_variation", 6),
    })


@query("temporal_analytics", TEMPORAL + f"""
    , top as (select event_hour, max(event_count) as n from hourly where dow between 2 and 6 group by 1)
    select 'hourly_peak_analysis' as analysis_type, event_hour::varchar as time_dimension,
      n::varchar as metric_value, 'Peak hour activity' as description from top
      where n = (select max(n) from top)
    union all select 'seasonality_analysis', season, {rounded("avg(idx)", 3)}::varchar,
      'Seasonal activity index' from (select season, event_month, avg(daily_events) /
        (select avg(daily_events) from daily) as idx from daily group by 1, 2) group by season
    union all select 'growth_trends', 'week_over_week',
      {rounded("avg(week_over_week_growth)", 2)}::varchar, 'Average weekly growth rate'
      from growth where week_over_week_growth is not null""")
def temporal_analytics(spark, folder):
    return temporal.temporal_analytics(
        _user_events(spark, folder), EVENTS_AS_OF, view="view"
    )


def _transactions(spark, folder):
    kind, k = F.col("event_type"), F.col("k")
    meta = F.concat(
        F.lit('{"device": {"fingerprint": "d'), k.cast("string"),
        F.lit('"}, "location": {"ip_address": "10.0.0.'), k.cast("string"),
        F.lit('"}, "risk_scores": {"fraud_score": 0.'), F.lpad(k.cast("string"), 2, "0"),
        F.lit('}, "tags": "a,b"}'),
    )
    return events(spark, folder).select(
        F.col("event_id").alias("transaction_id"), "user_id", k.alias("product_id"),
        F.col("ts").alias("transaction_timestamp"), F.col("cents").cast("double").alias("amount"),
        # the pound's rate is a binary fraction, so sums are exact in any order
        F.when(kind == "view", "GBP").otherwise("USD").alias("currency"),
        F.concat(kind, F.lit(" & co")).alias("merchant_category"),
        F.lit("card").alias("payment_method"), meta.alias("transaction_metadata"),
    )


FRAUD = f"""
    with t as (select event_id as transaction_id, user_id, ts, cents::double as amount,
        event_type || '___co' as merchant, k, k / 100.0::double as score,
        case event_type when 'view' then cents * 1.25::double else cents::double end as usd,
        case when k > 80 then 'high_risk' when k > 50 then 'medium_risk' else 'low_risk' end as risk
      from {EVENTS} where ts >= timestamp '2024-01-31' - interval 30 day),
    f as (select *, count(*) over (w rows between 6 preceding and current row) as n7,
        sum(usd) over (w rows between 6 preceding and current row) as s7,
        avg(usd) over (w rows between 29 preceding and current row) as m30,
        stddev_samp(usd) over (w rows between 29 preceding and current row) as sd30,
        len(list_distinct(list(merchant) over (w rows between 29 preceding and current row))) as mer30,
        date_diff('day', lag(ts) over w, ts) as gap_days,
        (epoch_us(ts) // 1000000 - epoch_us(lag(ts) over w) // 1000000) / 3600.0::double as gap_hours,
        case when hour(ts) >= 22 or hour(ts) <= 6 then 1 else 0 end as late,
        case when dayofweek(ts) in (0, 6) then 1 else 0 end as weekend,
        dense_rank() over (order by merchant) as code,
        case when usd > avg(usd) over (partition by merchant) * 3 then 1 else 0 end as large
      from t window w as (partition by user_id order by ts, transaction_id)),
    g as (select *, case when sd30 > 0 then (usd - m30) / sd30 else 0 end as z,
        sum(late) over (partition by user_id order by ts, transaction_id
          rows between 29 preceding and current row)::bigint as late30 from f) """


@query("fraud_features", FRAUD + f"""
    select transaction_id, user_id, 'd' || k::varchar as device_fingerprint,
      '10.0.0.' || k::varchar as ip_address, merchant as clean_merchant_category,
      risk as risk_category, {rounded("usd", 4)} as amount_usd,
      ntile(10) over (partition by merchant order by amount, transaction_id) as amount_decile,
      percent_rank() over (partition by user_id order by ts) as user_transaction_percentile,
      n7 as transactions_last_7, {rounded("s7", 4)} as spending_last_7,
      {rounded("m30", 4)} as avg_spending_30d, {rounded("sd30", 4)} as stddev_spending_30d,
      mer30 as unique_merchants_30d, late30 as late_night_transactions_30d,
      gap_days as days_since_last_transaction, gap_hours as hours_since_last_transaction,
      {rounded("z", 4)} as amount_zscore, code as merchant_category_encoded, late as is_late_night,
      weekend as is_weekend, large as is_large_amount from g""")
def fraud_features(spark, folder):
    out = risk.fraud_features(_transactions(spark, folder), EVENTS_AS_OF)
    money = ["amount_usd", "spending_last_7", "avg_spending_30d", "stddev_spending_30d",
             "amount_zscore"]
    return out.select(
        "transaction_id", "user_id", "device_fingerprint", "ip_address",
        "clean_merchant_category", "risk_category", "amount_decile",
        "user_transaction_percentile", "transactions_last_7", "unique_merchants_30d",
        "late_night_transactions_30d", "days_since_last_transaction",
        "hours_since_last_transaction", "merchant_category_encoded", "is_late_night",
        "is_weekend", "is_large_amount", *[F.round(c, 4).alias(c) for c in money],
    )


@query("user_risk", FRAUD + f"""
    , m as (select *, case when usd < 10 then 'micro' when usd < 100 then 'small'
        when usd < 1000 then 'medium' when usd < 10000 then 'large' else 'very_large' end as bucket,
        case when risk = 'high_risk' and late = 1 then 'high_risk_night'
          when risk = 'high_risk' and weekend = 1 then 'high_risk_weekend'
          when risk = 'medium_risk' and large = 1 then 'medium_risk_large'
          else risk || '_normal' end as composite,
        case when sd30 > 0 then abs(z) else 0 end as deviation,
        case when gap_hours < 1 and usd > m30 * 2 then 1 else 0 end as rapid from g),
    u as (select user_id, count(*) as n, sum(usd) as total, avg(usd) as mean, stddev_samp(usd) as sd,
        count(case when risk = 'high_risk' then 1 end) as high, avg(deviation) as anomaly,
        avg(rapid) as rapid_rate, count(distinct bucket) as buckets,
        count(distinct composite) as patterns, avg(late30) as late_mean,
        stddev_samp(gap_days) as timing from m group by 1 having count(*) >= 5)
    select user_id, n as total_transactions, {rounded("total", 2)} as total_spending,
      {rounded("mean", 2)} as avg_transaction_amount, {rounded("sd", 2)} as spending_volatility,
      high as high_risk_transactions, {rounded("anomaly", 3)} as avg_anomaly_score,
      {rounded("rapid_rate", 3)} as rapid_spending_rate, buckets as spending_diversity,
      patterns as risk_pattern_diversity,
      case when high > n * 0.3 and anomaly > 1.5 then 'user_high_risk'
        when rapid_rate > 0.1 and sd > mean then 'user_medium_risk' else 'user_low_risk' end
        as final_user_risk_category,
      case when buckets <= 2 and timing < 1 then 'routine_spender'
        when buckets > 4 and late_mean > 2 then 'diverse_night_spender'
        when mean > 1000 and n < 10 then 'high_value_occasional' else 'regular_spender' end
        as spending_behavior_type from u""")
def user_risk(spark, folder):
    return risk.user_risk(_transactions(spark, folder), EVENTS_AS_OF)


def _shipping(spark, folder, streaming=False):
    if streaming:
        from rillcask.catalog.streams import table_stream

        orders = table_stream(spark, folder, "orders")
        items = table_stream(spark, folder, "lineitem")
    else:
        orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    orders = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("order_time"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_custkey").cast("string").alias("customer_name"),
    )
    ships = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
            "shipment_id"
        ),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_shipdate") + F.expr("INTERVAL 90 MINUTE")).cast("timestamp").alias("ship_time"),
        F.concat(F.lit("W"), F.col("l_suppkey").cast("string")).alias("warehouse"),
    )
    return shipping.shipped_orders(orders, ships)


SHIPPED = """
    select o_orderkey as order_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as order_ts,
      o_totalprice as total_amount, o_custkey::varchar as customer_name,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as shipment_id,
      strftime(l_shipdate + interval 90 minute, '%Y-%m-%d %H:%M:%S') as shipment_ts,
      'W' || l_suppkey::varchar as warehouse,
      date_diff('minute', o_orderdate, l_shipdate + interval 90 minute) as ship_minutes
    from orders join lineitem on o_orderkey = l_orderkey
      and l_shipdate + interval 90 minute between o_orderdate - interval 7 day
        and o_orderdate + interval 7 day"""


@query("shipped_orders", SHIPPED)
def shipped_orders(spark, folder):
    return _shipping(spark, folder)


@query("stream_shipped_orders", SHIPPED)
def stream_shipped_orders(spark, folder):
    return sinks.run_append(_shipping(spark, folder, streaming=True), "shipped")
