"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS_AS_OF, ORDERS_AS_OF, query, rounded, table
from rillcask.functions.numbers import geo_distance
from rillcask.operators import joins, patterns
from rillcask.operators.rows import between_ago, prefix_columns, recent


def _kind(spark, folder, kind, prefix):
    rows = table(spark, folder, "events").where(F.col("event_type") == kind)
    return prefix_columns(rows.select("event_id", "user_id", "ts"), prefix)


PAIR = """select c.event_id as c_event_id, p.event_id as p_event_id from
    (select * from events where event_type = 'click') c {how} join
    (select * from events where event_type = 'purchase') p
    on c.user_id = p.user_id and p.ts {bounds}"""


@query("interval_join", PAIR.format(
    how="", bounds="between c.ts - interval 6 hour and c.ts + interval 6 hour"))
def interval_join(spark, folder):
    return joins.interval_join(
        _kind(spark, folder, "click", "c_"), _kind(spark, folder, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "6 hours", "6 hours", "2 seconds",
    ).select("c_event_id", "p_event_id")


@query("interval_join_left", PAIR.format(
    how="left", bounds="between c.ts and c.ts + interval 1 hour"))
def interval_join_left(spark, folder):
    return joins.interval_join(
        _kind(spark, folder, "click", "c_"), _kind(spark, folder, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "0 hours", "1 hour", how="left",
    ).select("c_event_id", "p_event_id")


@query("theta_join", PAIR.format(how="", bounds="between c.ts - interval 6 hour and c.ts"))
def theta_join(spark, folder):
    return joins.interval_join(
        _kind(spark, folder, "click", "c_"), _kind(spark, folder, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "6 hours", "0 hours",
    ).select("c_event_id", "p_event_id")


@query("ttl_join", PAIR.format(
    how="", bounds="between c.ts - interval 2 hour and c.ts + interval 24 hour"))
def ttl_join(spark, folder):
    """Clicks live a day, purchases two hours."""
    return joins.ttl_join(
        _kind(spark, folder, "click", "c_"), _kind(spark, folder, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "24 hours", "2 hours",
    ).select("c_event_id", "p_event_id")


@query("stream_table_lookup", """
    select event_id, user_id, c_name, c_mktsegment from events left join
      (select * from customer where c_acctbal > 0) on user_id = c_custkey""")
def stream_table_lookup(spark, folder):
    known = table(spark, folder, "customer").where("c_acctbal > 0")
    return joins.enrich(
        table(spark, folder, "events"), known, [("user_id", "c_custkey")]
    ).select("event_id", "user_id", "c_name", "c_mktsegment")


@query("asof_join", """
    select p.event_id as p_event_id, v.event_id as v_event_id, v.ts as v_ts from
      (select * from events where event_type = 'purchase') p asof left join
      (select * from events where event_type = 'view') v
      on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_join(spark, folder):
    return joins.asof_join(
        _kind(spark, folder, "purchase", "p_"), _kind(spark, folder, "view", "v_"),
        [("p_user_id", "v_user_id")], "p_ts", "v_ts", "v_event_id",
    ).select("p_event_id", "v_event_id", "v_ts")


@query("asof_join_next", """
    select c.event_id as c_event_id, p.event_id as p_event_id from
      (select * from events where event_type = 'click') c asof left join
      (select * from events where event_type = 'purchase') p
      on c.user_id = p.user_id and c.ts < p.ts""")
def asof_join_next(spark, folder):
    return joins.asof_join(
        _kind(spark, folder, "click", "c_"), _kind(spark, folder, "purchase", "p_"),
        [("c_user_id", "p_user_id")], "c_ts", "p_ts", "p_event_id", forward=True, strict=True,
    ).select("c_event_id", "p_event_id")


@query("join_tables", """
    select p_partkey, p_brand, l_orderkey, l_linenumber, l_quantity
    from part join lineitem on l_partkey = p_partkey""")
def join_tables(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    items = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    return joins.join_tables(parts, items, ["p_partkey"])


@query("enrich_many", """
    select o_orderkey, o_custkey, c_name, n_name, r_name from orders
    left join customer on o_custkey = c_custkey and c_acctbal > 0
    left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def enrich_many(spark, folder):
    customers = table(spark, folder, "customer").where("c_acctbal > 0")
    return joins.enrich_many(table(spark, folder, "orders"), [
        (customers, [("o_custkey", "c_custkey")]),
        (table(spark, folder, "nation"), [("c_nationkey", "n_nationkey")]),
        (table(spark, folder, "region"), [("n_regionkey", "r_regionkey")]),
    ]).select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name")


@query("nearest_center", f"""
    select c_custkey as cus_c_custkey, c_nationkey as cus_c_nationkey, n_name as ctr_n_name,
      {rounded('''2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) +
        cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))''', 3)}
        as distance_km
    from (select *, c_acctbal / 200 as lat1, c_acctbal / 100 as lon1, n_nationkey * 3.0::double - 40
        as lat2, n_nationkey * 7.0::double - 90 as lon2
      from customer join nation on c_nationkey = n_nationkey)""")
def nearest_center(spark, folder):
    """Distance from a customer to the centre of their nation; places come from the keys."""
    customers = prefix_columns(table(spark, folder, "customer").withColumns({
        "lat": F.col("c_acctbal") / 200, "lon": F.col("c_acctbal") / 100,
    }), "cus_")
    centers = prefix_columns(table(spark, folder, "nation").withColumns({
        "lat": F.col("n_nationkey") * F.lit(3.0) - 40,
        "lon": F.col("n_nationkey") * F.lit(7.0) - 90,
    }), "ctr_")
    joined = joins.enrich(customers, centers, [("cus_c_nationkey", "ctr_n_nationkey")], "inner")
    distance = geo_distance(*[F.col(c) for c in ("cus_lat", "cus_lon", "ctr_lat", "ctr_lon")])
    return joined.select(
        "cus_c_custkey", "cus_c_nationkey", "ctr_n_name",
        F.round(distance, 3).alias("distance_km"),
    )


PERIODS = """with past as (select distinct o_custkey, o_orderdate from orders
      where o_orderdate >= timestamp '2001-08-01' - interval 360 day
        and o_orderdate < timestamp '2001-08-01' - interval 120 day),
    now as (select distinct o_custkey, o_orderdate from orders
      where o_orderdate >= timestamp '2001-08-01' - interval 120 day) """


def _periods(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    past = between_ago(orders, "o_orderdate", ORDERS_AS_OF, 360, 120).distinct()
    return past, recent(orders, "o_orderdate", ORDERS_AS_OF, 120).distinct()


@query("retained_users", PERIODS + """
    select past.o_custkey, past.o_orderdate, count(*) as matches
    from past join now on past.o_custkey = now.o_custkey group by 1, 2""")
def retained_users(spark, folder):
    return joins.retained(*_periods(spark, folder), "o_custkey")


@query("retained_pairs", PERIODS + """
    select past.o_custkey, past.o_orderdate, now.o_custkey as now_o_custkey,
      now.o_orderdate as now_o_orderdate from past join now on past.o_custkey = now.o_custkey""")
def retained_pairs(spark, folder):
    return joins.retained_pairs(*_periods(spark, folder), "o_custkey")


@query("churned_users", PERIODS + """
    select distinct o_custkey from past where o_custkey not in (select o_custkey from now)""")
def churned_users(spark, folder):
    past, now = _periods(spark, folder)
    return joins.anti(past, now, ["o_custkey"]).select("o_custkey").distinct()


@query("semi_join", """
    select c_custkey, c_name from customer
    where c_custkey in (select o_custkey from orders where o_totalprice > 450000)""")
def semi_join(spark, folder):
    big = table(spark, folder, "orders").where("o_totalprice > 450000")
    return joins.semi(
        table(spark, folder, "customer"), big, "c_custkey", "o_custkey"
    ).select("c_custkey", "c_name")


@query("flag_in", """
    select c_mktsegment, count(case when c_custkey in (select o_custkey from orders
      where o_totalprice > 450000) then 1 end) as big_spenders from customer group by 1""")
def flag_in(spark, folder):
    big = table(spark, folder, "orders").where("o_totalprice > 450000")
    flagged = joins.flag_in(
        table(spark, folder, "customer"), big, "c_custkey", "is_big", "o_custkey"
    )
    return flagged.groupBy("c_mktsegment").agg(F.count_if("is_big").alias("big_spenders"))


@query("not_in", """
    select c_custkey from customer where c_custkey not in
      (select o_custkey from orders where o_orderdate >= timestamp '2001-01-01')""")
def not_in(spark, folder):
    late = table(spark, folder, "orders").where("o_orderdate >= timestamp '2001-01-01'")
    return joins.not_in(
        table(spark, folder, "customer"), late, "c_custkey", "o_custkey"
    ).select("c_custkey")


@query("not_in_with_null", """
    select c_custkey from customer where c_custkey not in
      (select nullif(o_custkey, (select min(o_custkey) from orders)) from orders
       where o_orderdate >= timestamp '2001-01-01' or o_custkey = (select min(o_custkey) from orders))""")
def not_in_with_null(spark, folder):
    """One NULL in the list, so no rows."""
    orders = table(spark, folder, "orders")
    lowest = orders.agg(F.min("o_custkey")).scalar()
    key = F.col("o_custkey")
    late = orders.where((F.col("o_orderdate") >= "2001-01-01") | (key == lowest)).select(
        F.nullif(key, lowest).alias("o_custkey")
    )
    return joins.not_in(
        table(spark, folder, "customer"), late, "c_custkey", "o_custkey"
    ).select("c_custkey")


@query("anti_join", """
    select c_custkey from customer left join (select distinct o_custkey from orders
      where o_totalprice > 300000) on o_custkey = c_custkey where o_custkey is null""")
def anti_join(spark, folder):
    big = table(spark, folder, "orders").where("o_totalprice > 300000").select(
        F.col("o_custkey").alias("c_custkey")
    )
    return joins.anti(table(spark, folder, "customer"), big, ["c_custkey"]).select("c_custkey")


@query("left_join_on", """
    select e.user_id, e.event_type, count(distinct l.event_id) as late_events from
      (select distinct user_id, event_type from events) e left join events l
      on e.user_id = l.user_id and e.event_type = l.event_type and l.ts >= timestamp '2024-01-24'
    group by 1, 2""")
def left_join_on(spark, folder):
    rows = table(spark, folder, "events")
    pairs = rows.select("user_id", "event_type").distinct()
    acts = prefix_columns(rows.select("event_id", "user_id", "event_type", "ts"), "l_")
    bound = F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAY")
    joined = joins.left_join_on(
        pairs, acts, (F.col("user_id") == F.col("l_user_id"))
        & (F.col("event_type") == F.col("l_event_type")) & (F.col("l_ts") >= bound),
    )
    return joined.groupBy("user_id", "event_type").agg(
        F.count_distinct("l_event_id").alias("late_events")
    )


@query("compare_with_global", """
    select o_orderkey, o_totalprice / (select max(o_totalprice) from orders) as of_top
    from orders where o_totalprice >= (select max(o_totalprice) from orders) * 0.9""")
def compare_with_global(spark, folder):
    orders = joins.vs_global(table(spark, folder, "orders"), {"top": F.max("o_totalprice")})
    return orders.where(F.col("o_totalprice") >= F.col("top") * F.lit(0.9)).select(
        "o_orderkey", (F.col("o_totalprice") / F.col("top")).alias("of_top")
    )


SEQUENCES = """
    with v as (select event_id, user_id, ts from events where event_type = 'view'),
      c as (select v.event_id, v.user_id, v.ts as step_1, min(e.ts) as step_2 from v join events e
        on e.user_id = v.user_id and e.event_type = 'click' and e.ts > v.ts
        and e.ts <= v.ts + interval 12 hour group by 1, 2, 3),
      p as (select c.event_id, c.user_id, step_1, step_2, min(e.ts) as step_3 from c join events e
        on e.user_id = c.user_id and e.event_type = 'purchase' and e.ts > step_2
        and e.ts <= step_1 + interval 12 hour group by 1, 2, 3, 4)
    select * from p"""


@query("sequence_match", SEQUENCES)
def sequence_match(spark, folder):
    """View, then click, then purchase within twelve hours."""
    return joins.sequence_match(
        table(spark, folder, "events"), "user_id", "ts", "event_type",
        ["view", "click", "purchase"], "12 hours", "event_id",
    )


STRICT = """
    with o as (select *, row_number() over (partition by {0} order by ts, event_id) as i from events),
      s as (select {0}, string_agg(substr(event_type, 1, 1), '' order by i) as line from o group by 1),
      m as (select o.{0}, event_id, ts, i, len(regexp_extract(substr(line, i), '^vc+e?(p|s)')) as n
        from o join s using ({0}) where event_type = 'view')
    select m.{0}, m.event_id, m.ts as start, o.event_id as end_id, o.ts as "end"
    from m join o on o.{0} = m.{0} and o.i = m.i + m.n - 1 and m.n > 0 where o.ts <= m.ts + interval {1}"""
BUYING = [
    patterns.step("view"), patterns.step("click", repeated=True), patterns.step("error", optional=True),
    patterns.step("purchase", "signup"),
]


@query("pattern_strict", STRICT.format("user_id", "5 day"))
def pattern_strict(spark, folder):
    """A view, clicks, perhaps an error, then a purchase or signup, and nothing between them."""
    return patterns.match_pattern(
        table(spark, folder, "events"), ["user_id"], "ts", "event_type", BUYING, "5 days", "event_id", "none"
    )


@query("pattern_in_chunks", STRICT.format("half", "5 hour").replace(
    "from events)", "from (select *, user_id % 2 as half from events))"))
def pattern_in_chunks(spark, folder):
    """Two keys that hold all rows, cut into many chunks."""
    rows = table(spark, folder, "events").withColumn("half", F.col("user_id") % 2)
    return patterns.match_pattern(
        rows, ["half"], "ts", "event_type", BUYING, "5 hours", "event_id", "none", hot=50
    )


@query("pattern_relaxed", """
    with v as (select event_id, user_id, ts from events where event_type = 'view'),
      c as (select v.event_id, v.user_id, v.ts, min(e.ts) as clicked from v join events e on e.user_id = v.user_id
        and e.event_type = 'click' and e.ts > v.ts group by 1, 2, 3),
      p as (select c.event_id, c.user_id, c.ts as start, arg_min(e.event_id, e.ts) as end_id, min(e.ts) as "end"
        from c join events e on e.user_id = c.user_id and e.event_type in ('purchase', 'signup')
        and e.ts > clicked group by 1, 2, 3)
    select * from p where "end" <= start + interval 12 hour""")
def pattern_relaxed(spark, folder):
    return patterns.match_pattern(
        table(spark, folder, "events"), ["user_id"], "ts", "event_type", BUYING, "12 hours", "event_id"
    )
