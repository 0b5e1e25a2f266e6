"""Sources, filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import EVENTS, EVENTS_AS_OF, events, query, rounded, table
from rillcask.functions import nested, numbers, strings, times
from rillcask.operators import dedup, rows
from rillcask.session import new_folder
from rillcask.sources import formats, streams, tables


@query("keyed_table", """
    select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (
      select *, row_number() over (partition by o_custkey
        order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def keyed_table(spark, folder):
    orders = table(spark, folder, "orders")
    return tables.read_keyed_table(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query("partitioned_table", """
    select strftime(o_orderdate, '%Y-%m') as month, count(*) as n,
      sum(cast(round(o_totalprice * 100) as bigint))::bigint as cents
    from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'
    group by 1""")
def partitioned_table(spark, folder):
    path = new_folder(spark, "orders-by-month")
    tables.write_partitioned(table(spark, folder, "orders"), path, "o_orderdate", "month")
    year = tables.read_period(spark, path, "o_orderdate", "month", "1997-01-01", "1997-12-01")
    return year.groupBy(F.date_format("o_orderdate_month", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
    )


@query("values_table", """
    with sla(priority, days) as (values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 5),
      ('4-NOT SPECIFIED', null), ('5-LOW', 10))
    select o_orderpriority as priority, days, count(*) as n
    from orders left join sla on o_orderpriority = priority group by 1, 2""")
def values_table(spark, folder):
    sla = tables.values_table(spark, [
        {"priority": "1-URGENT", "days": 1}, {"priority": "2-HIGH", "days": 2},
        {"priority": "3-MEDIUM", "days": 5}, {"priority": "4-NOT SPECIFIED"},
        {"priority": "5-LOW", "days": 10},
    ], "priority string, days int")
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "priority")
    return orders.join(sla, "priority", "left").groupBy("priority", "days").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("create_table_as", """
    select event_id, user_id, value, event_type = 'purchase' as bought from events""")
def create_table_as(spark, folder):
    rows_ = table(spark, folder, "events").select(
        "event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("bought")
    )
    return tables.create_table_as(rows_, new_folder(spark, "bought"))


@query("append_to", """
    select event_id, user_id, event_type,
      case when event_type = 'click' then value end as value from events""")
def append_to(spark, folder):
    path = new_folder(spark, "appended")
    columns = ["event_id", "user_id", "event_type", "value"]
    rows_ = table(spark, folder, "events").select(*columns)
    out = tables.create_table_as(rows_.where("event_type = 'click'"), path)
    tables.append_to(rows_.where("event_type <> 'click'").drop("value"), path)
    return spark.read.schema(out.schema).parquet(path)


@query("convert_format", """
    select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer""")
def convert_format(spark, folder):
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, " \
        "c_mktsegment string"
    steps = ["parquet", "json", "csv", "orc"]
    path = f"{folder}/customer.parquet"
    for source, target in zip(steps, steps[1:]):
        out_path = new_folder(spark, f"customer-{target}")
        out = formats.convert_format(spark, path, source, out_path, target, schema)
        path = out_path
    return out


@query("convert_documents", "select doc_id, text, lang, source, n_chars from documents")
def convert_documents(spark, folder):
    """Whole texts with their line breaks through JSON, CSV and ORC."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    path, steps = f"{folder}/documents.parquet", ["parquet", "json", "csv", "orc"]
    for source, target in zip(steps, steps[1:]):
        out_path = new_folder(spark, f"documents-{target}")
        out = formats.convert_format(spark, path, source, out_path, target, schema)
        path = out_path
    return out


@query("record_metadata", """
    select 'orders.parquet' as source_file, 0::bigint as source_offset, count(*) as n from orders""")
def record_metadata(spark, folder):
    rows_ = streams.with_record_metadata(table(spark, folder, "orders"))
    known = rows_.where(F.col("source_timestamp") < F.current_timestamp())
    return known.groupBy("source_file").agg(
        F.min("source_offset").cast("bigint").alias("source_offset"), F.count(F.lit(1)).alias("n")
    )


def _records(spark, folder):
    """Events packed as records of a topic: every 17th is cut short, every 19th is a deletion."""
    at = F.col("event_id")
    body = F.to_json(F.struct("user_id", "event_type", "value"))
    return table(spark, folder, "events").select(
        at.cast("string").cast("binary").alias("key"),
        F.when(at % 17 == 0, F.substring(body, 1, 20)).when(at % 19 == 0, F.lit(None)).otherwise(body)
        .cast("binary").alias("value"),
        F.lit("events").alias("topic"), (at % 4).cast("int").alias("partition"),
        F.floor(at / 4).alias("offset"),
    )


RECORD = ("event_id bigint", "user_id bigint, event_type string, value double")


@query("topic_records", """
    select event_id, case when event_id % 19 <> 0 then user_id end as user_id,
      case when event_id % 19 <> 0 then event_type end as event_type,
      case when event_id % 19 <> 0 then value end as value, event_id % 19 = 0 as tombstone,
      'events' as topic, (event_id % 4)::integer as partition, event_id // 4 as "offset"
    from events where event_id % 17 <> 0""")
def topic_records(spark, folder):
    return formats.topic_records(_records(spark, folder), *RECORD)[0]


@query("topic_rejects", """
    select event_id, 'events' as topic, (event_id % 4)::integer as partition,
      event_id // 4 as "offset", 'value is no json record of its schema' as error_message
    from events where event_id % 17 = 0""")
def topic_rejects(spark, folder):
    return formats.topic_records(_records(spark, folder), *RECORD)[1].drop("record_b64")


@query("snapshot", """
    select o_orderkey, o_totalprice * 2 as doubled from orders
    where o_orderstatus = 'F' and o_totalprice > 400000""")
def snapshot(spark, folder):
    return tables.snapshot(
        table(spark, folder, "orders"), ["o_orderkey", "o_totalprice * 2 as doubled"],
        "o_orderstatus = 'F' and o_totalprice > 400000",
    )


@query("snapshot_limit", """
    select least(count(*), 25) as n, least(count(*), 25) as fitting from orders
    where o_orderstatus = 'O'""")
def snapshot_limit(spark, folder):
    """Any 25 rows, all of which fit the condition."""
    out = tables.snapshot(table(spark, folder, "orders"), "*", "o_orderstatus = 'O'", 25)
    return out.agg(
        F.count_distinct("o_orderkey").alias("n"),
        F.count_if(F.col("o_orderstatus") == "O").alias("fitting"),
    )


@query("rows_to_json", """
    select json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus',
      o_orderstatus, 'rush', case when o_orderpriority = '1-URGENT' then 'yes' end)::varchar as line
    from orders""")
def rows_to_json(spark, folder):
    rush = F.when(F.col("o_orderpriority") == "1-URGENT", "yes").alias("rush")
    return formats.rows_to_json(table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", rush
    ))


@query("rows_to_csv", r"""
    select doc_id::varchar || ',' || coalesce(case when lang <> 'en' then lang end, '') || ',' ||
      case when regexp_matches(text, '[,"\n\r]') then '"' || replace(text, '"', '""') || '"'
      else text end as line from documents""")
def rows_to_csv(spark, folder):
    return formats.rows_to_csv(table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "text"
    ))


@query("bucket_layout", """
    select o_custkey, count(*) as n, 1 as partitions from orders group by 1""")
def bucket_layout(spark, folder):
    """Every key lies in one partition after hash distribution."""
    rows_ = tables.bucket(table(spark, folder, "orders").select("o_custkey"), ["o_custkey"], 16)
    return rows_.withColumn("pid", F.spark_partition_id()).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pid").cast("int").alias("partitions")
    )


@query("rekey", "select split_part(c_name, '#', 2) as key, c_custkey from customer")
def rekey(spark, folder):
    customers = table(spark, folder, "customer")
    key = strings.split_part(F.col("c_name"), "#", 2)
    return tables.rekey(customers, key).select("key", "c_custkey")


@query("named_steps", """
    with big as (select * from orders where o_totalprice > 300000),
      per_status as (select o_orderstatus, count(*) as n from big group by 1)
    select o_orderstatus, n from per_status""")
def named_steps(spark, folder):
    tables.register(table(spark, folder, "orders").where("o_totalprice > 300000"), "big_orders")
    return spark.sql("select o_orderstatus, count(*) as n from big_orders group by o_orderstatus")


DEAD = """(select event_id, case when event_type = 'error' then substr(props, 1, 5)
    when event_type = 'signup' then replace(props, ': ', ': "x') else props end as raw from events)"""


def _raw_events(spark, folder):
    props = F.col("props")
    raw = (
        F.when(F.col("event_type") == "error", F.substring(props, 1, 5))
        .when(F.col("event_type") == "signup", F.replace(props, F.lit(": "), F.lit(': "x')))
        .otherwise(props)
    )
    return table(spark, folder, "events").select("event_id", raw.alias("raw"))


@query("decoded_records", f"""
    select event_id, cast(json_extract_string(raw, '$.k') as integer) as k from {DEAD}
    where json_valid(raw)""")
def decoded_records(spark, folder):
    return formats.parse_or_reject(_raw_events(spark, folder), "raw", "k int")[0]


@query("dead_letters", f"""
    select event_id, 'record is not valid JSON' as error_message,
      to_base64(encode(raw)) as record_b64 from {DEAD} where not json_valid(raw)""")
def dead_letters(spark, folder):
    return formats.parse_or_reject(_raw_events(spark, folder), "raw", "k int")[1]


@query("filter_rows", """
    select event_id, event_type, value from events
    where event_type in ('click', 'view') and value between 10 and 200
      and event_type <> 'error' and props is not null""")
def filter_rows(spark, folder):
    kind = F.col("event_type")
    return rows.where(
        table(spark, folder, "events"),
        kind.isin("click", "view") & F.col("value").between(10, 200) & (kind != "error")
        & F.col("props").isNotNull(),
    ).select("event_id", "event_type", "value")


def _routes():
    kind = F.col("kind")
    return {"buy": kind == "purchase", "look": kind.isin("view", "click")}


def _kinds(spark, folder):
    """Event type, unknown for signups."""
    kind = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return table(spark, folder, "events").select("event_id", kind.alias("kind"))


@query("split_branches", """
    select case event_type when 'purchase' then 'buy' when 'error' then 'other'
      else 'look' end as branch, count(*) as n
    from events where event_type <> 'signup' group by 1""")
def split_branches(spark, folder):
    """Rows per branch; events of unknown type fall into none."""
    branches = rows.split(_kinds(spark, folder), _routes())
    out = None
    for name, df in branches.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("branch"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("route_rows", """
    select event_id, case event_type when 'purchase' then 'buy' when 'error' then 'other'
      else 'look' end as route from events where event_type <> 'signup'""")
def route_rows(spark, folder):
    return rows.route(_kinds(spark, folder), _routes()).select("event_id", "route")


@query("column_difference", """
    select l_orderkey, l_linenumber, l_extendedprice - l_quantity as price_diff from lineitem""")
def column_difference(spark, folder):
    return rows.col_diff(
        table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", "price_diff"
    ).select("l_orderkey", "l_linenumber", "price_diff")


@query("concat_sentence", """
    select event_id, 'user ' || user_id::varchar || ' did ' || event_type || ' #' ||
      nullif(event_type, 'error') as summary from events""")
def concat_sentence(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select("event_id", strings.concat(
        "user ", F.col("user_id"), " did ", kind, " #", F.nullif(kind, F.lit("error"))
    ).alias("summary"))


def _nested_customers(spark, folder):
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    place = F.struct(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("name"), place.alias("place")).alias("customer"),
    )


@query("flatten_nested", """
    select c_custkey as id, c_name as cust_name, n_name as cust_nation, n_regionkey as cust_region
    from customer join nation on c_nationkey = n_nationkey""")
def flatten_nested(spark, folder):
    return nested.flatten(_nested_customers(spark, folder), {
        "id": "id", "customer.name": "cust_name", "customer.place.nation": "cust_nation",
        "customer.place.region": "cust_region",
    })


@query("flatten_all", """
    select c_custkey as id, c_name as customer_name, n_name as customer_place_nation,
      n_regionkey as customer_place_region
    from customer join nation on c_nationkey = n_nationkey""")
def flatten_all(spark, folder):
    return nested.flatten_all(_nested_customers(spark, folder))


@query("copy_key", "select s_suppkey, s_suppkey as id, s_name from supplier")
def copy_key(spark, folder):
    return rows.copy_key(table(spark, folder, "supplier"), "s_suppkey", "id").select(
        "s_suppkey", "id", "s_name"
    )


@query("bucketize", """
    select case when o_totalprice < 1000 then 'micro' when o_totalprice < 10000 then 'small'
      when o_totalprice < 100000 then 'medium' else 'large' end as size, count(*) as n
    from orders group by 1""")
def bucketize(spark, folder):
    size = rows.bucketize(
        F.col("o_totalprice"), [(1000, "micro"), (10000, "small"), (100000, "medium")], "large"
    )
    return table(spark, folder, "orders").groupBy(size.alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("label_rules", """
    select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 200000 then 'big_done'
      when o_orderstatus = 'F' then 'done' when o_orderpriority = '1-URGENT' then 'urgent'
      else 'normal' end as label from orders""")
def label_rules(spark, folder):
    done = F.col("o_orderstatus") == "F"
    return table(spark, folder, "orders").select("o_orderkey", rows.label_rules([
        (done & (F.col("o_totalprice") > 200000), "big_done"), (done, "done"),
        (F.col("o_orderpriority") == "1-URGENT", "urgent"),
    ], "normal").alias("label"))


@query("recent_events", """
    select event_id, ts from events where ts >= timestamp '2024-01-31' - interval 7 day""")
def recent_events(spark, folder):
    return rows.recent(table(spark, folder, "events"), "ts", EVENTS_AS_OF, 7).select(
        "event_id", "ts"
    )


@query("events_between", """
    select event_id, ts from events where ts >= timestamp '2024-01-31' - interval 14 day
      and ts < timestamp '2024-01-31' - interval 7 day""")
def events_between(spark, folder):
    return rows.between_ago(table(spark, folder, "events"), "ts", EVENTS_AS_OF, 14, 7).select(
        "event_id", "ts"
    )


@query("safe_ratio", f"""
    select event_id, case when k > 0 then cents::double / k else 0 end as ratio,
      case when k > 0 then cents::double / k end as ratio_or_null,
      coalesce(nullif(k, 0), -1) as k_or_minus from {EVENTS}""")
def safe_ratio(spark, folder):
    top, bottom = F.col("cents").cast("double"), F.col("k")
    return events(spark, folder).select(
        "event_id", numbers.safe_ratio(top, bottom, 1, 0.0).alias("ratio"),
        numbers.safe_ratio(top, bottom, 1, None).alias("ratio_or_null"),
        F.coalesce(F.nullif(bottom, F.lit(0)), F.lit(-1)).alias("k_or_minus"),
    )


@query("string_functions", r"""
    select c_custkey, split_part(c_name, '#', 1) as first_part, try_cast(split_part(c_name, '#', 2)
      as integer) as number, try_cast(split_part(c_name, '#', 1) as integer) as no_number,
      concat_ws('-', c_mktsegment, nullif(c_mktsegment, 'BUILDING')) as joined,
      length(c_name) as n_chars, strpos(c_name, '0') as first_zero,
      case when strpos(c_name, '0') = 0 then 0 when strpos(substr(c_name, strpos(c_name, '0') + 1),
        '0') = 0 then 0 else strpos(c_name, '0') + strpos(substr(c_name, strpos(c_name, '0') + 1),
        '0') end as second_zero,
      regexp_replace(c_name, '[^a-zA-Z0-9]', '_', 'g') as clean,
      regexp_extract(c_name, '([0-9]+)', 1) as digits
    from customer""")
def string_functions(spark, folder):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey", strings.split_part(name, "#", 1).alias("first_part"),
        strings.to_type(strings.split_part(name, "#", 2), "int").alias("number"),
        strings.to_type(strings.split_part(name, "#", 1), "int").alias("no_number"),
        F.concat_ws("-", segment, F.nullif(segment, F.lit("BUILDING"))).alias("joined"),
        F.char_length(name).alias("n_chars"),
        strings.locate("0", name).alias("first_zero"),
        strings.locate("0", name, occurrence=2).alias("second_zero"),
        strings.regex_clean(name, "[^a-zA-Z0-9]", "_").alias("clean"),
        strings.regex_pick(name, "([0-9]+)").alias("digits"),
    )


@query("mask", r"""
    select c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name,
      '[^A-Za-z0-9]', '-', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')
      as masked from customer""")
def mask(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", strings.mask(F.col("c_name")).alias("masked")
    )


@query("surrogate_key", """
    select l_orderkey, l_linenumber, md5(concat_ws(',', l_orderkey::varchar, l_linenumber::varchar,
      nullif(l_returnflag, 'N'))) as line_key from lineitem""")
def surrogate_key(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", strings.surrogate_key(
            F.col("l_orderkey"), F.col("l_linenumber"), F.nullif("l_returnflag", F.lit("N"))
        ).alias("line_key"),
    )


@query("base64_round_trip", """
    select doc_id, to_base64(encode(source)) as encoded, text as decoded from documents""")
def base64_round_trip(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", strings.b64_encode(F.col("source")).alias("encoded"),
        strings.b64_decode(strings.b64_encode(F.col("text"))).alias("decoded"),
    )


@query("date_parts", """
    select event_id, strftime(ts, '%Y-%m-%d') as event_date, hour(ts) as event_hour,
      dayofweek(ts) + 1 as day_of_week, weekofyear(ts) as week_of_year, month(ts) as event_month,
      quarter(ts) as event_quarter, date_trunc('hour', ts) as hour_bucket,
      date_trunc('week', ts)::timestamp as week_bucket,
      date_trunc('month', ts)::timestamp as month_bucket
    from events""")
def date_parts(spark, folder):
    ts = F.col("ts")
    parts = times.date_parts(ts)
    parts["event_date"] = F.date_format(parts["event_date"], "yyyy-MM-dd")
    return table(spark, folder, "events").select(
        "event_id", *[c.alias(n) for n, c in parts.items()],
        *[times.trunc_to(ts, u).cast("timestamp_ntz").alias(f"{u}_bucket")
          for u in ("hour", "week", "month")],
    )


@query("date_arithmetic", """
    select o_orderkey, strftime(o_orderdate, '%Y-%m') as month_text,
      strftime(o_orderdate + interval 2 month, '%Y-%m-%d') as plus_two_months,
      strftime(o_orderdate - interval 36 hour, '%Y-%m-%d %H:%M:%S') as minus_36_hours,
      date_diff('day', o_orderdate, timestamp '2001-08-01') as days_to,
      date_sub('minute', o_orderdate, timestamp '2001-08-01 00:30:30') as minutes_to
    from orders""")
def date_arithmetic(spark, folder):
    day = F.col("o_orderdate")
    end = F.lit("2001-08-01 00:30:30").cast("timestamp_ntz")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM").alias("month_text"),
        F.date_format(times.shift(day, 2, "MONTH"), "yyyy-MM-dd").alias("plus_two_months"),
        F.date_format(times.shift(day, -36, "HOUR"), "yyyy-MM-dd HH:mm:ss").alias(
            "minus_36_hours"
        ),
        F.datediff(F.lit("2001-08-01").cast("date"), day.cast("date")).cast("bigint").alias(
            "days_to"
        ),
        times.diff("MINUTE", day, end).alias("minutes_to"),
    )


@query("epoch_and_zones", """
    select event_id, (epoch_us(ts) // 1000)::bigint as ms, (epoch_us(ts) // 1000000)::bigint as s,
      strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') as from_ms,
      strftime(ts - interval 7 hour, '%Y-%m-%d %H:%M:%S') as denver,
      strftime(ts + interval 9 hour, '%Y-%m-%dT%H:%M:%S') as tokyo
    from events""")
def epoch_and_zones(spark, folder):
    ts = F.col("ts")
    ms = times.to_epoch(ts, "ms")
    denver = times.convert_tz(ts, "UTC", "America/Denver")
    tokyo = times.convert_tz(ts, "UTC", "Asia/Tokyo")
    return table(spark, folder, "events").select(
        "event_id", ms.alias("ms"), times.to_epoch(ts, "s").alias("s"),
        times.fmt_ts(times.from_epoch(ms, "ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("from_ms"),
        F.date_format(denver, "yyyy-MM-dd HH:mm:ss").alias("denver"),
        F.date_format(tokyo, "yyyy-MM-dd'T'HH:mm:ss").alias("tokyo"),
    )


@query("parse_timestamps", """
    select event_id, date_trunc('second', ts) as parsed, null::timestamp as rejected from events""")
def parse_timestamps(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, folder, "events").select(
        "event_id", times.parse_ts(text).cast("timestamp_ntz").alias("parsed"),
        times.parse_ts(F.col("event_type")).cast("timestamp_ntz").alias("rejected"),
    )


@query("time_categories", """
    select case when dayofweek(ts) in (0, 6) then 'weekend' when hour(ts) between 9 and 17
        then 'business_hours' else 'after_hours' end as time_category,
      case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) in (3, 4, 5)
        then 'spring' when month(o_orderdate) in (6, 7, 8) then 'summer' else 'fall' end as season,
      case when hour(ts) >= 22 or hour(ts) <= 6 then 1 else 0 end as late, count(*) as n
    from (select *, o_orderdate + to_minutes((o_orderkey % 1440)::integer) as ts from orders)
    group by 1, 2, 3""")
def time_categories(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "ts", times.shift(F.col("o_orderdate"), (F.col("o_orderkey") % 1440).cast("int"), "MINUTE")
    )
    ts = F.col("ts")
    return orders.groupBy(
        times.time_category(ts).alias("time_category"),
        times.season(F.col("o_orderdate")).alias("season"),
        times.is_late_night(ts).alias("late"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("math_functions", f"""
    select event_id, {rounded("log10(value + 1)", 6)} as log_value,
      {rounded("sqrt(value)", 6)} as root, {rounded("pow(value, 0.5)", 6)} as powered,
      abs(cents - 5000) as distance, {rounded("value", 1)} as tenth from {EVENTS}""")
def math_functions(spark, folder):
    value = F.col("value")
    return events(spark, folder).select(
        "event_id", F.round(numbers.log10_plus_one(value), 6).alias("log_value"),
        F.round(numbers.square_root(value), 6).alias("root"),
        F.round(numbers.power(value, 0.5), 6).alias("powered"),
        F.abs(F.col("cents") - 5000).alias("distance"), F.round(value, 1).alias("tenth"),
    )


@query("to_usd", f"""
    select event_id, value * case event_type when 'view' then 1.1::double
      when 'click' then 1.25::double when 'signup' then 0.0075::double else 1::double end as usd
    from events""")
def to_usd(spark, folder):
    kind = F.col("event_type")
    currency = F.when(kind == "view", "EUR").when(kind == "click", "GBP").when(
        kind == "signup", "JPY"
    ).otherwise("USD")
    return table(spark, folder, "events").select(
        "event_id", numbers.to_usd(F.col("value"), currency).alias("usd")
    )


@query("arrays", """
    select doc_id, len(words) as n_words, list_contains(words, 'the') as has_the,
      words[1] as first_word, words[1000] as late_word, array_to_string(words, '|') as piped
    from (select doc_id, str_split(source || ' ' || text, ' ') as words from documents)""")
def arrays(spark, folder):
    words = F.split(F.concat("source", F.lit(" "), "text"), " ")
    return table(spark, folder, "documents").select("doc_id", words.alias("words")).select(
        "doc_id", nested.size(F.col("words")).alias("n_words"),
        nested.contains(F.col("words"), "the").alias("has_the"),
        nested.item(F.col("words"), 0).alias("first_word"),
        nested.item(F.col("words"), 999).alias("late_word"),
        nested.joined(F.col("words"), "|").alias("piped"),
    )


@query("unnest_words", """
    select lang, word, count(*) as n from (select lang, unnest(str_split(text, ' ')) as word
      from documents) group by 1, 2""")
def unnest_words(spark, folder):
    docs = table(spark, folder, "documents").select("lang", F.split("text", " ").alias("words"))
    return nested.unnest(docs, "words", "word").groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("maps", """
    select doc_id, source as source, null::varchar as absent, 'lang,source' as keys,
      lang || ',' || source as vals from documents""")
def maps(spark, folder):
    fields = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", fields.alias("fields")).select(
        "doc_id", nested.map_value(F.col("fields"), "source").alias("source"),
        nested.map_value(F.col("fields"), "campaign").alias("absent"),
        nested.joined(nested.sorted_keys(F.col("fields")), ",").alias("keys"),
        nested.joined(nested.values_by_key(F.col("fields")), ",").alias("vals"),
    )


@query("json_extract", """
    select event_id, json_extract_string(props, '$.k') as k_text,
      cast(json_extract_string(props, '$.k') as double) as k_number,
      json_extract_string(props, '$.user.language') as no_field from events""")
def json_extract(spark, folder):
    props = F.col("props")
    return table(spark, folder, "events").select(
        "event_id", strings.json_field(props, "$.k").alias("k_text"),
        strings.json_fields(props, "k double").getField("k").alias("k_number"),
        strings.json_field(props, "$.user.language").alias("no_field"),
    )


CHANGES = """(select event_id, ts, user_id, cents, case event_type when 'purchase' then '+U'
    when 'error' then '-D' when 'view' then '-U' else '+I' end as op from """ + EVENTS + ")"


@query("latest_event_per_user", """
    select user_id, event_id, ts, event_type from (select *, row_number() over
      (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def latest_event_per_user(spark, folder):
    rows_ = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return dedup.latest_by_key(rows_, ["user_id"], ["ts", "event_id"])


@query("apply_changelog", f"""
    select user_id, event_id, cents from (select *, row_number() over
      (partition by user_id order by ts desc, event_id desc) as rn from {CHANGES}
      where op <> '-U') where rn = 1 and op <> '-D'""")
def apply_changelog(spark, folder):
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "+U").when(kind == "error", "-D").when(
        kind == "view", "-U"
    ).otherwise("+I")
    changes = events(spark, folder).select("user_id", "event_id", "ts", "cents", op.alias("op"))
    return dedup.apply_changelog(changes, ["user_id"], "op", ["ts", "event_id"]).drop("ts")


@query("dedup_first_in_window", """
    select user_id, event_type, first_id, n, window_start from (
      select user_id, event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01')
        as window_start, arg_min(event_id, ts) as first_id, count(*) as n
      from events group by 1, 2, 3)""")
def dedup_first_in_window(spark, folder):
    rows_ = table(spark, folder, "events").select(
        "user_id", "event_type", F.col("event_id").alias("first_id"), "ts"
    )
    return dedup.dedup_window(
        rows_, ["user_id", "event_type"], "ts", "6 hours", "first_id"
    ).select("user_id", "event_type", "first_id", "n", "window_start")


@query("latest_agg", """
    select user_id, arg_max(event_type, ts) as kind, arg_max(big, ts) filter (big is not null)
      as big from (select *, case when value > 100 then event_id end as big from events)
    group by 1""")
def latest_agg(spark, folder):
    rows_ = table(spark, folder, "events").withColumn(
        "big", F.when(F.col("value") > 100, F.col("event_id"))
    ).withColumnRenamed("event_type", "kind")
    order = ["ts", "event_id"]
    return rows_.groupBy("user_id").agg(
        dedup.latest_value("kind", order).alias("kind"),
        dedup.latest_value("big", order, skip_nulls=True).alias("big"),
    )


@query("earliest_agg", """
    select user_id, arg_min(event_type, ts) as event_type, min(ts) as ts from events group by 1""")
def earliest_agg(spark, folder):
    return dedup.earliest_agg(
        table(spark, folder, "events"), ["user_id"], ["event_type", "ts"], ["ts", "event_id"]
    )


@query("distinct_rows", "select distinct user_id, event_type from events")
def distinct_rows(spark, folder):
    return dedup.distinct(table(spark, folder, "events"), ["user_id", "event_type"])
