"""Small streams and tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rillcask.functions import nested, numbers, strings, times
from rillcask.operators import aggregates, dedup, joins, rows as ops, sets
from rillcask.plans.shipped_orders import shipped_orders
from rillcask.sources import formats, tables
from rillcask.session import new_folder
from rillcask.streaming import events, windows


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def tickets(spark):
    return make(spark, [("Reef", 10), ("Moor", 12), ("Moor", 12), ("Fen", 12), ("Moor", 24),
                        ("Fen", 18), ("Fen", 36), ("Fen", 18)], "title string, price int")


def test_counts_and_sums(tickets, rows):
    assert rows(aggregates.count_by(tickets, ["title"])) == [("Fen", 4), ("Moor", 3), ("Reef", 1)]
    total = aggregates.sum_by(tickets, ["title"], "price")
    assert rows(total) == [("Fen", 84), ("Moor", 48), ("Reef", 10)]
    assert total.schema["total"].dataType.simpleString() == "bigint"
    assert rows(aggregates.count_all(tickets)) == [(8,)]


def test_min_and_max(spark, rows):
    sales = make(spark, [(2024, 37), (2024, 131), (2023, 97), (2023, 144), (2022, 232)],
                 "year int, total long")
    assert rows(aggregates.minmax_by(sales, ["year"], "total")) == [
        (2022, 232, 232), (2023, 97, 144), (2024, 37, 131)]


def test_orders_with_shipments(spark, rows):
    pattern = "yyyy-MM-dd'T'HH:mm:ssX"
    orders = make(spark, [
        (1, "2024-09-29T06:01:18Z", 133.84, "Ada"), (2, "2024-09-29T17:02:20Z", 164.31, "Ben"),
        (3, "2024-09-29T13:44:10Z", 90.66, "Cyd"), (4, "2024-09-29T11:58:25Z", 33.11, "Dov"),
    ], "id int, order_ts string, total_amount double, customer_name string")
    ships = make(spark, [
        ("s1", "2024-09-30T18:13:39Z", 1, "North"), ("s2", "2024-09-30T02:04:13Z", 2, "North"),
        ("s3", "2024-09-30T20:47:09Z", 3, "South"), ("s4", "2024-10-07T00:00:00Z", 1, "South"),
    ], "shipment_id string, ship_ts string, order_id int, warehouse string")
    out = shipped_orders(
        events.with_event_time(orders, "order_ts", pattern, "order_time").drop("order_ts"),
        events.with_event_time(ships, "ship_ts", pattern, "ship_time").drop("ship_ts"),
    )
    assert rows(out, "order_id", "ship_minutes", "order_ts") == [
        (1, 2172, "2024-09-29 06:01:18"), (2, 541, "2024-09-29 17:02:20"),
        (3, 1862, "2024-09-29 13:44:10")]


def test_lookup_keeps_unmatched_rows(spark, rows):
    ratings = make(spark, [(1, 8.2), (1, 8.5), (2, 9.9), (9, 1.0)], "movie int, rating double")
    movies = make(spark, [(1, "Reef"), (2, "Moor")], "id int, title string")
    assert rows(joins.enrich(ratings, movies, [("movie", "id")]), "movie", "title") == [
        (1, "Reef"), (1, "Reef"), (2, "Moor"), (9, None)]


def test_lookups_keep_the_ids_of_the_rows(spark, rows):
    orders = make(spark, [("o1", "1", "10"), ("o2", "7", "77")],
                  "order_id string, customer_id string, item_id string")
    customers = make(spark, [("1", "Ada")], "c_id string, customer_name string")
    items = make(spark, [("10", "Lamp")], "i_id string, item_name string")
    out = joins.enrich_many(orders, [
        (customers, [("customer_id", "c_id")]), (items, [("item_id", "i_id")])])
    assert rows(out) == [("o1", "1", "10", "Ada", "Lamp"), ("o2", "7", "77", None, None)]


def test_tables_join_on_their_key(spark, rows):
    a = make(spark, [("Reef", 1), ("Moor", 2)], "title string, id int")
    b = make(spark, [("Reef", "Ada"), ("Fen", "Ben")], "title string, actor string")
    assert rows(joins.join_tables(a, b, ["title"])) == [("Reef", 1, "Ada")]


@pytest.fixture
def acting(spark):
    return make(spark, [("Ada", "Reef", "fantasy"), ("Ben", "Moor", "drama"),
                        ("Cyd", "Fen", "comedy"), ("Dov", "Fen", "action"), ("Eve", "Fen", None)],
                "name string, title string, genre string")


def genre_routes():
    return {g: F.col("genre") == g for g in ("drama", "fantasy")}


def test_unknown_genre_is_in_no_branch(acting, rows):
    parts = ops.split(acting, genre_routes())
    assert {k: v.count() for k, v in parts.items()} == {"drama": 1, "fantasy": 1, "other": 2}
    opted = ops.split(acting, genre_routes(), null_to="other")
    assert opted["other"].count() == 3
    routed = ops.route(acting, genre_routes())
    assert rows(routed, "name", "route") == [
        ("Ada", "fantasy"), ("Ben", "drama"), ("Cyd", "other"), ("Dov", "other")]


def test_merge_says_where_rows_come_from(spark, rows):
    rock = make(spark, [("Ada", "x")], "artist string, title string")
    folk = make(spark, [("y", "Ben")], "title string, artist string")
    assert rows(sets.merge_tagged({"rock": rock, "folk": folk}, "genre")) == [
        ("Ada", "x", "rock"), ("Ben", "y", "folk")]


def test_hopping_whole_number_average(spark, rows):
    data = [("1", f"2020-01-15 02:{m}:30", v) for m, v in
            zip((15, 20, 25, 30, 35, 40, 45, 50), (55, 50, 45, 40, 45, 50, 55, 60))]
    df = events.with_event_time(
        make(spark, data, "id string, at string, reading long"), "at", "yyyy-MM-dd HH:mm:ss")
    out = windows.hopping(df, "event_time", "10 minutes", "5 minutes", ["id"],
                          {"avg": aggregates.int_average("reading")}).orderBy("window_start")
    assert [r["avg"] for r in out.collect()] == [55, 52, 47, 42, 42, 47, 52, 57, 60]


def test_six_hour_windows(spark, rows):
    data = [("T", 1), ("T", 5), ("T", 7), ("U", 9), ("U", 8), ("F", 12), ("F", 15), ("F", 22)]
    df = make(spark, [(t, f"2024-09-24 {h:02}:00:00") for t, h in data], "title string, at string")
    out = windows.tumbling(
        events.with_event_time(df, "at", "yyyy-MM-dd HH:mm:ss"), "event_time", "6 hours",
        ["title"], {"n": F.count(F.lit(1))},
    )
    assert rows(out.select("title", F.hour("window_start"), F.hour("window_end"), "n")) == [
        ("F", 12, 18, 2), ("F", 18, 0, 1), ("T", 0, 6, 2), ("T", 6, 12, 1), ("U", 6, 12, 2)]


def test_sessions_end_with_their_last_event(spark, rows):
    base = 1_700_000_000
    data = [("a", 0), ("a", 60), ("b", 91), ("a", 96), ("b", 120), ("a", 3780), ("a", 3780),
            ("b", 6000), ("b", 6000), ("c", 0), ("c", 300), ("c", 601)]
    df = make(spark, [(ip, base + s) for ip, s in data], "ip string, s long")
    df = events.with_event_time(df, "s", "s")
    out = windows.session(df, "event_time", "5 minutes", ["ip"], {"n": ("count", None)})
    assert rows(out, "ip", "n", "session_length_ms") == [
        ("a", 2, 0), ("a", 3, 96000), ("b", 2, 0), ("b", 2, 29000), ("c", 1, 0), ("c", 2, 300000)]


def test_first_click_per_window(spark, rows):
    data = [(1, "10.0.0.1", "/a", 0), (2, "10.0.0.2", "/b", 10), (3, "10.0.0.1", "/a", 30),
            (4, "10.0.0.1", "/a", 130)]
    df = make(spark, data, "id int, ip string, url string, s long")
    df = events.with_event_time(df, "s", "s").drop("s")
    out = dedup.dedup_window(df, ["ip", "url"], "event_time", "2 minutes", "id")
    assert rows(out, "ip", "id", "n") == [("10.0.0.1", 1, 2), ("10.0.0.1", 4, 1), ("10.0.0.2", 2, 1)]


def test_epoch_milliseconds_in_another_zone(spark, rows):
    df = make(spark, [(1615566394751,)], "ms long")
    utc = times.from_epoch(F.col("ms"), "ms")
    local = times.convert_tz(utc, "UTC", "America/Denver")
    assert rows(df.select(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS"),
                          times.fmt_ts(utc, "HH:mm", "America/Denver"))) == [
        ("2021-03-12 09:26:34.751", "09:26")]


def test_column_difference(spark):
    df = make(spark, [(50.89, 28.99), (23.12, 12.99)], "a double, b double")
    got = [r["d"] for r in ops.col_diff(df, "a", "b", "d").collect()]
    assert got == pytest.approx([21.90, 10.13], abs=1e-9)


def test_sentence(spark, rows):
    df = make(spark, [(300, "Ada", "Lake", "RILL"), (1, "Ben", None, "CASK")],
              "n int, first string, last string, symbol string")
    text = strings.concat(F.col("first"), " ", F.col("last"), " purchased ", F.col("n"),
                          " shares of ", F.col("symbol"))
    assert rows(df.select(text)) == [("Ada Lake purchased 300 shares of RILL",), (None,)]


def test_nested_orders_become_flat(spark, rows):
    schema = ("id string, customer struct<first:string,phone:string,"
              "address:struct<street:string,city:string>>")
    df = make(spark, [("1", ("Ada", None, ("Main", "Lake")))], schema)
    assert rows(nested.flatten(df, {"id": "order_id", "customer.address.city": "city",
                                    "customer.phone": "phone"})) == [("1", "Lake", None)]
    assert nested.flatten_all(df).columns == [
        "id", "customer_first", "customer_phone", "customer_address_street",
        "customer_address_city"]


def test_distance_in_either_unit(spark):
    df = make(spark, [(-33.85995, 151.25664, -33.863, 151.1169)],
              "a double, b double, c double, d double")
    args = [F.col(c) for c in "abcd"]
    row = df.select(numbers.geo_distance(*args).alias("km"),
                    numbers.geo_distance(*args, "miles").alias("mi")).first()
    assert row["km"] == pytest.approx(12.9, abs=0.1) and row["mi"] == pytest.approx(8.0, abs=0.1)


def test_masking_and_splitting(spark, rows):
    df = make(spark, [("Britta", "02/29/2000", "Die Hard::1988")], "n string, d string, t string")
    out = df.select(strings.mask(F.col("n")), strings.mask(F.col("d")),
                    strings.split_part(F.col("t"), "::", 1),
                    strings.to_type(strings.split_part(F.col("t"), "::", 2), "int"),
                    strings.split_part(F.col("t"), "::", 3))
    assert rows(out) == [("Xxxxxx", "nn-nn-nnnn", "Die Hard", 1988, None)]


def test_text_functions(spark, rows):
    df = make(spark, [("banana",), (None,)], "s string")
    s = F.col("s")
    out = df.select(strings.locate("an", s), strings.locate("an", s, 3), strings.locate("an", s, 1, 2),
                    strings.locate("an", s, 1, 3), strings.b64_decode(strings.b64_encode(s)))
    assert rows(out) == [(2, 4, 4, 0, "banana"), (None, None, None, None, None)]


def test_json_paths(spark, rows):
    df = make(spark, [('{"a": {"b": "x"}, "n": 1.5}',), ('{"a": 1}',), ("no json",)], "j string")
    j = F.col("j")
    assert rows(df.select(strings.json_field(j, "$.a.b"), strings.json_field(j, "$.n", "double"),
                          strings.json_fields(j, "n double").getField("n"))) == [
        ("x", 1.5, 1.5), (None, None, None), (None, None, None)]


def test_dead_letters_keep_the_record(spark, rows):
    raw = ['{"id": "s1", "enabled": true}', '{"id": "s2", "ena', '{"id": "s3", "enabled": "maybe"}',
           None]
    df = make(spark, list(enumerate(raw)), "n int, raw string")
    good, bad = formats.parse_or_reject(df, "raw", "id string, enabled boolean")
    assert rows(good) == [(0, "s1", True)]
    back = bad.withColumn("record", strings.b64_decode(F.col("record_b64")))
    assert rows(back, "n", "record") == [(1, raw[1]), (2, raw[2]), (3, None)]
    assert len({r["error_message"] for r in bad.collect()}) == 3


def test_rows_as_text(spark, rows):
    df = make(spark, [(1, 'say "hi"'), (2, "a,b"), (3, None), (4, "two\nlines"), (5, " pad ")],
              "id int, t string")
    assert rows(formats.rows_to_csv(df)) == sorted([
        ('1,"say ""hi"""',), ('2,"a,b"',), ("3,",), ('4,"two\nlines"',), ("5, pad ",)], key=repr)
    assert formats.rows_to_json(df).where("line like '%3%'").first()["line"] == '{"id":3,"t":null}'
    change = df.limit(1).withColumn("op", F.lit("+I"))
    assert formats.changelog_to_json(change).first()["line"] == (
        '{"op":"+I","row":{"id":1,"t":"say \\"hi\\""}}')


def test_literal_rows_and_appending(spark, rows):
    df = tables.values_table(spark, [{"id": 1, "n": "a"}, {"id": 2}], "id int, n string")
    assert rows(df) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        tables.values_table(spark, [{"x": 1}], "id int")
    path = new_folder(spark, "ctas")
    tables.create_table_as(df, path)
    tables.append_to(spark.createDataFrame([("z", 3)], "n string, id int"), path)
    assert rows(spark.read.parquet(path), "id", "n") == [(1, "a"), (2, None), (3, "z")]
    with pytest.raises(ValueError):
        tables.append_to(df.withColumn("extra", F.lit(1)), path)


def test_partitioned_write_and_pruned_read(spark, rows):
    df = make(spark, [(1, "2024-01-31 10:00:00"), (2, "2024-02-01 00:00:00")], "id int, at string")
    path = new_folder(spark, "months")
    tables.write_partitioned(df.withColumn("at", F.to_timestamp("at")), path, "at", "month")
    out = tables.read_period(spark, path, "at", "month", "2024-02-01", "2024-02-01")
    assert rows(out, "id") == [(2,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(at_month" in plan


def test_buckets_spare_the_shuffle(spark):
    a = tables.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), "left_side", ["k"], 4)
    b = tables.write_bucketed(spark.range(50).withColumnRenamed("id", "k"), "right_side", ["k"], 4)
    try:
        plan = a.hint("merge").join(b, "k")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql("drop table left_side")
        spark.sql("drop table right_side")


def test_snapshot_rules(spark, rows):
    df = make(spark, [(i, f"n{i}") for i in range(10)], "id int, n string")
    assert rows(tables.snapshot(df, ["id"], "id >= 8")) == [(8,), (9,)]
    assert tables.snapshot(df, limit=3).count() == 3
    for bad in (0, -1):
        with pytest.raises(ValueError):
            tables.snapshot(df, limit=bad)
    with pytest.raises(ValueError):
        tables.snapshot_of(spark, "  ")
    tables.register(df, "ten_rows")
    assert tables.snapshot_of(spark, " ten_rows ", where="id < 2").count() == 2


def test_changelog(spark, rows):
    data = [("a", 1, "+I", 1), ("a", 2, "-U", 1), ("a", 3, "+U", 5), ("b", 4, "+I", 7),
            ("b", 5, "-D", 7), ("c", 6, "+I", 2), ("c", 7, "-U", 2)]
    df = make(spark, data, "k string, seq int, op string, v int")
    assert rows(dedup.apply_changelog(df, ["k"], "op", ["seq"]), "k", "v") == [("a", 5), ("c", 2)]


def test_last_value_with_and_without_nulls(spark, rows):
    df = make(spark, [("a", 1, "x"), ("a", 2, None), ("b", 1, None)], "k string, seq int, v string")
    assert rows(dedup.latest_agg(df, ["k"], ["v"], ["seq"])) == [("a", None), ("b", None)]
    assert rows(dedup.latest_agg(df, ["k"], ["v"], ["seq"], True)) == [("a", "x"), ("b", None)]
    assert rows(dedup.earliest_agg(df, ["k"], ["v"], ["seq"])) == [("a", "x"), ("b", None)]


def test_arrays_and_maps(spark, rows):
    df = make(spark, [(["p", "q"], {"z": "1", "a": "2"}), ([], {})],
              "tags array<string>, m map<string,string>")
    t, m = F.col("tags"), F.col("m")
    assert rows(df.select(nested.item(t, 0), nested.item(t, 5), nested.map_value(m, "a"),
                          nested.joined(nested.sorted_keys(m), ","),
                          nested.joined(nested.values_by_key(m), ","))) == [
        ("p", None, "2", "a,z", "2,1"), (None, None, None, "", "")]
    assert nested.unnest(df, "tags", "tag").count() == 2
    assert nested.unnest(df, "tags", "tag", outer=True).count() == 3


def test_steps_in_order(spark, rows):
    data = [(1, "u", "view", 0), (2, "u", "click", 5), (3, "u", "buy", 9), (4, "u", "view", 10),
            (5, "u", "buy", 11), (6, "w", "click", 0), (7, "w", "view", 1), (8, "w", "click", 30)]
    df = make(spark, data, "id int, u string, kind string, m int").withColumn(
        "ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    out = joins.sequence_match(df, "u", "ts", "kind", ["view", "click", "buy"], "15 minutes", "id")
    assert rows(out, "u", "id") == [("u", 1)]
