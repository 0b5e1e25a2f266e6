"""Tables that streams keep: upserts with compaction, first rows with retractions, lifetimes."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillcask import catalog
from rillcask.operators import sets
from rillcask.session import STATE_STORE, new_folder
from rillcask.sources.streams import read_stream
from rillcask.streaming import events as times
from rillcask.streaming import lifetimes, ranking, sinks
from rillcask.streaming.upsert import BATCH, UpsertTable, write_table
from tests.oracle import compare, connect

SCHEMA = "k string, at int, v bigint, gone boolean"


def batches():
    """Twelve batches of changes to forty keys, in no order of time."""
    out = []
    for b in range(12):
        out.append([
            (f"k{(7 * i + b) % 40}", (31 * i + 17 * b) % 97 * 100 + b, 2**60 + i, (i + b) % 9 == 0)
            for i in range(30)
        ] + [(None, b, b, False)])
    return out


def expected(parts):
    last = {}
    for k, at, v, gone in (r for part in parts for r in part):
        if k not in last or (at, v) > last[k][0]:
            last[k] = ((at, v), gone)
    return sorted(((k, *o) for k, (o, gone) in last.items() if not gone), key=repr)


def table(spark, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return UpsertTable(spark, new_folder(spark, "table"), ["k"], schema, ["at", "v"], **options)


def now(target, version=None):
    return sorted((tuple(r)[:3] for r in target.read(F.col("gone"), version).collect()), key=repr)


def test_batches_and_compaction_keep_the_last_rows(spark):
    target, parts = table(spark, ranges=3, max_files=2, keep=2), batches()
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, SCHEMA)
        assert target.upsert(rows, i) and not target.upsert(rows, i)
        before = target.manifest()["version"]
        done = target.compact()
        assert now(target) == expected(parts[: i + 1])
        if done:
            # a reader of the manifest before sees the same rows, from files that are still there
            assert now(target, before) == expected(parts[: i + 1])
        per_range = Counter(e["range"] for e in target.manifest()["live"])
        assert max(per_range.values()) <= 2
    assert len(target.versions()) <= 2


def test_a_reader_beside_a_stream_sees_whole_batches(spark):
    target, parts = table(spark, ranges=4, max_files=1, keep=50), batches()[:6]
    path = new_folder(spark, "source")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)
    states = [expected(parts[:i]) for i in range(len(parts) + 1)]
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(now(target))

    reader = threading.Thread(target=look)
    reader.start()
    stream = read_stream(spark, path, SCHEMA, "json", options={"maxFilesPerTrigger": "1"})
    write_table(stream, target, new_folder(spark, "state"), mode="append").awaitTermination()
    stop.set()
    reader.join()
    # files come in the order of their time of writing, so the states are those of the batches
    assert seen and all(s in states for s in seen)
    assert now(target) == states[-1]
    assert {"stream": 5} == target.manifest()["batches"]


def test_two_writers_lose_no_change(spark):
    one, parts = table(spark), batches()
    two = UpsertTable(spark, one.path, ["k"], one.schema, ["at", "v"])
    held = two.manifest()
    one.upsert(spark.createDataFrame(parts[0], SCHEMA), 0, "one")
    # the version it wanted is taken
    assert not two._publish({**held, "version": held["version"] + 1})
    two.upsert(spark.createDataFrame(parts[1], SCHEMA), 0, "two")
    assert now(one) == expected(parts[:2])
    assert now(UpsertTable(spark, one.path, ["k"], one.schema, ["at", "v"])) == expected(parts[:2])


def test_compaction_beside_a_new_batch_keeps_both(spark):
    target, parts = table(spark, ranges=1, max_files=1), batches()
    for i in (0, 1):
        target.upsert(spark.createDataFrame(parts[i], SCHEMA), i)
    real = target._rows

    def slow(entries):
        rows = real(entries)
        target._rows = real
        target.upsert(spark.createDataFrame(parts[2], SCHEMA), 2)  # comes in between
        return rows

    target._rows = slow
    assert target.compact() == [0]
    assert now(target) == expected(parts[:3])
    assert len(target.manifest()["live"]) == 2


def test_an_empty_table_has_no_rows(spark):
    target = table(spark)
    assert now(target) == [] and target.compact() == []


TOP_SCHEMA = "g string, id int, score int"


@pytest.mark.parametrize("n", [1, 3])
def test_changes_fold_to_the_first_rows_after_every_batch(spark, n):
    parts = [
        [("a", 10 * b + i, (37 * (10 * b + i)) % 11) for i in range(4)]
        + [(None, 100 + b, b), ("b" if b % 2 else "c", 200 + b, 5 - b)] for b in range(5)
    ]
    path = new_folder(spark, "source")
    for part in parts:
        spark.createDataFrame(part, TOP_SCHEMA).coalesce(1).write.mode("append").json(path)
    order = [F.desc("score"), F.asc("id")]
    stream = read_stream(spark, path, TOP_SCHEMA, "json", options={"maxFilesPerTrigger": "1"})
    out = new_folder(spark, "top")
    ranking.write_top_n(
        stream, ["g"], "id", order, n, out, new_folder(spark, "state"), ranges=2, max_files=1
    ).awaitTermination()
    changes = ranking.read_changes(spark, stream.schema, out)
    for b in range(len(parts)):
        rows = spark.createDataFrame([r for part in parts[: b + 1] for r in part], TOP_SCHEMA)
        want = sorted(map(tuple, sets.top_n(rows, ["g"], order, n).collect()), key=repr)
        got = sorted(map(tuple, ranking.folded(changes, "id", b).select("g", "id", "score").collect()), key=repr)
        assert got == want
    table = ranking.top_table(spark, stream.schema, ["g"], out)
    assert sorted((tuple(r)[:3] for r in table.read().collect()), key=repr) == want
    # some row was taken back, and none that never was in
    taken = {(r.id, r[BATCH]) for r in changes.where("change = '-'").collect()}
    entered = {r.id for r in changes.where("change = '+'").collect()}
    assert taken and {i for i, _ in taken} <= entered


def test_lives_end_and_are_renewed(spark):
    """State falls when rows expire, and a newer version keeps its row alive."""
    schema = "kind string, k string, id bigint, at string, v string"
    day = "2024-05-01 "
    big = 2**60 + 1
    parts = [
        [("l", "a", big, day + "00:00:00", "l1"), ("l", "b", 2, day + "00:00:00", "m1"),
         ("l", None, 9, day + "00:00:00", "lost")],
        [("l", "a", big, day + "00:50:00", "l2"), ("r", "a", big, day + "01:20:00", "r1")],
        [("r", "b", 8, day + "01:20:30", "r2"), ("l", "a", 3, day + "01:25:00", "l3")],
        [("r", "a", None, day + "01:40:00", "lost"), ("l", "z", 4, day + "09:00:00", "z")],
        [("l", "z", 4, day + "09:30:00", "z")],
    ]
    path = new_folder(spark, "source")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)
    rows = read_stream(spark, path, schema, "json", options={"maxFilesPerTrigger": "1"})
    rows = times.watermark(times.with_event_time(rows, "at", "yyyy-MM-dd HH:mm:ss"), "event_time", "1 second")
    left = rows.where("kind = 'l'").select(F.col("k").alias("lk"), F.col("id").alias("li"), F.col("v").alias("lv"), F.col("event_time").alias("lt"))
    right = rows.where("kind = 'r'").select(F.col("k").alias("rk"), F.col("id").alias("ri"), F.col("v").alias("rv"), F.col("event_time").alias("rt"))
    out = lifetimes.lasting_join(left, right, [("lk", "rk")], "li", "ri", "lt", "rt", "1 hour", "10 minutes")
    target, state = new_folder(spark, "out"), new_folder(spark, "state")
    query = sinks.write_append(out.select("li", "ri", "lv", "rv", "at"), target, state)
    query.awaitTermination()
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(target).collect())
    # l1 was renewed as l2 and meets r1; r1 still lives for l3; m1 had expired before r2
    assert got == [(3, big, "l3", "r1"), (big, big, "l2", "r1")]
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) > held[-1]


def test_lasting_join_in_a_session_with_another_state_store(spark):
    """Spark's own default store cannot hold map state; the session's setting is left as it was."""
    catalog.load()
    folder, name = "/root/testdata/sf0.001", "stream_lasting_join"
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, other)
    try:
        got = compare(spark, connect(folder), folder, catalog.QUERIES[name], catalog.SQL[name])
        assert got["match"] is True, got
        assert spark.conf.get(STATE_STORE) == other
    finally:
        spark.conf.set(STATE_STORE, before)


class _Store:
    """A state store of one value that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_the_store_is_called_per_bucket_and_not_per_row():
    rnd, store = random.Random(3), _Store()
    lives = [50_000, 20_000]
    join = lifetimes._Remembering(lives)
    join.init(store)
    held, mark = {}, 0
    for batch in range(6):
        rows = [
            Row(__at=batch * 30_000 + rnd.randrange(30_000), __side=rnd.randrange(2), __id=str(rnd.randrange(6)),
                __key=[str(rnd.randrange(5))], left=None, right=None)
            for _ in range(300)
        ]
        rows = [Row(**{**r.asDict(), lifetimes.SIDES[r["__side"]]: (batch, i)}) for i, r in enumerate(rows)]
        before = store.calls
        got = [tuple(r) for r in join.handleInputRows((7,), iter(rows), None)]
        assert store.calls - before <= 5
        want = []
        for r in sorted(rows, key=lambda r: (r["__at"], r["__side"], r["__id"])):
            at, side = r["__at"], r["__side"]
            own = r[lifetimes.SIDES[side]]
            for (key, other, _), (until, value) in held.items():
                if key == r["__key"][0] and other != side and until >= at:
                    want.append((own, value, at) if side == 0 else (value, own, at))
            known = (r["__key"][0], side, r["__id"])
            if known not in held or held[known][0] <= at + lives[side]:
                held[known] = at + lives[side], own
        assert sorted(got) == sorted(want) and got
        mark = (batch + 1) * 30 - 5
        for due in [t for t in store.timers if t <= mark]:
            store.timers.discard(due)
            assert list(join.handleExpiredTimer((7,), _At(mark), _At(due))) == []
            assert store.timers and min(store.timers) > mark
    store.timers.clear()
    assert list(join.handleExpiredTimer((7,), _At(10_000), _At(10_000))) == []
    assert store.value is None and not store.timers


def test_texts_of_keys_are_equal_where_values_are(spark):
    df = spark.sql("""
        select * from values (0.0d, timestamp'2024-01-01 00:00:00.000001', X'ff00', array(1, null), 1),
          (-0.0d, timestamp'2024-01-01 00:00:00.000002', X'ff01', array(1), 1),
          (double('nan'), timestamp'2024-01-01 00:00:00.000001', X'ff00', array(1, null), 2) as t(a, b, c, d, e)""")
    got = [tuple(r) for r in df.select(*[lifetimes._text(df, c) for c in df.columns]).collect()]
    for values in zip(*got):
        assert None not in values
    a, b, c, d, e = zip(*got)
    assert a[0] == a[1] != a[2] and b[0] == b[2] != b[1] and c[0] == c[2] != c[1] and d[0] == d[2] != d[1] and e[0] == e[1] != e[2]
