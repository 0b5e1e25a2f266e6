"""A join of two changing tables on a stream, each of which forgets its rows on its own clock."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from rillcask.functions.times import seconds

SIDES = ("left", "right")
BUCKETS = 4096


class _Remembering(StatefulProcessor):
    """State of a bucket of join keys: per key and side, the last version of each row and until when
    it lives. It is read, written and timed as a whole, once per batch: a call to the state store
    costs as much as joining hundreds of rows."""

    def __init__(self, lives: list[int]) -> None:
        self.lives = lives

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", T.StructType([T.StructField("held", T.BinaryType())]))

    def _read(self) -> tuple[int | None, dict]:
        """When the bucket's timer is due, in milliseconds; {key: (rows of the left, of the right)}."""
        return pickle.loads(self.state.get()[0]) if self.state.exists() else (None, {})

    def _write(self, due: int | None, held: dict) -> None:
        """Keep the rows, with a timer for the first of them that ends; a timer that is due by then stays."""
        if not held:
            self.state.clear()
            return
        first = min(until for sides in held.values() for rows in sides for until, _ in rows.values()) // 1000 + 1
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self.state.update((pickle.dumps((due, held)),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, held = self._read()
        # what arrives in one batch is taken in the order of its time; the left side first on ties
        for row in sorted(rows, key=lambda r: (r["__at"], r["__side"], r["__id"])):
            at, side = row["__at"], row["__side"]
            own = row[SIDES[side]]
            sides = held.setdefault(tuple(row["__key"]), ({}, {}))
            for until, other in sides[1 - side].values():
                if until >= at:
                    pair = (own, other) if side == 0 else (other, own)
                    yield Row(left=pair[0], right=pair[1], at=at)
            known = row["__id"]
            until = at + self.lives[side]
            if known not in sides[side] or sides[side][known][0] <= until:
                sides[side][known] = until, own
        self._write(due, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        kept = {}
        for known, sides in self._read()[1].items():
            sides = tuple({i: r for i, r in rows.items() if r[0] >= now} for rows in sides)
            if any(sides):
                kept[known] = sides
        self._write(None, kept)
        return iter(())

    def close(self) -> None:
        pass


def _text(df: DataFrame, name: str) -> Column:
    """Text that is equal where Spark holds the values for equal."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0).cast(kind)  # no -0.0
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        value = F.to_json(F.struct(value), {
            "ignoreNullFields": "false", "timestampFormat": f"{micros}XXX", "timestampNTZFormat": micros,
        })
    return value.cast("string")


def lasting_join(
    left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str,
    left_ts: str, right_ts: str, left_life: str, right_life: str,
) -> DataFrame:
    """Join of two streams that are tables: the last row per id counts.

    A row lives for its side's life from its time on; a newer version of the same id takes its
    place and lives anew. Each row that arrives is joined with all rows of the other side that live
    at its time, so a pair appears again when one of its rows is renewed: upsert the result by both
    ids. ``at`` is the time of the row that arrived. Lives are counted in event time, so results do
    not depend on how fast the stream is read; rows of one batch are taken in the order of their
    time. State is dropped when the watermark passes the end of a life. Both sides need a
    watermark; keys and ids that are null match nothing. Join keys are dealt by hash into ``BUCKETS``
    (the same for the life of a checkpoint), whose state is kept together. Only Spark's RocksDB store can hold this
    state: in a session with another store, start the stream inside ``session.rocksdb_state``.
    """
    def one(df: DataFrame, side: int, keys: list[str], own: str, ts: str) -> DataFrame:
        kinds = [left, right]
        values = [
            F.struct(*df.columns) if i == side else F.lit(None).cast(T.StructType(kinds[i].schema.fields))
            for i in (0, 1)
        ]
        known = [F.col(c).isNotNull() for c in (*keys, own)]
        for condition in known:
            df = df.where(condition)
        return df.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ts).alias("__time"),
            F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), F.lit(side).alias("__side"),
            _text(df, own).alias("__id"), *[v.alias(n) for v, n in zip(values, SIDES)],
        )

    both = one(left, 0, [x for x, _ in pairs], left_id, left_ts).unionByName(
        one(right, 1, [y for _, y in pairs], right_id, right_ts)
    )
    schemas = [T.StructType(df.schema.fields) for df in (left, right)]
    made = T.StructType([
        T.StructField("left", schemas[0]), T.StructField("right", schemas[1]), T.StructField("at", T.LongType()),
    ])
    lives = [seconds(life) * 1_000_000 for life in (left_life, right_life)]
    key = F.array(*[_text(both, f"__k{i}") for i in range(len(pairs))])
    dealt = both.select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__bucket"), key.alias("__key"),
        *[c for c in both.columns if not c.startswith("__k")],
    )
    out = dealt.groupBy("__bucket").transformWithState(_Remembering(lives), made, "append", "eventTime")
    return out.select("left.*", "right.*", F.timestamp_micros("at").alias("at"))
