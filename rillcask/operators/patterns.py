"""Event patterns: steps that may be optional, repeated or alternatives, matched per key in order.

The automaton has one state per step: "the last row taken belongs to this step". Rows are walked
from the last to the first, and for every state the earliest row that ends a match is known. What a
chunk of rows does to these ends depends on the chunk alone: a state either finds an end inside, or
leaves the chunk in some set of states. Chunks of a hot key are therefore summed up side by side,
the sums are put together per key, and the chunks are walked again with the ends behind them known.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rillcask.functions.times import seconds
from rillcask.operators.ordered import Limit
from rillcask.operators.skew import POS, find_hot, pinned, positions, split_hot


class Step(NamedTuple):
    """Rows of one of ``kinds``: one, none or one (optional), one or more (repeated), any number."""

    kinds: tuple[str, ...]
    optional: bool = False
    repeated: bool = False


def step(*kinds: str, optional: bool = False, repeated: bool = False) -> Step:
    return Step(kinds, optional, repeated)


class Automaton:
    """Moves of a pattern. State 0 has taken no row, state i took its last row for step i."""

    def __init__(self, steps: list[Step], between: str) -> None:
        if not steps or all(s.optional for s in steps):
            raise ValueError("a pattern needs a step that is not optional")
        if between not in ("any", "none"):
            raise ValueError("rows between steps: any or none")
        self.size, self.skips = len(steps) + 1, between == "any"
        self.final = [all(s.optional for s in steps[i:]) for i in range(self.size)]
        self.final[0] = False
        self.moves: dict[str, list[list[int]]] = {}
        for kind in {k for s in steps for k in s.kinds}:
            table = [[] for _ in range(self.size)]
            for state in range(self.size):
                if state and steps[state - 1].repeated and kind in steps[state - 1].kinds:
                    table[state].append(state)
                for to in range(state + 1, self.size):
                    if kind in steps[to - 1].kinds:
                        table[state].append(to)
                    if not steps[to - 1].optional:
                        break
            self.moves[kind] = table

    def start(self, kind: str | None, ends: list, here):
        """End of the match that begins with a row of this kind, given the ends behind it."""
        best = None
        for to in self.moves[kind][0] if kind in self.moves else ():
            if self.final[to]:
                return here
            if ends[to] is not None and (best is None or ends[to] < best):
                best = ends[to]
        return best

    def back(self, kind: str | None, ends: list, here) -> list:
        """Ends as they are before this row. An end is (time, id), as is ``here``."""
        table = self.moves.get(kind)
        if table is None:
            return ends if self.skips else [None] * self.size
        out = list(ends) if self.skips else [None] * self.size
        for state, targets in enumerate(table):
            for to in targets:
                end = here if self.final[to] else ends[to]
                if end is not None and (out[state] is None or end < out[state]):
                    out[state] = end
        return out

    def back_set(self, kind: str | None, sets: list[int]) -> list[int]:
        """Sets of states (as bits) in which each state may leave the chunk without an end."""
        table = self.moves.get(kind)
        out = list(sets) if self.skips else [0] * self.size
        for state, targets in enumerate(table or ()):
            for to in targets:
                if not self.final[to]:
                    out[state] |= sets[to]
        return out


class _Walker:
    """Takes rows that come last first, group by group, and remembers what each kind of row did.

    Every row is earlier than all ends known so far, so what it does depends only on its kind and on
    which states share an end: ends are kept as a list from the earliest to the latest, and a state
    of the walk says for each state of the automaton which of them it has. Each (state, kind) is
    worked out once, by the automaton itself.
    """

    def __init__(self, automaton: Automaton, with_sets: bool) -> None:
        self.automaton, self.with_sets = automaton, with_sets
        self.group, self.known = None, []
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.done: list[dict] = []

    def number(self, shape: tuple) -> int:
        """Number of a shape: per state of the automaton its end's place, and its set of states."""
        if shape not in self.numbers:
            self.numbers[shape] = len(self.shapes)
            self.shapes.append(shape)
            self.done.append({})
        return self.numbers[shape]

    def enter(self, group, ends: list) -> None:
        self.group = group
        if len(self.shapes) > SHAPES:
            self.forget()
        self.known = sorted({e for e in ends if e is not None})
        places = tuple(None if e is None else self.known.index(e) for e in ends)
        sets = tuple(1 << s for s in range(self.automaton.size)) if self.with_sets else ()
        self.state = self.number((places, sets))

    def moved(self, state: int, kind: str | None) -> tuple:
        """(next state, ends kept by place, end of the match begun here by place); place -1 is the
        row itself. Ends are None where all stay as they are."""
        places, sets = self.shapes[state]
        start = self.automaton.start(kind, places, -1)
        after = self.automaton.back(kind, places, -1)
        if self.with_sets:
            sets = tuple(self.automaton.back_set(kind, sets))
        kept = sorted({p for p in after if p is not None})
        shape = (tuple(None if p is None else kept.index(p) for p in after), sets)
        kept = None if kept == list(range(len(self.known))) else kept
        move = self.done[state][kind] = self.number(shape), kept, start
        return move

    def ends(self) -> list:
        return [None if p is None else self.known[p] for p in self.shapes[self.state][0]]


SHAPES = 100_000  # remembered, at most


def _plain(column: pa.Array) -> list:
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple]:
    """(group, rows of the batch) for rows in a row of the same keys and chunk."""
    columns = [_plain(batch.column(i)) for i in range(n_keys + 1)]
    groups = zip(*columns)
    at, group = 0, next(groups, None)
    for i, other in enumerate(groups, 1):
        if other != group:
            yield group, range(at, i)
            at, group = i, other
    if group is not None:
        yield group, range(at, batch.num_rows)


def _columns(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple]:
    columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
    for row in zip(*columns):
        yield row[: n_keys + 1], *row[n_keys + 1 :]


def _walk(automaton: Automaton, n_keys: int, within: int, unmatched: bool, schema: pa.Schema):
    """Rows (keys, chunk, at, kind, id, carried), each chunk's last row first; a marker row with the
    ends behind comes before them. Gives (keys, id, at, end id, end at) per match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker(automaton, False)
        for batch in batches:
            out = []
            times, kinds, ids = (_plain(batch.column(n_keys + i)) for i in (1, 2, 3))
            for group, rows in _runs(batch, n_keys):
                if group != walker.group:
                    carried = batch.column(n_keys + 4)[rows[0]].as_py()
                    walker.enter(group, pickle.loads(carried) if carried else [None] * automaton.size)
                    if times[rows[0]] is None:
                        rows = rows[1:]
                state, known, done = walker.state, walker.known, walker.done
                for i in rows:
                    kind = kinds[i]
                    move = done[state].get(kind)
                    if move is None:
                        walker.known = known
                        move = walker.moved(state, kind)
                    state, kept, start = move
                    if start is not None or unmatched:
                        at, own = times[i], ids[i]
                        end = None if start is None else (at, own) if start < 0 else known[start]
                        if end is not None and end[0] - at > within:
                            end = None
                        if end is not None or unmatched and any(automaton.moves.get(kind, [()])[0]):
                            out.append((*group[:-1], own, at, end and end[1], end and end[0]))
                    if kept is not None:
                        known = [known[p] if p >= 0 else (times[i], ids[i]) for p in kept]
                walker.state, walker.known = state, known
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _sum_up(automaton: Automaton, n_keys: int, schema: pa.Schema):
    """Rows (keys, chunk, at, kind, id) in the same order; gives (keys, chunk, ends and sets) per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker(automaton, True)

        def row():
            return (*walker.group, pickle.dumps((walker.ends(), walker.shapes[walker.state][1])))

        for batch in batches:
            out = []
            times, kinds, ids = (_plain(batch.column(n_keys + i)) for i in (1, 2, 3))
            for group, rows in _runs(batch, n_keys):
                if group != walker.group:
                    if walker.group is not None:
                        out.append(row())
                    walker.enter(group, [None] * automaton.size)
                state, known, done = walker.state, walker.known, walker.done
                for i in rows:
                    kind = kinds[i]
                    move = done[state].get(kind)
                    if move is None:
                        walker.known = known
                        move = walker.moved(state, kind)
                    state, kept, _ = move
                    if kept is not None:
                        known = [known[p] if p >= 0 else (times[i], ids[i]) for p in kept]
                walker.state, walker.known = state, known
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if walker.group is not None:
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip(row(), schema)], schema=schema)

    return run


def _put_together(size: int, n_keys: int, schema: pa.Schema):
    """Sums of a key's chunks, the last one first; gives the ends behind each of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, []
        for batch in batches:
            out = []
            for group, summed in _columns(batch, n_keys):
                if group[:-1] != key:
                    key, ends = group[:-1], [None] * size
                out.append((*group, pickle.dumps(ends)))
                found, sets = pickle.loads(summed)
                ends = [
                    own or min((e for s, e in enumerate(ends) if states >> s & 1 and e), default=None)
                    for own, states in zip(found, sets)
                ]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def match_pattern(
    df: DataFrame, keys: list[str], ts: str, kind: str, steps: list[Step], within: str, tiebreak: str,
    between: str = "any", unmatched: bool = False, hot: Limit = None,
) -> DataFrame:
    """keys, ``tiebreak``, start, end_id, end: for each row that can begin it, the match that ends first.

    Rows of a key are in the order of ``ts`` and ``tiebreak`` (unique). ``between`` says whether rows
    that no step takes may lie in a match: ``any``, or ``none``, where every next row must be taken.
    A match ends with the earliest row that completes the steps, at most ``within`` after its start.
    ``unmatched`` also gives the rows that begin with a first step and find no end, with nulls.
    Rows without key, time or id are left out; a null kind is a row that no step takes.

    Keys with more rows than a task may hold are cut into chunks (see the module); the others are
    walked in one pass over sorted partitions, without gathering a key.
    """
    automaton = Automaton(steps, between)
    named = [F.col(c) for c in keys]
    rows = df.select(
        *[c.alias(f"k{i}") for i, c in enumerate(named)], F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(kind).alias("kind"), F.col(tiebreak).alias("id"),
    ).where(" and ".join(f"{c} is not null" for c in [*[f"k{i}" for i in range(len(keys))], "at", "id"]))
    if between == "any":
        rows = rows.where(F.col("kind").isin(*automaton.moves))
    part, order = [f"k{i}" for i in range(len(keys))], [F.col("at"), F.col("id")]
    kinds = {c: rows.schema[c].dataType for c in [*part, "id"]}
    hot = find_hot(rows, part, hot)
    # Ends go between tasks as bytes: Spark's Arrow writer sizes a batch again after each row, and for
    # lists that are null it walks all of them each time
    columns = [*part, "chunk", "at", "kind", "id", F.lit(None).cast("binary").alias("carried")]
    if hot:
        cold, big = split_hot(rows, part, hot.groups)
        chunk = F.floor((F.col(POS) - 1) / hot.limit)
        laid = positions(big, part, order, hot).withColumn("chunk", chunk).select(*columns)
        markers = _markers(laid, automaton, part, kinds)
        walked = cold.withColumn("chunk", F.lit(0).cast("long")).select(*columns).unionByName(laid).unionByName(markers)
    else:
        walked = rows.withColumn("chunk", F.lit(0).cast("long")).select(*columns)
    made = T.StructType([
        *[T.StructField(p, kinds[p]) for p in part], T.StructField("id", kinds["id"]), T.StructField("at", T.LongType()),
        T.StructField("end_id", kinds["id"]), T.StructField("end", T.LongType()),
    ])
    found = _sorted(walked, part).mapInArrow(
        _walk(automaton, len(part), seconds(within) * 1_000_000, unmatched, to_arrow_schema(made)), made
    )
    kind_of = df.schema[ts].dataType
    return found.select(
        *[F.col(p).alias(k) for p, k in zip(part, keys)], F.col("id").alias(tiebreak),
        F.timestamp_micros("at").cast(kind_of).alias("start"), "end_id",
        F.timestamp_micros("end").cast(kind_of).alias("end"),
    )


def _sorted(rows: DataFrame, part: list[str]) -> DataFrame:
    """Chunks side by side, each from its last row to its first, the marker before."""
    return rows.repartition(*part, "chunk").sortWithinPartitions(
        *part, "chunk", F.col("at").desc_nulls_first(), F.col("id").desc()
    ).select(*part, "chunk", "at", "kind", "id", "carried")


def _markers(laid: DataFrame, automaton: Automaton, part: list[str], kinds: dict) -> DataFrame:
    """One row per chunk of the hot keys with the ends behind it."""
    keys = [*[T.StructField(p, kinds[p]) for p in part], T.StructField("chunk", T.LongType())]
    sums = T.StructType([*keys, T.StructField("summed", T.BinaryType())])
    summed = pinned(_sorted(laid, part).drop("carried").mapInArrow(_sum_up(automaton, len(part), to_arrow_schema(sums)), sums))
    behind = T.StructType([*keys, T.StructField("carried", T.BinaryType())])
    return summed.repartition(*part).sortWithinPartitions(*part, F.col("chunk").desc()).mapInArrow(
        _put_together(automaton.size, len(part), to_arrow_schema(behind)), behind
    ).select(
        *part, "chunk", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast(kinds["id"]).alias("id"), "carried",
    )
