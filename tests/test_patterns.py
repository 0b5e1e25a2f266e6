"""Event patterns against trying every way to take rows, and streams against the batch."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rillcask.operators import patterns
from rillcask.operators.patterns import Automaton, Step, match_pattern, step
from rillcask.session import new_folder
from rillcask.sources.streams import read_stream
from rillcask.streaming import events as times
from rillcask.streaming import sequences

SYMBOLS = [
    Step(kinds, optional, repeated)
    for kinds in (("a",), ("b",), ("a", "b")) for optional in (False, True) for repeated in (False, True)
]
MARK = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}


def as_regex(steps):
    return re.compile("".join(f"[{''.join(s.kinds)}]{MARK[s.optional, s.repeated]}" for s in steps))


def plain_ends(line, regex, between):
    """Per row, the first row that ends a match begun there: by trying all strings, or all ways to
    leave rows out."""
    out = []
    for i in range(len(line)):
        found = None
        for e in range(i, len(line)):
            if between == "none":
                good = regex.fullmatch(line[i : e + 1])
            elif e == i:
                good = regex.fullmatch(line[i])
            else:
                inner = line[i + 1 : e]
                good = any(
                    regex.fullmatch(line[i] + "".join(itertools.compress(inner, keep)) + line[e])
                    for keep in itertools.product((0, 1), repeat=len(inner))
                )
            if good:
                found = e
                break
        out.append(found)
    return out


def walked_ends(line, steps, between):
    automaton, out = Automaton(steps, between), []
    ends = [None] * automaton.size
    for i in range(len(line) - 1, -1, -1):
        found = automaton.start(line[i], ends, (i, i))
        out.append(found and found[0])
        ends = automaton.back(line[i], ends, (i, i))
    return out[::-1]


def chunked_ends(line, steps, between, size):
    """The same with sums of chunks put together."""
    automaton, out = Automaton(steps, between), []
    behind = [None] * automaton.size
    for at in range((len(line) - 1) // size * size, -1, -size):
        ends, sets = [None] * automaton.size, [1 << s for s in range(automaton.size)]
        inner = list(behind)
        for i in range(min(len(line), at + size) - 1, at - 1, -1):
            out.append(automaton.start(line[i], inner, (i, i)))
            inner = automaton.back(line[i], inner, (i, i))
            ends = automaton.back(line[i], ends, (i, i))
            sets = automaton.back_set(line[i], sets)
        behind = [
            own or min((e for s, e in enumerate(behind) if held >> s & 1 and e), default=None)
            for own, held in zip(ends, sets)
        ]
    return [e and e[0] for e in out[::-1]]


def lines(rnd, n, size):
    return ["".join(rnd.choices("abx", k=rnd.randint(1, size))) for _ in range(n)]


@pytest.mark.parametrize("between", ["any", "none"])
@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_all_patterns_of_the_grammar(between, length):
    rnd = random.Random(length)
    for steps in itertools.product(SYMBOLS, repeat=length):
        if all(s.optional for s in steps):
            with pytest.raises(ValueError):
                Automaton(list(steps), between)
            continue
        regex = as_regex(steps)
        for line in lines(rnd, 6 if length < 3 else 1, 6):
            want = plain_ends(line, regex, between)
            assert walked_ends(line, list(steps), between) == want, (steps, line)
            assert chunked_ends(line, list(steps), between, 2) == want, (steps, line)


STEPS = [step("a"), step("b", repeated=True), step("c", optional=True), step("d", "a")]


def sample(seed, n=400):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["u", "u", "u", "v", "w"]), 2**60 + i, rnd.randint(0, 300), rnd.choice("abbcdx")) for i in range(n)]
    return rows + [(None, 1, 5, "a"), ("u", None, 6, "a"), ("v", 2, None, "a"), ("w", 3, 7, None)]


def plain(rows, steps, within, between):
    out, automaton = [], as_regex(steps)
    for key in {r[0] for r in rows} - {None}:
        own = sorted(r[1:] for r in rows if r[0] == key and r[1] is not None and r[2] is not None)
        own = sorted(own, key=lambda r: (r[1], r[0]))
        letters = [r[2] or "x" for r in own]
        known = set("abcd")
        for i in range(len(own)):
            if between == "none":
                ends = [e for e in range(i, min(len(own), i + 30)) if automaton.fullmatch("".join(letters[i : e + 1]))]
            else:
                ends = _reach(letters, i, steps, known)
            if ends and own[ends[0]][1] - own[i][1] <= within:
                out.append((key, own[i][0], own[i][1], own[ends[0]][0], own[ends[0]][1]))
    return sorted(out)


def _reach(letters, i, steps, known):
    """First end of a match from row i by walking forward with all ways at once."""
    def after(state, kind):
        out = set()
        if state and steps[state - 1].repeated and kind in steps[state - 1].kinds:
            out.add(state)
        for to in range(state + 1, len(steps) + 1):
            if kind in steps[to - 1].kinds:
                out.add(to)
            if not steps[to - 1].optional:
                break
        return out

    states = after(0, letters[i])
    for e in range(i, len(letters)):
        if e > i:
            fresh = {t for s in states for t in after(s, letters[e])}
        else:
            fresh = states
        if any(all(s.optional for s in steps[t:]) for t in fresh):
            return [e]
        states = states | fresh
    return []


def table(spark, rows):
    df = spark.createDataFrame(rows, "k string, id bigint, s int, kind string")
    return df.select("k", "id", F.timestamp_seconds("s").alias("ts"), "kind", F.lit(1).alias("chunk"), F.lit("z").alias("at"))


def got(df):
    return sorted((r[0], r[1], int(r[2].timestamp()), r[3], int(r[4].timestamp())) for r in df.collect())


@pytest.mark.parametrize("between", ["any", "none"])
@pytest.mark.parametrize("hot", [None, 7])
def test_tables_equal_the_plain_matcher(spark, between, hot):
    rows = sample(1)
    found = match_pattern(table(spark, rows), ["k"], "ts", "kind", STEPS, "20 seconds", "id", between, hot=hot)
    assert got(found) == plain(rows, STEPS, 20, between)


def test_unmatched_beginnings_and_empty_tables(spark):
    rows = [("u", 1, 0, "a"), ("u", 2, 5, "b"), ("u", 3, 90, "d"), ("u", 4, 95, "c")]
    found = match_pattern(table(spark, rows), ["k"], "ts", "kind", STEPS, "20 seconds", "id", unmatched=True)
    assert [(r.id, r.end_id) for r in found.collect()] == [(1, None)]
    assert match_pattern(table(spark, []), ["k"], "ts", "kind", STEPS, "20 seconds", "id").collect() == []


@pytest.mark.parametrize("between", ["any", "none"])
def test_streams_equal_the_batch(spark, between):
    """Batches hold all times, so later ones end, shift and undo matches of earlier ones."""
    rows = [r for r in sample(2, 150) if None not in r[:3]]
    path, out = new_folder(spark, "source"), new_folder(spark, "patterns")
    for i in range(3):
        table(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, table(spark, []).schema, options={"maxFilesPerTrigger": "1"})
    sequences.write_patterns(
        stream, ["k"], "ts", "kind", STEPS, "20 seconds", "id", out, new_folder(spark, "state"), between
    ).awaitTermination()
    found = sequences.read_patterns(spark, stream, ["k"], "ts", "id", out)
    assert got(found) == plain(rows, STEPS, 20, between)


def test_days_out_of_reach_are_dropped(spark):
    """Twenty days, one a batch: only those that late rows and open matches can reach stay stored."""
    rows = [("u", 10 * d + i, 86_400 * d + 3600 * i, k) for d in range(20) for i, k in enumerate("abd")]
    path, out = new_folder(spark, "source"), new_folder(spark, "patterns")
    for d in range(20):
        table(spark, rows[3 * d : 3 * d + 3]).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, table(spark, []).schema, options={"maxFilesPerTrigger": "1"})
    stream = times.watermark(stream, "ts", "1 day")
    sequences.write_patterns(
        stream, ["k"], "ts", "kind", STEPS, "1 day", "id", out, new_folder(spark, "state"), "any", late="1 day"
    ).awaitTermination()
    assert len(sequences._days_in(spark, f"{out}/rows")) <= 4
    found = sequences.read_patterns(spark, stream, ["k"], "ts", "id", out)
    assert got(found) == plain(rows, STEPS, 86_400, "any")


def test_remembered_moves_are_the_automatons():
    """Each state and kind is worked out once, whatever the number of rows."""
    rnd = random.Random(9)
    for steps in ([step("a"), step("b", repeated=True), step("c", optional=True), step("d", "a")],
                  [step("a", repeated=True), step("a", "b", optional=True), step("b")]):
        for between in ("any", "none"):
            automaton, asked = Automaton(steps, between), []
            walker = patterns._Walker(automaton, True)
            walker.enter(("k", 0), [None] * automaton.size)
            ends, sets = [None] * automaton.size, [1 << s for s in range(automaton.size)]
            for i in range(3000, 0, -1):
                kind = rnd.choice(["a", "b", "c", "d", None])
                move = walker.done[walker.state].get(kind)
                if move is None:
                    asked.append(kind)
                    move = walker.moved(walker.state, kind)
                state, kept, start = move
                found = None if start is None else i if start < 0 else walker.known[start]
                assert found == automaton.start(kind, ends, i)
                ends, sets = automaton.back(kind, ends, i), automaton.back_set(kind, sets)
                if kept is not None:
                    walker.known = [walker.known[p] if p >= 0 else i for p in kept]
                walker.state = state
                assert walker.ends() == ends and list(walker.shapes[state][1]) == sets
            assert len(asked) < 1000


def test_ends_travel_as_bytes(spark):
    """Spark's Arrow writer walks the nulls of a list column again after every row."""
    rows = spark.createDataFrame([("u", i, i, "ab"[i % 2]) for i in range(40)], "k string, id long, at long, kind string")
    got = match_pattern(rows.select("k", "id", "kind", F.timestamp_seconds("at").alias("t")), ["k"], "t", "kind",
                        [step("a"), step("b")], "5 seconds", "id", "none", hot=7)
    assert len(got.collect()) == 20
    text = got._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in text and "as array<struct" not in text
