"""Joins. Equality joins leave the strategy to the optimizer, which broadcasts a side
only when its measured size allows it and splits skewed partitions at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillcask.functions.times import seconds
from rillcask.operators.ordered import Limit, filled
from rillcask.operators.skew import find_hot

Pairs = list[tuple[str, str]]


def _equal(pairs: Pairs) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in pairs])


def enrich(rows: DataFrame, table: DataFrame, pairs: Pairs, how: str = "left") -> DataFrame:
    """Look rows up in a keyed table. Column names must differ between the sides."""
    return rows.join(table, _equal(pairs), how)


def enrich_many(rows: DataFrame, tables: list[tuple[DataFrame, Pairs]]) -> DataFrame:
    """Several left look-ups; keys of the rows stay, attributes are NULL when unmatched."""
    for table, pairs in tables:
        kept = [c for c in table.columns if c not in [y for _, y in pairs]]
        rows = rows.join(table, _equal(pairs), "left").select(*rows.columns, *kept)
    return rows


def join_tables(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def interval_join(
    left: DataFrame, right: DataFrame, pairs: Pairs, left_ts: str, right_ts: str,
    before: str, after: str, grace: str | None = None, how: str = "inner",
    spread: str | None = "right",
) -> DataFrame:
    """Rows with equal keys where the right time lies in [left - before, left + after].

    Time is cut into slices as long as the whole interval. A row of one side belongs to
    one slice, a row of the other to the one or two it can reach, and the slice joins the
    equality key: a hot key spreads over its slices and no key compares all its pairs.
    ``spread`` names the side whose rows are repeated; it should be the smaller one, and
    may be the left only for inner joins. None leaves the slices out: for keys with few rows
    each, such as an order id, they would only double the rows. The same body runs on streams,
    where ``grace`` is the watermark delay of both sides.
    """
    if spread == "left" and how != "inner":
        raise ValueError("only an inner join may repeat its left rows")
    back, ahead = seconds(before), seconds(after)
    width = max(back + ahead, 1) * 1_000_000
    if grace and left.isStreaming:
        left = left.withWatermark(left_ts, grace)
    if grace and right.isStreaming:
        right = right.withWatermark(right_ts, grace)

    bounds = (
        (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL '{back}' SECOND"))
        & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL '{ahead}' SECOND"))
    )
    if spread is None:
        return left.join(right, _equal(pairs) & bounds, how)

    def micros(ts: str) -> Column:
        return F.unix_micros(F.col(ts).cast("timestamp"))

    def slices(ts: str, earlier: int, later: int) -> Column:
        first = F.floor((micros(ts) - earlier * 1_000_000) / width)
        last = F.floor((micros(ts) + later * 1_000_000) / width)
        return F.explode(F.sequence(first, last))

    if spread == "left":
        sliced_left = left.withColumn("__slice", slices(left_ts, back, ahead))
        sliced_right = right.withColumn("__slice_r", F.floor(micros(right_ts) / width))
    else:
        sliced_left = left.withColumn("__slice", F.floor(micros(left_ts) / width))
        sliced_right = right.withColumn("__slice_r", slices(right_ts, ahead, back))
    match = _equal(pairs) & (F.col("__slice") == F.col("__slice_r")) & bounds
    return sliced_left.join(sliced_right, match, how).drop("__slice", "__slice_r")


def ttl_join(
    left: DataFrame, right: DataFrame, pairs: Pairs, left_ts: str, right_ts: str,
    left_ttl: str, right_ttl: str, grace: str | None = None, how: str = "inner",
) -> DataFrame:
    """Regular stream join whose sides forget rows after a time to live.

    A pair meets when the later row arrives before the earlier one expired, so the
    lifetimes are the two bounds of an interval join in event time.
    """
    return interval_join(
        left, right, pairs, left_ts, right_ts, right_ttl, left_ttl, grace, how
    )


def asof_join(
    left: DataFrame, right: DataFrame, pairs: Pairs, left_ts: str, right_ts: str,
    tiebreak: str, forward: bool = False, strict: bool = False, hot: Limit = None,
) -> DataFrame:
    """Each left row with the right row valid at its time, or NULLs.

    Both sides are stacked, sorted once per key, and the last right row is carried
    along: one shuffle and one output row per left row. ``forward`` looks for the next
    right row instead; ``strict`` leaves out equal times. ``tiebreak`` orders right rows
    of one time: the last of them counts, or the first when looking forward.
    """
    keys = [f"__k{i}" for i in range(len(pairs))]
    # at equal times the right row comes first, unless equal times must not match
    right_side, left_side = (1, 0) if strict else (0, 1)

    def stacked(df: DataFrame, own: list[str], ts: str, side: int, kept: str, other: str,
                other_type, tie: Column) -> DataFrame:
        return df.select(
            *[F.col(c).alias(k) for c, k in zip(own, keys)], F.col(ts).alias("__t"),
            F.lit(side).alias("__side"), tie.alias("__tie"),
            F.struct(*df.columns).alias(kept), F.lit(None).cast(other_type).alias(other),
        )

    # a NULL key matches nothing: such left rows go past the window, so they can't crowd a task
    for _, y in pairs:
        right = right.where(F.col(y).isNotNull())
    keyed = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x, _ in pairs], F.lit(True))
    unkeyed = left.where(~keyed).select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    )
    left = left.where(keyed)
    left_type = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    right_type = right.select(F.struct(*right.columns).alias("x")).schema["x"].dataType
    tie_type = right.schema[tiebreak].dataType
    both = stacked(
        left, [x for x, _ in pairs], left_ts, left_side, "__left", "__right", right_type,
        F.lit(None).cast(tie_type),
    ).unionByName(
        stacked(
            right, [y for _, y in pairs], right_ts, right_side, "__right", "__left", left_type,
            F.col(tiebreak),
        )
    )
    time, tie = F.col("__t"), F.col("__tie")
    order = [time.desc() if forward else time, F.col("__side"), tie.desc() if forward else tie]
    found = filled(both, keys, order, "__right", "__found", hot)
    found = found.where(F.col("__side") == left_side).select(
        "__left.*", *[F.col(f"__found.{c}").alias(c) for c in right.columns]
    )
    return found.unionAll(unkeyed) if pairs else found


def retained(hist: DataFrame, current: DataFrame, key: str, weight: str = "matches") -> DataFrame:
    """Rows of one period whose key is active in another.

    ``weight`` counts the matching rows; a row-by-row join would repeat the row that
    many times, so sums over the weight equal sums over the join without the pairs.
    """
    counts = current.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias(weight))
    return hist.join(counts, F.col(key) == F.col("__key")).drop("__key")


def retained_pairs(
    hist: DataFrame, current: DataFrame, key: str, prefix: str = "now_"
) -> DataFrame:
    """Rows of one period joined with all rows of another with the same key: columns of both
    sides, the second one's prefixed. ``retained`` counts where the pairs are not needed."""
    now = current.select(*[F.col(c).alias(f"{prefix}{c}") for c in current.columns])
    return hist.join(now, F.col(key) == F.col(f"{prefix}{key}"))


def semi(df: DataFrame, keys_df: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is IN the other table."""
    return df.join(keys_df.select(F.col(other or key).alias("__in")),
                   F.col(key) == F.col("__in"), "left_semi")


def flag_in(
    df: DataFrame, keys_df: DataFrame, key: str, name: str, other: str | None = None
) -> DataFrame:
    """Boolean: is the key in the other table? Never NULL."""
    known = keys_df.select(F.col(other or key).alias("__in")).where("__in is not null").distinct()
    return df.join(known, F.col(key) == F.col("__in"), "left").withColumn(
        name, F.col("__in").isNotNull()
    ).drop("__in")


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner."""
    return df.join(other, on, "left_anti")


def not_in(df: DataFrame, keys_df: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """SQL NOT IN: a NULL in the list leaves no rows, an empty list leaves all.

    An equality anti join plus two facts about the list, each a scalar subquery, stays
    scalable where the literal form turns into a nested loop over a large list.
    """
    listed = keys_df.select(F.col(other or key).alias("__in"))
    total = listed.agg(F.count(F.lit(1))).scalar()
    nulls = listed.agg(F.count_if(F.col("__in").isNull())).scalar()
    kept = df.join(listed, F.col(key) == F.col("__in"), "left_anti")
    return kept.where((total == 0) | (F.col(key).isNotNull() & (nulls == 0)))


def left_join_on(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    return left.join(right, condition, "left")


def vs_global(df: DataFrame, values: dict[str, Column], of: DataFrame | None = None) -> DataFrame:
    """Add whole-table aggregates as constants (scalar subqueries)."""
    source = df if of is None else of
    return df.withColumns({name: source.agg(agg).scalar() for name, agg in values.items()})


def sequence_match(
    df: DataFrame, key: str, ts: str, kind: str, steps: list[str], within: str, tiebreak: str,
    hot: Limit = None,
) -> DataFrame:
    """Rows of ``steps[0]`` followed in order by the other steps within a time limit.

    Every step takes the next later row of its kind; output has a time per step. The rows of all
    steps are read once and lie in one order, the latest first. From the last step backwards, each
    row hands its time and those of the steps after it on to the earlier rows, so the passes share
    one shuffle and one sort. Rows of one time don't follow each other: earlier steps come first
    in the order and see only what lies strictly later.
    """
    matching = F.array_compact(F.array(*[
        F.when(F.col(kind) == step, F.lit(i)) for i, step in enumerate(steps, start=1)
    ]))
    rows = df.where(F.col(kind).isin(*steps) & F.col(key).isNotNull()).select(
        key, tiebreak, F.col(ts).alias("__t"), F.explode(matching).alias("__step")
    )
    hot = find_hot(rows, [key], hot)
    order = [F.col("__t").desc(), F.col("__step").asc(), F.col(tiebreak).desc()]
    for i in range(len(steps), 1, -1):
        later = [F.col(f"__after_{i + 1}.step_{j}") for j in range(i + 1, len(steps) + 1)]
        own = F.when(F.col("__step") == i, F.struct(F.col("__t").alias(f"step_{i}"), *later))
        rows = filled(
            rows.withColumn("__own", own), [key], order, "__own", f"__after_{i}", hot
        ).drop("__own")
    last = F.col("step_1") + F.expr(f"INTERVAL '{seconds(within)}' SECOND")
    out = rows.where(F.col("__step") == 1).select(
        key, tiebreak, F.col("__t").alias("step_1"),
        *[F.col(f"__after_2.step_{j}").alias(f"step_{j}") for j in range(2, len(steps) + 1)],
    )
    return out if len(steps) == 1 else out.where(F.col(f"step_{len(steps)}") <= last)
