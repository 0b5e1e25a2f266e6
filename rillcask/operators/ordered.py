"""OVER functions that keep working when one group holds much of the table.

Every function takes the group columns ``part`` and an ``order`` that ends in a unique
column. Groups within the limit use a plain window; larger ones are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillcask.operators.skew import (
    POS, SIZE, Hot, find_hot, hot_in, pinned, positions, same, settled, split_hot,
)

Limit = Hot | int | None
SLICE_ROWS = 100_000  # rows in a slice of time, about
SLICE_PIECES = 512  # slices as long as a frame, at most

WindowColumns = dict[str, Callable[[WindowSpec], Column]]


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def windowed(
    df: DataFrame, part: list[str], order: list[str | Column], cols: WindowColumns,
    reach: int, hot: Limit = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``reach`` rows back.

    A hot group is cut into chunks by position. The last ``reach`` rows of a chunk are
    also sent to the next one, so each chunk sees its whole frames.
    """
    hot = find_hot(df, part, hot)
    order = _columns(order)

    def add(rows: DataFrame, spec: WindowSpec) -> DataFrame:
        return rows.select("*", *[make(spec).alias(name) for name, make in cols.items()])

    plain = Window.partitionBy(*part).orderBy(*order)
    if not hot:
        return add(df, plain)
    cold, big = split_hot(df, part, hot.groups)
    size = max(hot.limit, reach + 1)
    numbered = positions(big, part, order, hot)
    index = F.col(POS) - 1
    chunk = F.floor(index / size)
    targets = F.when(index % size >= size - reach, F.array(chunk, chunk + 1)).otherwise(
        F.array(chunk)
    )
    spread = numbered.withColumn("__own", chunk).withColumn("__chunk", F.explode(targets))
    chunks = Window.partitionBy(*part, "__chunk").orderBy(POS)
    done = add(spread, chunks).where(F.col("__own") == F.col("__chunk"))
    return add(cold, plain).unionByName(done.drop("__own", "__chunk", POS, SIZE))


def numbered(
    df: DataFrame, part: list[str], order: list[str | Column], name: str = POS,
    size: str | None = None, hot: Limit = None,
) -> DataFrame:
    """ROW_NUMBER per group; ``size`` adds the group's row count."""
    hot = find_hot(df, part, hot)
    order = _columns(order)

    def plain(rows: DataFrame) -> DataFrame:
        spec = Window.partitionBy(*part)
        out = rows.withColumn(name, F.row_number().over(spec.orderBy(*order)).cast("long"))
        return out.withColumn(size, F.count(F.lit(1)).over(spec)) if size else out

    if not hot:
        return plain(df)
    cold, big = split_hot(df, part, hot.groups)
    done = positions(big, part, order, hot).withColumnRenamed(POS, name)
    done = done.withColumnRenamed(SIZE, size) if size else done.drop(SIZE)
    return plain(cold).unionByName(done)


def ranked(
    df: DataFrame, part: list[str], value: str, *, descending: bool = False,
    rank: str | None = None, percent: str | None = None, dense: str | None = None,
    hot: Limit = None,
) -> DataFrame:
    """RANK, PERCENT_RANK and DENSE_RANK of ``value`` within the group; ties share a rank."""
    hot = find_hot(df, part, hot)
    direction = F.col(value).desc() if descending else F.col(value).asc()
    spec = Window.partitionBy(*part).orderBy(direction)

    def plain(rows: DataFrame) -> DataFrame:
        made = [(rank, F.rank()), (percent, F.percent_rank()), (dense, F.dense_rank())]
        return rows.select("*", *[fn.over(spec).alias(name) for name, fn in made if name])

    if not hot:
        return plain(df)
    # the ranks follow from one row per distinct value; the rows themselves are not sorted
    cold, big = split_hot(df, part, hot.groups)
    values = cumulated(
        big.groupBy(*part, value).agg(F.count(F.lit(1)).alias("__rows")), part, [direction],
        "__rows", "__before", hot.limit,
    )
    if dense:
        values = numbered(values, part, [direction], "__dense", hot=hot.limit)
    keys = [*part, value]
    values = values.select(
        *[F.col(k).alias(f"__v{i}") for i, k in enumerate(keys)],
        *[c for c in values.columns if c.startswith("__")],
    )
    sizes = pinned(big.groupBy(
        *[F.col(p).alias(f"__h{i}") for i, p in enumerate(part)]
    ).agg(F.count(F.lit(1)).alias(SIZE)))
    done = big.join(sizes, same(big, part, "__h")).join(values, same(big, keys, "__v"))
    share = F.when(F.col(SIZE) > 1, F.col("__before") / (F.col(SIZE) - 1)).otherwise(F.lit(0.0))
    made = [
        (rank, (F.col("__before") + 1).cast("int")), (percent, share),
        (dense, F.col("__dense").cast("int") if dense else None),
    ]
    done = done.select(*df.columns, *[column.alias(name) for name, column in made if name])
    return plain(cold).unionByName(done)


def _tile(index: Column, size: Column, n: int) -> Column:
    """Tile of a 0-based position: the first ``size mod n`` tiles take one row more."""
    base, extra = F.floor(size / n), size % n
    wide = extra * (base + 1)
    later = extra + F.floor((index - wide) / F.greatest(base, F.lit(1)))
    return F.when(index < wide, F.floor(index / (base + 1))).otherwise(later).cast("int") + 1


def tiled(
    df: DataFrame, part: list[str], order: list[str], n: int, name: str, hot: Limit = None
) -> DataFrame:
    """NTILE(n) over ascending columns, the last of them unique.

    For hot groups only the group and order columns are sorted, to find the first row of
    each tile. These few rows are sent to all tasks, and every row counts the tile starts
    at or before it, so the table itself is not shuffled.
    """
    hot = find_hot(df, part, hot)

    def plain(rows: DataFrame) -> DataFrame:
        spec = Window.partitionBy(*part).orderBy(*order)
        return rows.withColumn(name, F.ntile(n).over(spec))

    if not hot:
        return plain(df)
    cold, big = split_hot(df, part, hot.groups)
    narrow = big.select(*dict.fromkeys([*part, *order]))
    placed = positions(narrow, part, _columns(order), hot)
    index = F.col(POS) - 1
    opens = (index == 0) | (_tile(index, F.col(SIZE), n) != _tile(index - 1, F.col(SIZE), n))
    # one row per group, with at most n starts
    starts = pinned(placed.where(opens).groupBy(
        *[F.col(p).alias(f"__t{i}") for i, p in enumerate(part)]
    ).agg(F.collect_list(F.struct(*order)).alias("__starts")))
    own = F.struct(*order)
    done = big.join(starts, same(big, part, "__t")).withColumn(
        name, F.size(F.filter("__starts", lambda start: start <= own))
    ).drop("__starts", *[f"__t{i}" for i in range(len(part))])
    return plain(cold).unionByName(done)


def cumulated(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group; 0 for its first row.

    Integers and decimals only: sums of doubles depend on the order of addition, so the two
    paths would differ. Cast doubles to a decimal first.
    """
    if df.schema[value].dataType.typeName() in ("double", "float"):
        raise TypeError(f"cast {value} to a decimal: a running sum of doubles is not exact")
    hot = find_hot(df, part, hot)
    order = _columns(order)
    earlier = (Window.unboundedPreceding, -1)

    def before(column: str, spec: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(spec.rowsBetween(*earlier)), F.lit(0))

    plain = Window.partitionBy(*part).orderBy(*order)
    if not hot:
        return df.withColumn(name, before(value, plain))
    cold, big = split_hot(df, part, hot.groups)
    rows = positions(big, part, order, hot).withColumn(
        "__chunk", F.floor((F.col(POS) - 1) / hot.limit)
    )
    groups = [f"__c{i}" for i in range(len(part))]
    # one row per chunk: what the chunks before it add up to
    carried = rows.groupBy(
        *[F.col(p).alias(g) for p, g in zip(part, groups)], F.col("__chunk").alias("__k")
    ).agg(F.sum(value).alias("__own"))
    carried = carried.withColumn(
        "__carry", before("__own", Window.partitionBy(*groups).orderBy("__k"))
    ).drop("__own")
    within = Window.partitionBy(*part, "__chunk").orderBy(POS)
    done = (
        rows.withColumn(name, before(value, within))
        .join(carried, same(rows, part, "__c") & (F.col("__chunk") == F.col("__k")))
        .withColumn(name, F.col(name) + F.col("__carry"))
        .drop("__carry", "__k", "__chunk", POS, SIZE, *groups)
    )
    return cold.withColumn(name, before(value, plain)).unionByName(done)


def filled(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group."""
    hot = find_hot(df, part, hot)
    order = _columns(order)
    upto = (Window.unboundedPreceding, Window.currentRow)
    plain = Window.partitionBy(*part).orderBy(*order).rowsBetween(*upto)

    def fill(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(plain))

    if not hot:
        return fill(df)
    cold, big = split_hot(df, part, hot.groups)
    rows = positions(big, part, order, hot).withColumn(
        "__chunk", F.floor((F.col(POS) - 1) / hot.limit)
    )
    groups = [f"__c{i}" for i in range(len(part))]
    earlier = Window.partitionBy(*groups).orderBy("__k").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # one row per chunk: the value it hands on
    carried = (
        rows.groupBy(
            *[F.col(p).alias(g) for p, g in zip(part, groups)], F.col("__chunk").alias("__k")
        )
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(POS))).alias("__own"))
        .withColumn("__carry", F.last("__own", ignorenulls=True).over(earlier))
        .drop("__own")
    )
    within = Window.partitionBy(*part, "__chunk").orderBy(POS).rowsBetween(*upto)
    done = (
        rows.withColumn(name, F.last(value, ignorenulls=True).over(within))
        .join(carried, same(rows, part, "__c") & (F.col("__chunk") == F.col("__k")))
        .withColumn(name, F.coalesce(F.col(name), F.col("__carry")))
        .drop("__carry", "__k", "__chunk", POS, SIZE, *groups)
    )
    return fill(cold).unionByName(done)


def seen_so_far(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Sorted array of the distinct values of a group up to and including each row.

    In a hot group a value joins the set at its first row only, so the running set is
    built from the first rows and then carried forward to all others.
    """
    order = _columns(order)
    hot = find_hot(df, part, hot)
    upto = (Window.unboundedPreceding, Window.currentRow)
    plain = Window.partitionBy(*part).orderBy(*order).rowsBetween(*upto)

    def collect(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.array_sort(F.collect_set(value).over(plain)))

    if not hot:
        return collect(df)
    cold, big = split_hot(df, part, hot.groups)
    rows = positions(big, part, order, hot).withColumnRenamed(POS, "__row").drop(SIZE)
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*part, value).agg(
        F.min("__row").alias("__at")
    )
    running = Window.partitionBy(*part).orderBy("__at").rowsBetween(*upto)
    firsts = firsts.select(
        *[F.col(p).alias(f"__s{i}") for i, p in enumerate(part)], "__at",
        F.array_sort(F.collect_list(value).over(running)).alias("__set"),
    )
    match = same(rows, part, "__s") & (F.col("__row") == F.col("__at"))
    marked = rows.join(firsts, match, "left").drop(
        "__at", *[f"__s{i}" for i in range(len(part))]
    )
    done = filled(marked, part, ["__row"], "__set", name, hot)
    empty = F.array().cast(done.schema[name].dataType)
    done = done.withColumn(name, F.coalesce(F.col(name), empty)).drop("__set", "__row")
    return collect(cold).unionByName(done)


def lagged(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, n: int, name: str,
    hot: Limit = None,
) -> DataFrame:
    """LAG(value, n)."""
    return windowed(
        df, part, order, {name: lambda w: F.lag(value, n).over(w)}, reach=n, hot=hot
    )


def rolling(
    df: DataFrame, part: list[str], order: list[str | Column], n: int,
    aggs: dict[str, Column], hot: Limit = None,
) -> DataFrame:
    """Aggregates over the last ``n`` rows before the current one and the row itself."""
    cols = {
        name: (lambda w, agg=agg: agg.over(w.rowsBetween(-n, 0))) for name, agg in aggs.items()
    }
    return windowed(df, part, order, cols, reach=n, hot=hot)


def rolling_days(
    df: DataFrame, part: list[str], ts: str, days: int, aggs: dict[str, Column], hot: Limit = None,
) -> DataFrame:
    """Aggregates over the rows of the last ``days`` days up to each row's time, ties included.

    The frame is a range of time, so it may hold any number of rows. Aggregates must be sums,
    counts, minima or maxima over whole numbers, decimals or times. A hot group is cut into slices
    of time; see ``_merged_slices``, which reads each row a set number of times however long its
    frame is. Other aggregates of a hot group are computed frame by frame: slices are as long as
    the frame, which reaches into its own slice and the one before, so each row also goes to the
    next slice, and slices are windows of their own.
    """
    hot = find_hot(df, part, hot)
    width = days * 86_400_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def add(rows: DataFrame, groups: list[str]) -> DataFrame:
        frame = Window.partitionBy(*groups).orderBy(micros).rangeBetween(-width, 0)
        return rows.select("*", *[agg.over(frame).alias(name) for name, agg in aggs.items()])

    if not hot:
        return add(df, part)
    cold, big = split_hot(df, part, hot.groups)
    merges = [_merge_of(df, agg) for agg in aggs.values()]
    if all(merges) and days > 0:
        largest = hot.groups.agg(F.max(SIZE)).first()[0]
        pieces = min(SLICE_PIECES, -(-largest // max(hot.limit, SLICE_ROWS)))
        done = _merged_slices(big, part, micros, width, aggs, merges, pieces)
        return add(cold, part).unionByName(done)
    own = F.floor(micros / width)
    spread = big.withColumn("__own", own).withColumn(
        "__slice", F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1)))
    )
    done = add(spread, [*part, "__slice"]).where(F.col("__own").eqNullSafe(F.col("__slice")))
    return add(cold, part).unionByName(done.drop("__own", "__slice"))


def _merge_of(df: DataFrame, agg: Column) -> str | None:
    """How results over parts of a frame make that of the frame: ``sum``, ``min`` or ``max``; or
    None where they don't, or not exactly."""
    try:
        found = df.agg(agg)
    except AnalysisException:  # a function of windows only
        return None
    made = found._jdf.queryExecution().analyzed().aggregateExpressions().apply(0)
    while made.getClass().getSimpleName() == "Alias":
        made = made.child()
    if made.getClass().getSimpleName() != "AggregateExpression" or made.isDistinct() or made.filter().isDefined():
        return None
    kind = made.aggregateFunction().getClass().getSimpleName().lower()
    if kind == "sum":
        result = found.schema[0].dataType
        # the sum of two decimals of 38 digits may lose one
        exact = result.typeName() == "long" or result.typeName() == "decimal" and result.precision < 38
        return "sum" if exact else None
    return {"count": "sum", "min": "min", "max": "max"}.get(kind)


def _merged(kind: str, parts: list[Column], result: T.DataType) -> Column:
    """One value of the parts' values; a part without any is null."""
    if kind != "sum":
        return F.least(*parts) if kind == "min" else F.greatest(*parts)
    total = parts[0]
    for part in parts[1:]:
        total = F.coalesce(total + part, total, part)
    return total.cast(result)


def _merged_slices(
    big: DataFrame, part: list[str], at: Column, width: int, aggs: dict[str, Column], merges: list[str],
    pieces: int,
) -> DataFrame:
    """Aggregates over the last ``width`` microseconds, from parts that are computed once.

    Time is cut into slices, ``pieces`` of them as long as the frame. A frame is then the end of the
    slice where it begins, whole slices, and the beginning of its row's slice. Each slice is a window
    of its own in which aggregates run on from its begin and back from its end. A row looks up the
    second ``pieces`` slices earlier, where it is sorted between the rows by the time its frame begins.
    """
    names = [f"__{i}" for i in range(len(aggs))]
    whole = (Window.unboundedPreceding, Window.currentRow)
    number = F.expr(
        f"(__at - pmod(__at, {width}L)) div {width}L * {pieces}L + (pmod(__at, {width}L) * {pieces}L) div {width}L"
    )
    rows = big.withColumn("__at", at).withColumn("__slice", number)
    slices = Window.partitionBy(*part, "__slice")
    ahead = slices.orderBy("__at").rangeBetween(*whole)
    behind = slices.orderBy(F.col("__at").desc()).rangeBetween(*whole)
    run = rows.select(
        "*", *[agg.over(ahead).alias(f"{name}_own") for name, agg in zip(names, aggs.values())],
        F.struct(*[agg.over(behind).alias(name) for name, agg in zip(names, aggs.values())]).alias("__ends"),
    )
    # each row as itself, with the aggregates to the end of its slice, and as a look into an earlier slice
    looks = F.col("__look")
    kept = [c for c in run.columns if c not in (*part, "__at", "__slice", "__ends")]
    both = run.withColumn("__look", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        *part, "__look", *[F.when(looks, F.col(f"`{c}`")).alias(c) for c in kept],
        F.when(looks, F.col("__at") - width).otherwise(F.col("__at")).alias("__at"),
        F.when(looks, F.col("__slice") - pieces).otherwise(F.col("__slice")).alias("__slice"),
        F.when(~looks, F.col("__ends")).alias("__ends"),
    )
    done = both.withColumn("__first", F.last("__ends", ignorenulls=True).over(behind)).where("__look")
    result = dict(zip(names, (run.schema[f"{name}_own"].dataType for name in names)))
    if pieces > 1:
        between = _whole_slices(rows, part, dict(zip(names, zip(aggs.values(), merges))), pieces)
        done = done.join(
            between, same(done, part, "__g") & (F.col("__slice") + pieces).eqNullSafe(F.col("__s")), "left"
        )
    # rows without a time are a slice, and a frame, of their own
    timed = F.col("__at").isNotNull()
    values = []
    for name, kind in zip(names, merges):
        parts = [F.col(f"{name}_own"), F.when(timed, F.col(f"__first.{name}"))]
        if pieces > 1:
            parts.append(F.when(timed, F.col(f"{name}_between")))
        values.append(_merged(kind, parts, result[name]))
    return done.select(
        *[F.col(f"`{c}`") for c in big.columns], *[value.alias(name) for name, value in zip(aggs, values)]
    )


def _whole_slices(rows: DataFrame, part: list[str], aggs: dict, pieces: int) -> DataFrame:
    """One row per slice: the aggregates over the ``pieces`` - 1 slices before it."""
    groups = [f"__g{i}" for i in range(len(part))]
    totals = rows.groupBy(
        *[F.col(p).alias(g) for p, g in zip(part, groups)], F.col("__slice").alias("__s")
    ).agg(*[agg.alias(name) for name, (agg, _) in aggs.items()])
    earlier = Window.partitionBy(*groups).orderBy("__s").rangeBetween(1 - pieces, -1)
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return pinned(totals.select(
        *groups, "__s",
        *[merge[kind](name).over(earlier).alias(f"{name}_between") for name, (_, kind) in aggs.items()],
    ))


def rolling_ndv(
    df: DataFrame, part: list[str], order: list[str | Column], n: int, value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Distinct values in the last ``n`` rows and the current one."""
    cols = {name: lambda w: F.size(F.collect_set(value).over(w.rowsBetween(-n, 0)))}
    return windowed(df, part, order, cols, reach=n, hot=hot)


def rolling_zscore(
    df: DataFrame, part: list[str], order: list[str | Column], n: int, value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """(value - rolling mean) / rolling deviation; 0 where the deviation is 0 or NULL."""
    def score(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-n, 0)
        sd = F.stddev_samp(value).over(frame)
        return F.when(sd > 0, (F.col(value) - F.avg(value).over(frame)) / sd).otherwise(0.0)

    return windowed(df, part, order, {name: score}, reach=n, hot=hot)


def last_values(
    df: DataFrame, part: list[str], order: list[str | Column], n: int, value: str, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Array of the last ``n`` values before the current one and the value itself."""
    cols = {name: lambda w: F.collect_list(value).over(w.rowsBetween(-n, 0))}
    return windowed(df, part, order, cols, reach=n, hot=hot)


def gap_features(
    df: DataFrame, part: list[str], ts: str, tiebreak: str, days: str = "days_since_last",
    hours: str = "hours_since_last", hot: Limit = None,
) -> DataFrame:
    """Calendar days and hours since the group's previous row."""
    cols = {
        days: lambda w: F.datediff(ts, F.lag(ts).over(w)),
        hours: lambda w: (
            F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
        ) / F.lit(3600.0),
    }
    return windowed(df, part, [ts, tiebreak], cols, reach=1, hot=hot)


def growth(current: Column, base: Column, scale: int = 100) -> Column:
    """Change against ``base`` in percent; NULL unless the base is positive."""
    return F.when(base > 0, (current - base) * scale / base)


def lag_growth(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, n: int, name: str,
    hot: Limit = None,
) -> DataFrame:
    """Percent change against the value ``n`` rows earlier."""
    cols = {name: lambda w: growth(F.col(value), F.lag(value, n).over(w))}
    return windowed(df, part, order, cols, reach=n, hot=hot)


def date_growth(
    df: DataFrame, part: list[str], day: str, value: str, days: int, name: str
) -> DataFrame:
    """Percent change against the value exactly ``days`` days earlier; one row per day."""
    past = df.select(
        *part, F.date_add(F.col(day), days).alias(day), F.col(value).alias("__past")
    )
    return df.join(past, [*part, day], "left").withColumn(
        name, growth(F.col(value), F.col("__past"))
    ).drop("__past")


def anomaly_flag(
    df: DataFrame, part: list[str], order: list[str | Column], value: str, n: int,
    high: float, low: float, name: str, labels: tuple[str, str, str], hot: Limit = None,
) -> DataFrame:
    """Compare a value with the mean of the ``n`` rows before it, the row itself left out.

    ``labels`` are the names for above ``high`` times, below ``low`` times, and neither.
    """
    def flag(w: WindowSpec) -> Column:
        mean = F.avg(value).over(w.rowsBetween(-n, -1))
        return (
            F.when(F.col(value) > mean * high, labels[0])
            .when(F.col(value) < mean * low, labels[1])
            .otherwise(labels[2])
        )

    return windowed(df, part, order, {name: flag}, reach=n, hot=hot)


def outlier_flag(
    df: DataFrame, part: list[str], value: str, times: float, name: str
) -> DataFrame:
    """1 where a value exceeds ``times`` the mean of its group.

    The means are aggregated map-side and joined back, so no group meets in one task
    as it would in an unordered window.
    """
    means = df.groupBy(*[F.col(p).alias(f"__m{i}") for i, p in enumerate(part)]).agg(
        F.avg(value).alias("__mean")
    )
    out = df.join(pinned(means), same(df, part, "__m"), "left")
    return out.withColumn(
        name, F.when(F.col(value) > F.col("__mean") * times, 1).otherwise(0)
    ).drop("__mean", *[f"__m{i}" for i in range(len(part))])


def encode_category(df: DataFrame, value: str, name: str, hot: Limit = None) -> DataFrame:
    """DENSE_RANK over the whole table: only the distinct values are ranked, then joined."""
    values, n = settled(df.select(F.col(value).alias("__value")).distinct())
    codes = numbered(values, [], ["__value"], "__code", hot=hot_in(n, values, [], hot))
    return df.join(codes, F.col(value).eqNullSafe(F.col("__value")), "left").withColumn(
        name, F.col("__code").cast("int")
    ).drop("__value", "__code")
