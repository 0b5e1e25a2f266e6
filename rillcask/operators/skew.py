"""Splitting groups that are too large for one task.

An ordered window needs all rows of a group in order. A group with a third of a
table would be one task's work, so the operators in ``ordered`` first count the
groups (a partial aggregate, one small row per group) and send only the groups
above a limit through the block path below. All other groups use a plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillcask.session import new_folder, shared_dir

HOT_ROWS = 4_000_000
HOT_ROWS_SETTING = "spark.rillcask.hotRows"
BLOCK_ROWS = 250_000

POS = "__pos"
SIZE = "__size"

# Hot groups found so far in this process, by input, group columns and limit. Which groups are
# listed decides only the path their rows take, never a result, so a list may be used again.
FOUND_LISTS = 1000
_FOUND: dict[tuple, DataFrame | None] = {}


class Hot:
    """The groups above the limit, or none of them; see ``find_hot``."""

    def __init__(self, groups: DataFrame | None, limit: int) -> None:
        self.groups, self.limit = groups, limit

    def __bool__(self) -> bool:
        return self.groups is not None


def hot_rows_limit(df: DataFrame) -> int:
    """Rows one task may hold for a single group."""
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def same(df: DataFrame, names: list[str], other_prefix: str) -> Column:
    """Null-safe equality of ``names`` with their prefixed twins."""
    return reduce(
        lambda a, b: a & b,
        [F.col(n).eqNullSafe(F.col(f"{other_prefix}{i}")) for i, n in enumerate(names)],
        F.lit(True),
    )


def pinned(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Spark then knows its size in bytes and broadcasts it only if that is below
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one is joined by a shuffle.
    """
    return settled(df)[0]


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A pinned table and its number of rows, in one job."""
    folder, seen = new_folder(df.sparkSession, "pinned"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), seen.get["n"]


def hot_in(rows: int, df: DataFrame, part: list[str], hot: Hot | int | None = None) -> Hot:
    """``find_hot`` for a table of ``rows`` rows: one that fits a task has no hot group."""
    limit = hot if isinstance(hot, int) else hot_rows_limit(df)
    return Hot(None, limit) if rows <= limit else find_hot(df, part, hot)


def hot_groups(df: DataFrame, part: list[str], limit: int) -> DataFrame | None:
    """All groups of ``part`` with more than ``limit`` rows as (__h0.., __size), or None.

    One job counts the groups and writes the list; it stays a table, however long it is.
    """
    named = [F.col(n).alias(f"__h{i}") for i, n in enumerate(part)]
    counts = df.groupBy(*named).agg(F.count(F.lit(1)).alias(SIZE)).where(F.col(SIZE) > limit)
    kept, found = settled(counts)
    return kept if found else None


def find_hot(df: DataFrame, part: list[str], hot: Hot | int | None = None) -> Hot:
    """Count the groups, unless that has been done. A number replaces the limit.

    Only the group columns are read. The same input, groups and limit are counted once.
    """
    if isinstance(hot, Hot):
        return hot
    limit = hot or hot_rows_limit(df)
    narrow = df.select(*part)
    key = (df.sparkSession.sparkContext.applicationId, narrow.semanticHash(), tuple(part), limit)
    if key not in _FOUND:
        if len(_FOUND) >= FOUND_LISTS:
            _FOUND.clear()
        _FOUND[key] = hot_groups(df, part, limit)
    return Hot(_FOUND[key], limit)


def split_hot(df: DataFrame, part: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other groups, rows of hot groups)."""
    if not part:
        return df.where(F.lit(False)), df
    match, listed = same(df, part, "__h"), hot.drop(SIZE)
    return df.join(listed, match, "left_anti"), df.join(listed, match, "left_semi")


def _blocks(rows: int, limit: int, df: DataFrame) -> int:
    """Tasks that sort the hot groups: one for ``limit`` rows, but no more than ``BLOCK_ROWS`` need.

    A task sorts its block and passes it on, so a block may hold more rows than the limit. Every
    block is a file and a part of every task's output: their number must not follow a small limit.
    """
    needed = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS))
    return max(2, min(-(-rows // limit), needed))


def positions(df: DataFrame, part: list[str], order: list[Column], hot: Hot) -> DataFrame:
    """Exact position and group size of every row of the hot groups.

    The rows are range-partitioned on (group, order), so a group spans many tasks. The
    range bounds come from a sample taken at run time; the checkpoint pins them, so the
    block counts and the rows agree and a lost executor cannot change a position.
    """
    shared_dir(df.sparkSession)
    blocks = _blocks(hot.groups.agg(F.sum(SIZE)).first()[0], hot.limit, df)
    keys = [F.col(n) for n in part]
    laid = (
        df.repartitionByRange(int(blocks), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__p_id", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("__p_block", F.shiftright("__p_id", 33))
    )
    named = [F.col(n).alias(f"__p_g{i}") for i, n in enumerate(part)]
    groups = [f"__p_g{i}" for i in range(len(part))]
    before = Window.partitionBy(*groups).orderBy("__p_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # one row per block and group in it: at most blocks + hot groups
    spans = pinned(
        laid.groupBy(*named, F.col("__p_block").alias("__p_b"))
        .agg(F.min("__p_id").alias("__p_first"), F.count(F.lit(1)).alias("__p_rows"))
        .withColumn("__p_offset", F.coalesce(F.sum("__p_rows").over(before), F.lit(0)))
        .withColumn(SIZE, F.sum("__p_rows").over(Window.partitionBy(*groups)))
    )
    match = same(laid, part, "__p_g") & (F.col("__p_block") == F.col("__p_b"))
    return (
        laid.join(spans, match)
        .withColumn(POS, F.col("__p_id") - F.col("__p_first") + F.col("__p_offset") + 1)
        .drop("__p_id", "__p_block", "__p_b", "__p_first", "__p_rows", "__p_offset", *groups)
    )
