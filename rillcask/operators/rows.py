"""Filters, routing and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def split(
    df: DataFrame, routes: dict[str, Column], other: str | None = "other",
    null_to: str | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per condition and one for rows that match none.

    A row whose conditions come out NULL lands in no branch, as in three-valued logic;
    ``null_to`` names a branch for such rows.
    """
    branches = {name: df.where(cond) for name, cond in routes.items()}
    if other:
        none = F.lit(True)
        for cond in routes.values():
            none = none & ~cond
        branches[other] = df.where(none)
    if null_to:
        lost = F.lit(True)
        for cond in routes.values():
            lost = lost & ~F.coalesce(cond, F.lit(False))
        unknown = F.lit(False)
        for cond in routes.values():
            unknown = unknown | cond.isNull()
        extra = df.where(lost & unknown)
        branches[null_to] = branches[null_to].unionByName(extra) if null_to in branches else extra
    return branches


def route(
    df: DataFrame, routes: dict[str, Column], other: str | None = "other", name: str = "route"
) -> DataFrame:
    """The same split in one pass: a column for ``partitionBy``. First match wins."""
    label, none = F.lit(None).cast("string"), F.lit(True)
    for key, cond in reversed(routes.items()):
        label = F.when(cond, key).otherwise(label)
        none = none & ~cond
    if other:
        label = F.when(none, other).otherwise(label)
    return df.withColumn(name, label).where(F.col(name).isNotNull())


def col_diff(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) - F.col(b))


def copy_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Repeat a key column among the values."""
    return df.withColumn(name, F.col(key))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    """Rename every column, so both sides of a join keep distinct names."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def label_rules(rules: list[tuple[Column, str]], else_: str | Column | None) -> Column:
    """Label of the first rule that holds; a NULL condition does not hold."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(else_ if isinstance(else_, Column) else F.lit(else_))


def bucketize(value: Column, limits: list[tuple[float, str]], else_: str) -> Column:
    """Label of the first limit the value stays below."""
    return label_rules([(value < limit, label) for limit, label in limits], else_)


def ago(as_of: str, n: int = 0, unit: str = "DAY") -> Column:
    """``as_of`` minus n units, as a constant the optimizer folds and pushes down."""
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{n}' {unit}")


def recent(df: DataFrame, ts: str, as_of: str, n: int, unit: str = "DAY") -> DataFrame:
    """Rows at or after ``as_of`` minus n units."""
    return df.where(F.col(ts) >= ago(as_of, n, unit))


def between_ago(
    df: DataFrame, ts: str, as_of: str, first: int, last: int, unit: str = "DAY"
) -> DataFrame:
    """Rows from ``first`` units ago up to, not including, ``last`` units ago."""
    return df.where((F.col(ts) >= ago(as_of, first, unit)) & (F.col(ts) < ago(as_of, last, unit)))
