"""Union, set operations, sorting and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillcask.functions.numbers import at_least_one


def merge_tagged(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Stack tables or streams and say where each row came from."""
    return union_all([df.withColumn(name, F.lit(tag)) for tag, df in parts.items()])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def set_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """union, intersect or except over distinct rows; NULLs count as equal."""
    b = b.select(*a.columns)
    if op == "union":
        return a.union(b).distinct()
    if op == "intersect":
        return a.intersect(b)
    if op == "except":
        return a.subtract(b)
    raise ValueError(f"unknown set operation: {op}")


def sort(df: DataFrame, order: list[str | Column]) -> DataFrame:
    return df.orderBy(*order)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(at_least_one(n))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; every map task passes on at most ``n`` rows of a group."""
    if not keys:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
