"""Batch tables: reading, seeding, layout and writing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillcask.functions.numbers import at_least_one
from rillcask.operators.dedup import latest_by_key


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_keyed_table(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A table declared by primary key: the last row per key counts."""
    return latest_by_key(df, keys, order)


def values_table(
    spark: SparkSession, rows: list[dict[str, Any]], schema: str | T.StructType
) -> DataFrame:
    """Table of literal rows; columns a row leaves out are NULL."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    for row in rows:
        extra = set(row) - set(names)
        if extra:
            raise ValueError(f"unknown columns: {sorted(extra)}")
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def register(df: DataFrame, name: str) -> DataFrame:
    """Name an intermediate result for SQL; nothing is computed or kept."""
    df.createOrReplaceTempView(name)
    return df


def period_column(ts: str, unit: str) -> str:
    return f"{ts}_{unit}"


def write_partitioned(
    df: DataFrame, path: str, ts: str, unit: str, mode: str = "overwrite", fmt: str = "parquet"
) -> None:
    """Write into one folder per month or day of ``ts``.

    The rebalance hint gathers a period's rows into few files and splits a period that
    is too large for one task. Readers prune on the ``<ts>_<unit>`` column.
    """
    period = period_column(ts, unit)
    rows = df.withColumn(period, F.date_trunc(unit, ts).cast("date"))
    rows.hint("rebalance", F.col(period)).write.mode(mode).format(fmt).partitionBy(period).save(
        path
    )


def read_period(
    spark: SparkSession, path: str, ts: str, unit: str, first: str, last: str,
    fmt: str = "parquet",
) -> DataFrame:
    """Rows of the periods from ``first`` to ``last``; other folders are not listed."""
    period = F.col(period_column(ts, unit))
    return spark.read.format(fmt).load(path).where(
        period.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    )


def create_table_as(
    df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet"
) -> DataFrame:
    """Write a query's rows as a new table and return the table."""
    df.write.mode(mode).format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by name: missing ones NULL, unknown ones refused."""
    extra = set(df.columns) - set(schema.fieldNames())
    if extra:
        raise ValueError(f"columns the table does not have: {sorted(extra)}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def append_to(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a query to an existing table, columns matched by name."""
    schema = df.sparkSession.read.format(fmt).load(path).schema
    align(df, schema).write.mode("append").format(fmt).save(path)


def bucket(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Hash-distribute into ``n`` partitions."""
    return df.repartition(n, *keys)


def write_bucketed(df: DataFrame, table: str, keys: list[str], n: int, mode: str = "overwrite"):
    """Catalog table in ``n`` buckets, so later joins on ``keys`` need no shuffle."""
    bucket(df, keys, n).write.mode(mode).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def bucket_of(keys: list[str], n: int) -> Column:
    """Bucket number a row falls into."""
    return F.pmod(F.hash(*keys), F.lit(n))


def rekey(df: DataFrame, key: Column, name: str = "key", n: int | None = None) -> DataFrame:
    """Add a key column and partition the rows by it."""
    keyed = df.withColumn(name, key)
    return keyed.repartition(n, name) if n else keyed.repartition(name)


def snapshot(
    df: DataFrame | None, columns: str | list[str] = "*", where: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Bounded query: columns, condition and row limit over a table."""
    if df is None:
        raise ValueError("a table is required")
    if limit is not None:
        at_least_one(limit)
    if where and where.strip():
        df = df.where(where.strip())
    df = df.selectExpr(*([columns] if isinstance(columns, str) else columns))
    return df if limit is None else df.limit(limit)


def snapshot_of(spark: SparkSession, table: str, **query) -> DataFrame:
    """The same over a named table or view."""
    if not table.strip():
        raise ValueError("a table name is required")
    return snapshot(spark.table(table.strip()), **query)
