"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcask.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The tables end on 2024-01-30 (events) and 2001-08-01 (orders).
EVENTS_AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-01"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def cents(value: str | Column) -> Column:
    """Money as a whole number of cents: sums and means do not depend on row order."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 100).cast("bigint")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the value in cents and the number inside ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").withColumns({"cents": cents("value"), "k": k})


CENTS = "cast(round({0} * 100) as bigint)"
EVENTS = (
    "(select *, cast(round(value * 100) as bigint) as cents, "
    "cast(json_extract_string(props, '$.k') as integer) as k from events)"
)


def rounded(expr: str, digits: int) -> str:
    """SQL that rounds a double half up in decimal, as Spark does."""
    return f"cast(round(cast({expr} as decimal(38,12)), {digits}) as double)"


def load() -> None:
    """Import the modules that register the queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


MODULES = ["rows", "aggregates", "joins", "ordered", "streams", "quality", "plans"]
