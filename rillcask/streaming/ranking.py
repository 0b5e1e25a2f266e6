"""First rows per group of a stream, as a changelog that takes rows back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillcask.operators.sets import top_n
from rillcask.operators.skew import pinned, same
from rillcask.streaming.sinks import BATCH, start
from rillcask.streaming.upsert import UpsertTable

PLACE, CHANGE = "place", "change"


def top_table(spark: SparkSession, schema: T.StructType, part: list[str], path: str, **options) -> UpsertTable:
    """The table of the first rows, keyed by group and place."""
    full = T.StructType([*schema.fields, T.StructField(PLACE, T.IntegerType())])
    return UpsertTable(spark, f"{path}/top", [*part, PLACE], full, [], **options)


def write_top_n(
    df: DataFrame, part: list[str], row_id: str, order: list[Column], n: int, path: str, checkpoint: str,
    every: str | None = None, **options,
) -> StreamingQuery:
    """Keep the first ``n`` rows per group; write what each batch changes to ``path``/changes.

    A change is ``+`` for a row that enters and ``-`` for one that is pushed out; a row that only
    moves to another place is no change. ``row_id`` is unique and ``order`` ends in it. A batch is
    first cut to its own ``n`` rows per group, map-side; only groups it touches are read and
    written. A repeated batch leaves the table alone and its changes as they were.
    """
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = top_table(spark, schema, part, path, **options)
        if table.holds(batch_id):
            return
        new = pinned(top_n(batch, part, order, n))
        touched = new.select(*[F.col(p).alias(f"__t{i}") for i, p in enumerate(part)]).distinct()
        known = table.read().drop(PLACE).join(touched, same(new, part, "__t"), "left_semi")
        first = pinned(top_n(known.unionByName(new), part, order, n))
        ids = [F.col(row_id).alias("__id")]
        entered = first.join(known.select(*ids), F.col(row_id) == F.col("__id"), "left_anti")
        pushed = known.join(first.select(*ids), F.col(row_id) == F.col("__id"), "left_anti")
        entered.withColumn(CHANGE, F.lit("+")).unionByName(pushed.withColumn(CHANGE, F.lit("-"))).write.mode(
            "overwrite"
        ).parquet(f"{path}/changes/{BATCH}={batch_id}")
        table.upsert(placed(first, part, order), batch_id)
        table.compact()

    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return start(writer, every)


def placed(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """Rows with their place in the group; ``df`` holds a few rows per group."""
    return df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def read_changes(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """All changes with their batch."""
    full = T.StructType([*schema.fields, T.StructField(CHANGE, T.StringType()), T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).option("basePath", f"{path}/changes").parquet(f"{path}/changes")


def folded(changes: DataFrame, row_id: str, until: int | None = None) -> DataFrame:
    """Rows that are in after the batch ``until``: those that entered more often than they left."""
    if until is not None:
        changes = changes.where(F.col(BATCH) <= until)
    columns = [c for c in changes.columns if c not in (CHANGE, BATCH)]
    return changes.groupBy(row_id).agg(
        F.sum(F.when(F.col(CHANGE) == "+", 1).otherwise(-1)).alias("__in"),
        *[F.any_value(c).alias(c) for c in columns if c != row_id],
    ).where("`__in` > 0").select(*columns)
