"""Stream sinks. A restarted query goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rillcask.operators.dedup import latest_by_key
from rillcask.session import new_folder

BATCH = "batch_id"


def start(writer, every: str | None) -> StreamingQuery:
    """Start a writer at an interval, or once over the available input."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_append(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None, fmt: str = "parquet",
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Append final rows. Without ``every`` the query ends with the available input."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return start(writer, every)


def write_upsert(
    df: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str,
    every: str | None = None, mode: str = "update",
) -> StreamingQuery:
    """Keep the latest row per key; read it back with ``read_upsert``.

    Each micro-batch writes its last row per key into a folder of its own. The cost is
    that of the batch, not of the table, and a repeated batch replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, keys, order).write.mode("overwrite").parquet(
            f"{path}/{BATCH}={batch_id}"
        )

    writer = df.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint
    ).foreachBatch(write)
    return start(writer, every)


def read_upsert(
    spark: SparkSession, path: str, keys: list[str], schema, order: list[str],
    deleted: Column | None = None,
) -> DataFrame:
    """Current rows of an upsert table: per key the row that is last by ``order``.

    The batch decides only between rows of equal order, so the result does not depend on how
    the input was cut into batches. Where ``order`` is the key alone, as for aggregates in update
    mode, the last batch has the word. Keys whose last row is ``deleted`` are gone.
    """
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(stored).option("basePath", path).parquet(path)
    rows = latest_by_key(rows, keys, [*order, BATCH]).drop(BATCH)
    return rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))


def fold_upsert(
    spark: SparkSession, path: str, keys: list[str], schema, order: list[str], target: str
) -> None:
    """Write the last rows, deletions included, as one batch of a new table: reads get short."""
    read_upsert(spark, path, keys, schema, order).write.mode("errorifexists").parquet(
        f"{target}/{BATCH}=-1"
    )


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over the available input and return the appended rows as a table."""
    spark = df.sparkSession
    path, checkpoint = new_folder(spark, label), new_folder(spark, f"{label}-state")
    write_append(df, path, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_upsert(
    df: DataFrame, keys: list[str], order: list[str], label: str, mode: str = "update",
    deleted: Column | None = None,
) -> DataFrame:
    """Run a stream over the available input and return its current rows, folded once."""
    spark = df.sparkSession
    path, checkpoint = new_folder(spark, label), new_folder(spark, f"{label}-state")
    write_upsert(df, keys, order, path, checkpoint, mode=mode).awaitTermination()
    folded = new_folder(spark, f"{label}-folded")
    fold_upsert(spark, path, keys, df.schema, order, folded)
    return read_upsert(spark, folded, keys, df.schema, order, deleted)


class LateRows(StreamingQueryListener):
    """Counts the rows that windows refused as too late, over every batch of every query.

    Register it before the query starts: ``spark.streams.addListener(LateRows())``.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        query = str(event.progress.id)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[query] = self.dropped.get(query, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
