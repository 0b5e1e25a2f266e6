"""A stream joined with the version of a table that was valid at each row's time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillcask.operators.joins import Pairs, asof_join
from rillcask.streaming.sinks import BATCH, start


def write_asof(
    facts: DataFrame, versions: Callable[[SparkSession], DataFrame], pairs: Pairs, fact_ts: str,
    version_ts: str, tiebreak: str, path: str, checkpoint: str, every: str | None = None,
) -> StreamingQuery:
    """Each row of the stream with the version that was valid at its time, or NULLs.

    ``versions`` opens the table of versions anew for every micro-batch, so it may be the target
    of another stream. Only versions of the batch's keys are sorted. A
    version that arrives after the rows it is valid for does not change them: as on any stream,
    the rows are out. A repeated batch replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        known = versions(batch.sparkSession)
        for left, right in pairs:
            keys = batch.select(batch[left].alias(right)).distinct()
            known = known.join(keys, right, "left_semi")
        asof_join(batch, known, pairs, fact_ts, version_ts, tiebreak).write.mode(
            "overwrite"
        ).parquet(f"{path}/{BATCH}={batch_id}")

    writer = facts.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint
    ).foreachBatch(write)
    return start(writer, every)
