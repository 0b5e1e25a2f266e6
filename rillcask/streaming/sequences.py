"""Ordered steps within a time limit on a stream."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillcask.functions.times import seconds
from rillcask.operators.joins import sequence_match
from rillcask.operators.patterns import Step, match_pattern
from rillcask.streaming.sinks import BATCH, read_upsert, start
from rillcask.streaming.upsert import UpsertTable


DAY = "day"


def _days_in(spark: SparkSession, store: str) -> list[date]:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(store)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(date.fromisoformat(n.split("=")[1]) for n in names if n.startswith(f"{DAY}="))


def _drop_days(spark: SparkSession, store: str, reach: int) -> None:
    """Remove the days from which no row can reach a time the stream still accepts."""
    days = _days_in(spark, store)
    context = spark.sparkContext
    for day in days:
        if day < days[-1] - timedelta(seconds=reach) - timedelta(days=1):
            folder = context._jvm.org.apache.hadoop.fs.Path(f"{store}/{DAY}={day}")
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _with_neighbours(
    batch: DataFrame, batch_id: int, ts: str, reach: int, late: int | None, store: str, schema: T.StructType,
) -> tuple[DataFrame, int, int] | None:
    """Store a batch by day; the stored rows within ``reach`` seconds of its span, and the span in
    microseconds. None for an empty batch.

    With ``late`` seconds, days older than ``late`` and ``reach`` before the newest day are removed,
    and rows that come later than that are not taken.
    """
    spark, span = batch.sparkSession, F.expr(f"INTERVAL '{reach}' SECOND")
    if late is not None:
        known = _days_in(spark, store)
        if known:
            oldest = known[-1] - timedelta(seconds=late + reach) - timedelta(days=1)
            batch = batch.where(F.to_date(ts) >= F.lit(oldest))
    batch.withColumn(DAY, F.to_date(ts)).withColumn(BATCH, F.lit(batch_id)).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(store)
    low, high, first, last = batch.agg(
        *[F.unix_micros(t.cast("timestamp")) for t in (F.min(ts), F.max(ts))],
        F.to_date(F.min(ts) - span), F.to_date(F.max(ts) + span),
    ).first()
    if low is None:
        return None
    if late is not None:
        _drop_days(spark, store, late + reach)
    days = ",".join(str(first + timedelta(days=n)) for n in range((last - first).days + 1))
    known = spark.read.schema(schema).option("basePath", store).parquet(f"{store}/{DAY}={{{days}}}")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    known = known.where(micros.between(low - reach * 1_000_000, high + reach * 1_000_000))
    return known.drop(DAY, BATCH), low, high


def _stored_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([
        *rows.schema.fields, T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.LongType()),
    ])


def write_sequences(
    df: DataFrame, key: str, ts: str, kind: str, steps: list[str], within: str, tiebreak: str,
    path: str, checkpoint: str, every: str | None = None, late: str | None = None,
) -> StreamingQuery:
    """Keep the matches of ``sequence_match`` up to date; read them with ``read_sequences``.

    Each micro-batch stores its rows by day. A match with one of them starts at most ``within``
    before the batch's oldest row and ends at most ``within`` after its newest, so only the days
    of that span are listed and matched again: the work follows the span of the batch, not the
    age of the stream. A late row
    can move the steps of a match to earlier times but never undo a match, so matches are upserted
    by their first event. A repeated batch replaces its own folders. ``late`` is how far behind the
    newest row others may come: older days are then removed, else all rows stay.
    """
    rows = df.where(F.col(kind).isin(*steps)).select(key, ts, kind, tiebreak)
    schema = _stored_schema(rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        found = _with_neighbours(
            batch, batch_id, ts, seconds(within), late and seconds(late), f"{path}/rows", schema
        )
        if found:
            matches = sequence_match(found[0], key, ts, kind, steps, within, tiebreak)
            matches.write.mode("overwrite").parquet(f"{path}/matches/{BATCH}={batch_id}")

    writer = rows.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint
    ).foreachBatch(write)
    return start(writer, every)


def pattern_table(
    spark: SparkSession, df: DataFrame, keys: list[str], ts: str, tiebreak: str, path: str, **options
) -> UpsertTable:
    """The table of matches, by the event that begins them; those without an end are none."""
    fields = [
        *[df.schema[k] for k in keys], df.schema[tiebreak], T.StructField("start", df.schema[ts].dataType),
        T.StructField("end_id", df.schema[tiebreak].dataType), T.StructField("end", df.schema[ts].dataType),
    ]
    return UpsertTable(spark, f"{path}/matches", [tiebreak], T.StructType(fields), [], **options)


def write_patterns(
    df: DataFrame, keys: list[str], ts: str, kind: str, steps: list[Step], within: str, tiebreak: str,
    path: str, checkpoint: str, between: str = "any", late: str | None = None, every: str | None = None,
) -> StreamingQuery:
    """Keep the matches of ``match_pattern`` up to date; read them with ``read_patterns``.

    Rows are stored and matched again as by ``write_sequences``. A row that comes late may end a
    match earlier, and where no other rows may lie between the steps it may also undo one: rows
    that could begin a match are therefore written whether they find an end or not.
    """
    rows = df.select(*keys, ts, kind, tiebreak)
    schema = _stored_schema(rows)
    table = pattern_table(df.sparkSession, df, keys, ts, tiebreak, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.holds(batch_id):
            return
        reach = seconds(within)
        found = _with_neighbours(batch, batch_id, ts, reach, late and seconds(late), f"{path}/rows", schema)
        if found:
            known, low, high = found
            made = match_pattern(known, keys, ts, kind, steps, within, tiebreak, between, unmatched=True)
            # beginnings after the batch see only part of what follows them, and it has not changed
            begun = F.unix_micros(F.col("start").cast("timestamp"))
            table.upsert(made.where(begun.between(low - reach * 1_000_000, high)), batch_id)
            table.compact()

    writer = rows.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint
    ).foreachBatch(write)
    return start(writer, every)


def read_patterns(
    spark: SparkSession, df: DataFrame, keys: list[str], ts: str, tiebreak: str, path: str
) -> DataFrame:
    """Current matches; ``df`` is the stream or any table of its shape."""
    return pattern_table(spark, df, keys, ts, tiebreak, path).read(F.col("end_id").isNull())


def read_sequences(
    spark: SparkSession, df: DataFrame, key: str, ts: str, steps: list[str], tiebreak: str,
    path: str,
) -> DataFrame:
    """Current matches; ``df`` is the stream or any table of its shape."""
    times = [T.StructField(f"step_{i + 1}", df.schema[ts].dataType) for i in range(len(steps))]
    schema = T.StructType([df.schema[key], df.schema[tiebreak], *times])
    return read_upsert(spark, f"{path}/matches", [tiebreak], schema, [tiebreak])
