"""Record formats: conversion, text rendering and rejected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "__corrupt"


# Text with quotes or outer blanks survives a CSV file with these options.
CSV_OPTIONS = {
    "header": "true", "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# A file whose values hold line breaks cannot be split, so it must stay small.
CSV_ROWS_PER_FILE = 1_000_000


def _options(fmt: str, schema: T.StructType) -> dict[str, str]:
    if fmt != "csv":
        return {}
    text = any(isinstance(f.dataType, T.StringType) for f in schema.fields)
    return {
        **CSV_OPTIONS, "multiLine": str(text).lower(), "maxRecordsPerFile": str(CSV_ROWS_PER_FILE),
    }


def convert_format(
    spark: SparkSession, source: str, source_format: str, target: str, target_format: str,
    schema: str | T.StructType, mode: str = "errorifexists",
) -> DataFrame:
    """Read a table in one format and write the same rows in another.

    Avro and Protobuf need their Spark package on the class path.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def read(path: str, fmt: str) -> DataFrame:
        return spark.read.format(fmt).schema(schema).options(**_options(fmt, schema)).load(path)

    rows = read(source, source_format)
    rows.write.format(target_format).mode(mode).options(
        **_options(target_format, schema)
    ).save(target)
    return read(target, target_format)


def encode_record(columns: list[str], fmt: str) -> Column:
    """One text per row: json or csv."""
    return {"json": json_line, "csv": csv_line}[fmt](columns)


def json_line(columns: list[str]) -> Column:
    """JSON object with NULL fields written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def csv_line(columns: list[str]) -> Column:
    """Comma-joined values: NULL is empty, a value with , \" or a line break is quoted."""
    def cell(name: str) -> Column:
        text = F.col(name).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text), F.lit(""))

    # concat, not concat_ws of NULLs: an empty cell keeps its place
    return F.concat_ws(",", *[cell(c) for c in columns])


def rows_to_json(df: DataFrame, name: str = "line") -> DataFrame:
    return df.select(json_line(df.columns).alias(name))


def rows_to_csv(df: DataFrame, name: str = "line") -> DataFrame:
    return df.select(csv_line(df.columns).alias(name))


def changelog_to_json(df: DataFrame, op: str = "op", name: str = "line") -> DataFrame:
    """Changelog rows as {"op": ..., "row": {...}}."""
    row = F.struct(*[c for c in df.columns if c != op])
    return df.select(
        F.to_json(F.struct(F.col(op).alias("op"), row.alias("row")), {"ignoreNullFields": "false"})
        .alias(name)
    )


def topic_records(
    records: DataFrame, key: str | T.StructType, value: str | T.StructType, fmt: str = "json"
) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, dead letters) of topic records: key, value, topic, partition, offset, timestamp.

    Works on the columns of a Kafka source as on a table of that shape. The key is decoded like
    the value, or cast if its schema has one field; ``fmt`` is json or csv. Rows keep the position
    of their record. A record whose value does not decode keeps its key, position, reason and
    value in base64. A missing value is a deletion: a row of NULLs, marked ``tombstone``.
    """
    key, value = (T.StructType.fromDDL(s) if isinstance(s, str) else s for s in (key, value))
    place = [c for c in ("topic", "partition", "offset", "timestamp") if c in records.columns]
    text = F.col("key").cast("string")
    keys = (
        [text.try_cast(key[0].dataType).alias(key[0].name)] if len(key) == 1
        else [F.from_json(text, key).getField(f).alias(f) for f in key.names]
    )
    body = F.col("value").cast("string")
    full = T.StructType([*value.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = (
        F.from_json(body, full, options) if fmt == "json"
        else F.from_csv(body, full.toDDL(), {**options, "escape": '"'})
    )
    rows = records.select(*keys, *place, body.alias("__body"), record.alias("__record"))
    failed = F.col("__body").isNotNull() & (
        F.col("__record").isNull() | F.col(f"__record.{CORRUPT}").isNotNull()
    )
    good = rows.where(~failed).select(
        *key.names, *[F.col(f"__record.{f}").alias(f) for f in value.names],
        F.col("__body").isNull().alias("tombstone"), *place,
    )
    bad = rows.where(failed).select(
        *key.names, *place, F.lit(f"value is no {fmt} record of its schema").alias("error_message"),
        F.base64(F.col("__body").cast("binary")).alias("record_b64"),
    )
    return good, bad


def _decoded(df: DataFrame, raw: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return df.withColumn("__record", F.from_json(F.col(raw), full, options))


def parse_or_reject(
    df: DataFrame, raw: str, schema: str | T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, dead letters) of a text column that should hold JSON.

    A dead letter keeps the other columns, the reason and the record in base64. Text
    that is no JSON, a value of a wrong type and a missing text are all rejected.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = _decoded(df, raw, schema)
    rest = [c for c in df.columns if c != raw]
    failed = F.col("__record").isNull() | F.col(f"__record.{CORRUPT}").isNotNull()
    whole = F.try_parse_json(F.col(raw))
    reason = (
        F.when(F.col(raw).isNull(), "record is missing")
        .when(whole.isNull(), "record is not valid JSON")
        .otherwise(f"record does not fit {schema.simpleString()}")
    )
    good = rows.where(~failed).select(
        *rest, *[F.col(f"__record.{f}").alias(f) for f in schema.fieldNames()]
    )
    bad = rows.where(failed).select(
        *rest, reason.alias("error_message"),
        F.base64(F.col(raw).cast("binary")).alias("record_b64"),
    )
    return good, bad
