"""Exact duplicates, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEEP = {"smallest": F.min, "largest": F.max}


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _classes(keyed: DataFrame, keep: str) -> DataFrame:
    """One row per different text. Grouping by hash and text compares the bytes of the texts
    inside a hash group; copies are folded map-side, so a hot text is one row per task."""
    return keyed.groupBy("hash", "text").agg(
        KEEP[keep]("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Rows are equal when their texts have the same bytes; a null text counts as empty. ``keep``
    names the id that stays: "smallest" or "largest". Rows that repeat an id with the same text
    are one document: each is returned and shares ``kept``. A null id stays only in a group
    without any other id. Empty tables give no rows; other columns are not looked at.

    The texts are shuffled once, under their 128-bit hash. Rows then find their class by the hash
    alone; only where two texts share a hash do they find it by hash and text. The class table is
    written first, so that the join reads two plain shuffles and Spark can split a hot hash.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("hash", hash_of(F.col("text")))
    classes = stored(
        _classes(keyed, keep).select(
            "hash", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")
        ), "exact-classes",
    )
    shared = classes.groupBy("hash").count().filter("count > 1").select("hash")
    members = keyed.select("doc_id", "hash")
    if shared.isEmpty():
        found = members.join(classes, "hash")
    else:
        clash = stored(shared, "exact-shared-hashes")
        texts = _classes(keyed.join(clash, "hash", "left_semi"), keep).withColumn(
            "text_sha256", F.sha2("text", 256)
        )
        found = members.join(classes.join(clash, "hash", "left_anti"), "hash").unionByName(
            keyed.join(clash, "hash", "left_semi").join(texts, ["hash", "text"]).drop("text")
        )
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row of ``docs`` per text, all columns: the row ``exact_groups`` keeps.

    The same grouping by hash and bytes, which here carries the other columns along, so the texts
    are shuffled once and joined with nothing. Of rows that repeat an id and a text one stays; a
    null id loses against any other.
    """
    rest = [c for c in docs.columns if c != text_col]
    one = F.col(id_col)
    pick, order = (
        (F.min_by, F.struct(one.isNull(), one)) if keep == "smallest"
        else (F.max_by, F.struct(one.isNotNull(), one))
    )
    row = F.struct(
        F.col(text_col).isNull().alias("none"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
    )
    found = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), order.alias("order"), row.alias("row")
    ).withColumn("hash", content_hash(F.col("text"))).groupBy("hash", "text").agg(
        pick("row", "order").alias("row")
    )
    text = F.when(~F.col("row.none"), F.col("text")).alias(text_col)
    return found.select(*[
        text if c == text_col else F.col(f"row.rest.`{c}`") for c in docs.columns
    ])
