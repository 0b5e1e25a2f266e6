"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

BIN_DIGITS = 3  # leading hex digits of the order hash: 4,096 bins a source
AFTER_ALL = "g"  # sorts after every hex hash


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    Sources share ``share`` times all sizes by weight; a source is clamped at ``epochs`` times its
    size and the excess goes to the others by weight until none is above. That end point is found
    directly: in order of size per weight, the first source that isn't clamped fixes the level of
    all later ones. One row per source; the running sums are over sources, not documents.
    """
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole.partitionBy()) * F.lit(float(share))
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("level", level)
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True)
                    .over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .drop("cap", "level", "fits")
    )


def order_hash(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixture_plan(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """source, source_size, target, repeats, cut: one row per source.

    A document is taken ``repeats`` times, and once more if its order hash is at most ``cut``:
    documents follow in hash order while half of the next one still fits the rest of the target.
    Sizes per hash are added up in bins first; only the bin that holds the cut is gone through
    row by row. Rows that repeat an id share a hash and are taken alike.
    """
    size = n_words(F.col("text")) if size is None else size
    units = stored(docs.select(
        F.col(source_col).cast("string").alias("source"), size.alias("size"),
        order_hash(seed, F.col(id_col)).alias("hash"),
    ).groupBy("source", "hash").agg(F.sum("size").alias("size")), "mix-units")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "place", place
    ).withColumn("weight", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights)))))
    plan = water_fill(sources, share, epochs).withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long")
    ).withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size"))
    plan = stored(plan, "mix-plan")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    units = units.withColumn("bin", F.substring("hash", 1, BIN_DIGITS))
    running = Window.partitionBy("source").orderBy("bin")
    bins = units.groupBy("source", "bin").agg(F.sum("size").alias("size")).withColumn(
        "after", F.sum("size").over(running)
    )
    need = plan.select("source", "need")
    edge = bins.join(need, same(bins, need)).filter("after > need").groupBy(bins["source"]).agg(
        F.min_by(F.struct("bin", (F.col("after") - F.col("size")).alias("done"), "need"), "bin").alias("e")
    ).select("source", "e.*")
    edge = stored(edge, "mix-edge")
    inside = units.join(edge, same(units, edge) & (units["bin"] == edge["bin"])).select(
        edge["source"], edge["bin"], "hash", "size", "done", "need"
    )
    sofar = Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn(
        "done", F.col("done") + F.coalesce(F.sum("size").over(sofar), F.lit(0))
    ).groupBy("source", "bin").agg(F.max(
        F.when(F.col("done") + F.col("size") / F.lit(2.0) <= F.col("need"), F.col("hash"))
    ).alias("cut")).select(
        F.col("source").alias("edge_source"), F.coalesce("cut", "bin").alias("cut")
    )
    return plan.join(taken, plan["source"].eqNullSafe(taken["edge_source"]), "left").select(
        "source", "source_size", "target", "repeats", F.coalesce("cut", F.lit(AFTER_ALL)).alias("cut")
    )


def mixture(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
    size: Column | None = None, seed: str = "mix", **options,
) -> DataFrame:
    """row (all columns as a struct), doc_id, size, source_size, target, times: one row per row.

    ``times`` is how often the mix takes the document, at most ``epochs`` times. Sources are
    weighted in code-point order, null last; a null id is hashed as an empty one; a null text has
    size 0. The same rows and seed give the same mix. The plan has one row per source and is
    joined by source; texts are not shuffled while Spark finds that table small enough to send.
    """
    plan = stored(mixture_plan(docs, id_col, source_col, size, seed=seed, **options), "mix-plan")
    size = n_words(F.col("text")) if size is None else size
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"),
        F.col(source_col).cast("string").alias("of"), order_hash(seed, F.col(id_col)).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return rows.join(plan, rows["of"].eqNullSafe(plan["source"])).select(
        "row", "doc_id", "size", "source_size", "target",
        (F.col("repeats") + (F.col("hash") <= F.col("cut")).cast("long")).alias("times"),
    )
