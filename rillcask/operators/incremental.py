"""Resuming work by content hash, recording outcomes, and lineage order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.operators.dedup import latest_by_key
from rillcask.operators.skew import pinned

# States that still need work.
OPEN_STATES = ("pending", "failed", "interrupted", "in_progress")


def content_hash(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def plan_incremental(
    src: DataFrame, manifest: DataFrame, key: str, content: str
) -> DataFrame:
    """Items to work on with their new hash and the reason: new, changed or open.

    ``manifest`` holds (key, content_hash, status). An unchanged item that is done is
    left out.
    """
    now = src.select(key, content_hash(content).alias("content_hash"))
    known = manifest.select(
        F.col(key).alias("__key"), F.col("content_hash").alias("__hash"),
        F.col("status").alias("__status"),
    )
    reason = (
        F.when(F.col("__key").isNull(), "new")
        .when(~F.col("content_hash").eqNullSafe(F.col("__hash")), "changed")
        .when(F.col("__status").isin(*OPEN_STATES), "open")
    )
    return now.join(known, F.col(key) == F.col("__key"), "left").withColumn(
        "reason", reason
    ).where("reason is not null").drop("__key", "__hash", "__status")


def unknown_items(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results for items the manifest does not hold."""
    return results.select(key).join(manifest.select(key), key, "left_anti")


def update_manifest(
    manifest: DataFrame, results: DataFrame, key: str, updated: str = "updated_at"
) -> DataFrame:
    """Manifest with the newest status, error and time per item.

    ``results`` holds (key, status, error, updated_at). An unknown item is an error.
    """
    if not unknown_items(manifest, results, key).isEmpty():
        raise KeyError(f"results name items that are not in the manifest by {key}")
    last = latest_by_key(
        results.select(key, "status", "error", updated), [key], [updated, "status"]
    ).select(
        F.col(key).alias("__key"), F.col("status").alias("__status"),
        F.col("error").alias("__error"), F.col(updated).alias("__updated"),
    )
    hit = F.col("__key").isNotNull()
    joined = manifest.join(last, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({
        "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
        "error": F.when(hit, F.col("__error")).otherwise(F.col("error")),
        updated: F.when(hit, F.col("__updated")).otherwise(F.col(updated)),
    }).select(*manifest.columns)


def missing_sources(refs: DataFrame, declared: DataFrame, target: str = "target",
                    source: str = "source", name: str = "name") -> DataFrame:
    """Sources a target reads that nothing declares; case and self-reads do not count."""
    known = declared.select(F.lower(name).alias("__name")).distinct()
    return (
        refs.where(F.lower(source) != F.lower(target))
        .join(known, F.lower(source) == F.col("__name"), "left_anti")
        .select(target, source).distinct()
    )


def run_order(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Level of every table in a lineage: 0 without parents, else one above the deepest.

    Each table looks up its parents; every round it looks up what those have looked up, so it sees
    twice as far. A row (n, up, steps) leads ``steps`` tables up; where that is a table without
    parents ``up`` is NULL, and of those only the longest way counts. The rounds are the logarithm
    of the depth and each writes one table. Ways that never end are a cycle, which is an error. Run
    levels upward to build, downward to drop.
    """
    links = pinned(edges.select(F.col(child).alias("n"), F.col(parent).alias("p")).distinct())
    names = pinned(links.select(F.explode(F.array("n", "p")).alias("n")).distinct())
    inner = links.select(F.col("n").alias("inner")).distinct()
    ways = pinned(
        links.join(inner, F.col("p") == F.col("inner"), "left")
        .select("n", F.col("inner").alias("up"), F.lit(1).cast("long").alias("steps")).distinct()
    )
    rounds, most = 0, names.count().bit_length() + 1
    while not ways.where("up is not null").isEmpty():
        rounds += 1
        if rounds > most:
            raise ValueError("the lineage has a cycle")
        further = ways.select(F.col("n").alias("at"), F.col("up").alias("next"), F.col("steps").alias("more"))
        doubled = ways.where("up is not null").join(further, F.col("up") == F.col("at")).select(
            "n", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps")
        )
        ways = pinned(
            doubled.unionByName(ways.where("up is null")).groupBy("n", "up").agg(F.max("steps").alias("steps"))
        )
    levels = ways.select(F.col("n").alias("name"), F.col("steps").alias("level"))
    return names.withColumnRenamed("n", "name").join(levels, "name", "left").select(
        "name", F.coalesce("level", F.lit(0)).cast("int").alias("level")
    )
