"""Shared helpers: stored intermediate tables, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillcask.session import new_folder

# What separates words, and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_sum(df: DataFrame, label: str, column: str) -> tuple[DataFrame, int | None]:
    """``stored``, and the sum of a column of whole numbers, taken while the table is written."""
    seen = Observation()
    total = F.sum(F.col(column).cast("decimal(38,0)")).alias("total")
    return stored(df.observe(seen, total), label), seen.get["total"]


class Scratch:
    """Tables of a job of many steps, in one shared folder, each there for as long as it is needed.

    The shuffle files of a step go as soon as its table is written. Else they would stay until the
    driver collects its garbage, and disk would grow with the number of steps.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder = spark, new_folder(spark, label)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        conf, path = self.spark.conf, f"{self.folder}/{name}"
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_text(column: str) -> Column:
    """A whole-number id as text: pandas makes floating-point numbers of a column with a null, and
    ids above 2^53 would change. Cast it back to long behind the Python code."""
    return F.col(column).cast("long").cast("string")


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split on ASCII white space, exactly as ``WORD`` does.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is what is wanted here.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

