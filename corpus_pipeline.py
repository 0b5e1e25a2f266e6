"""From documents to packed training bins: identify the language, drop copies and near copies,
mix the sources, pack. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcask.llm import exact, langid, mixing, near, packing
from rillcask.llm.common import stored

CAPACITY = 2048  # words of a bin


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without a letter go, and those that the classifier puts
    outside every language it has learned (short ones, which it can't tell, stay)."""
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    told = langid.predict(rows, model)
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("foreign")).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return exact.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return near.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a repeated one as repeated rows."""
    mixed = mixing.mixture(docs).filter("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies; repetitions of a document never share a bin."""
    return packing.pack(docs, CAPACITY)


STAGES = [
    ("language", language), ("exact copies", exact_copies), ("near copies", near_copies),
    ("source mix", source_mix), ("bins", bins),
]

# The language model and the bin search can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
