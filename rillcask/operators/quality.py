"""Expectations, property rules and table comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


@dataclass(frozen=True)
class Rule:
    """An expectation: kind is not_null, values (NULL allowed) or email."""

    column: str
    kind: str
    allowed: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.column}_{self.kind}"

    def broken(self) -> Column:
        value = F.col(self.column)
        if self.kind == "not_null":
            return value.isNull()
        if self.kind == "values":
            return value.isNotNull() & ~value.isin(*self.allowed)
        if self.kind == "email":
            return value.isNotNull() & ~value.rlike(EMAIL)
        raise ValueError(f"unknown expectation: {self.kind}")


def check_expectations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Checked and failing rows per rule, all from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(rule.broken()).alias(rule.name) for rule in rules],
    )
    pairs = [F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("failed")) for r in rules]
    return counts.select("__all", F.explode(F.array(*pairs)).alias("r")).select(
        "r.rule", F.col("__all").alias("checked"), "r.failed",
        (F.col("r.failed") == 0).alias("passed"),
    )


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, other rows with the names of the rules they break)."""
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    marked = df.withColumn("broken_rules", names)
    empty = F.size("broken_rules") == 0
    return marked.where(empty).drop("broken_rules"), marked.where(~empty)


@dataclass(frozen=True)
class PropertyRules:
    """What keys and values a property table may hold. Unknown keys pass."""

    allowed: dict[str, tuple[str, ...]]
    suffix_patterns: dict[str, str]
    deprecated: tuple[str, ...] = ()
    recommended: tuple[str, ...] = ()


# Property rules of a stream table definition.
STREAM_TABLE_RULES = PropertyRules(
    allowed={
        "changelog.mode": ("append", "upsert"),
        "value.format": ("json-registry", "avro-registry"),
        "key.format": ("json-registry", "avro-registry"),
        "scan.startup.mode": ("earliest-offset",),
        "scan.bounded.mode": ("unbounded",),
        "value.fields-include": ("all",),
        "kafka.producer.compression.type": ("snappy",),
    },
    suffix_patterns={".schema-context": r"^\..+"},
    deprecated=("connector", "topic", "format"),
    recommended=("changelog.mode",),
)


def check_properties(
    props: DataFrame, rules: PropertyRules, owner: str = "owner", key: str = "key",
    value: str = "value",
) -> DataFrame:
    """Issues of a (owner, key, value) table as (owner, key, value, issue, severity)."""
    issue = F.when(F.col(key).isin(*rules.deprecated), "deprecated")
    for name, allowed in rules.allowed.items():
        fits = F.coalesce(F.col(value).isin(*allowed), F.lit(False))  # a NULL value never fits
        issue = issue.when((F.col(key) == name) & ~fits, "invalid_value")
    for suffix, pattern in rules.suffix_patterns.items():
        wrong = F.col(key).endswith(suffix) & ~F.coalesce(F.col(value).rlike(pattern), F.lit(False))
        issue = issue.when(wrong, "invalid_value")
    named = [F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(value).alias("value")]
    found = props.select(*named, issue.alias("issue")).where("issue is not null")
    has = [F.bool_or(F.col(key) == name).alias(f"__{i}") for i, name in enumerate(rules.recommended)]
    absent = F.array_compact(F.array(*[
        F.when(~F.col(f"__{i}"), F.lit(name)) for i, name in enumerate(rules.recommended)
    ]))
    missing = props.groupBy(F.col(owner).alias("owner")).agg(*has).select(
        "owner", F.explode(absent).alias("key"), F.lit(None).cast("string").alias("value"),
        F.lit("missing").alias("issue"),
    ) if rules.recommended else None
    out = found if missing is None else found.unionByName(missing)
    severity = F.when(F.col("issue") == "invalid_value", "error").otherwise("warning")
    return out.withColumn("severity", severity)


def diff_rows(ref: DataFrame, got: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Distinct rows of both tables with ``side`` missing, extra or both.

    One union and one aggregate, with NULLs equal, instead of three set operations.
    """
    cols = [c for c in ref.columns if c not in (ignore or [])]
    tagged = ref.select(*cols, F.lit(1).alias("__in")).union(
        got.select(*cols, F.lit(2).alias("__in"))
    )
    sides = tagged.groupBy(*cols).agg(F.bit_or("__in").alias("__in"))
    side = F.when(F.col("__in") == 1, "missing").when(F.col("__in") == 2, "extra")
    return sides.withColumn("side", side.otherwise("both")).drop("__in")


def diff_counts(ref: DataFrame, got: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Bag version: rows with how often each table holds them, where that differs."""
    cols = [c for c in ref.columns if c not in (ignore or [])]
    tagged = ref.select(*cols, F.lit(1).alias("__r"), F.lit(0).alias("__g")).union(
        got.select(*cols, F.lit(0).alias("__r"), F.lit(1).alias("__g"))
    )
    return tagged.groupBy(*cols).agg(
        F.sum("__r").alias("in_reference"), F.sum("__g").alias("in_result")
    ).where("in_reference <> in_result")


def golden_diff(
    ref: DataFrame, got: DataFrame, ignore: list[str] | None = None,
    keys: list[str] | None = None, min_match: float = 80.0,
) -> DataFrame:
    """One row: missing, extra, overlap, match percent, strict key match, passed.

    Rows count once however often they occur. An empty reference matches fully. Keys
    match when both tables hold the same set of key values.
    """
    sides = diff_rows(ref, got, ignore).agg(
        F.count_if(F.col("side") == "missing").alias("missing"),
        F.count_if(F.col("side") == "extra").alias("extra"),
        F.count_if(F.col("side") == "both").alias("overlap"),
    )
    total = F.col("overlap") + F.col("missing")
    out = sides.withColumn(
        "match_pct", F.when(total > 0, F.col("overlap") * 100 / total).otherwise(100.0)
    )
    if keys:
        unmatched = diff_rows(ref.select(*keys), got.select(*keys)).agg(
            F.count_if(F.col("side") != "both")
        ).scalar()
        out = out.withColumn("key_match", unmatched == 0)
    else:
        out = out.withColumn("key_match", F.lit(True))
    return out.withColumn("passed", F.col("key_match") & (F.col("match_pct") >= min_match))


def missing_items(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Expected keys absent from the result."""
    return expected.select(key).distinct().join(got.select(key), key, "left_anti")
