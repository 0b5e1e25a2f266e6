"""Expectations, comparison, resuming and lineage."""

import pytest
from pyspark.sql import functions as F

from rillcask.operators import incremental, quality
from rillcask.operators.quality import Rule


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_expectations(spark, rows):
    df = make(spark, [(1, "a@b.org", "gold"), (2, "nope", None), (None, None, "tin")],
              "id int, mail string, tier string")
    rules = [Rule("id", "not_null"), Rule("mail", "email"), Rule("tier", "values", ("gold",))]
    assert rows(quality.check_expectations(df, rules)) == [
        ("id_not_null", 3, 1, False), ("mail_email", 3, 1, False), ("tier_values", 3, 1, False)]
    good, bad = quality.split_valid(df, rules)
    assert rows(good, "id") == [(1,)]
    assert rows(bad, "broken_rules") == [(["id_not_null", "tier_values"],), (["mail_email"],)]
    with pytest.raises(ValueError):
        Rule("id", "odd").broken()


def test_property_rules(spark, rows):
    df = make(spark, [
        ("t1", "changelog.mode", "append"), ("t1", "value.format", "avro-registri"),
        ("t1", "my.key", "x"), ("t2", "connector", "kafka"), ("t2", "key.schema-context", "dev"),
        ("t3", "changelog.mode", "upsert"), ("t3", "value.schema-context", ".dev"),
    ], "owner string, key string, value string")
    out = quality.check_properties(df, quality.STREAM_TABLE_RULES)
    assert rows(out, "owner", "key", "issue", "severity") == [
        ("t1", "value.format", "invalid_value", "error"),
        ("t2", "changelog.mode", "missing", "warning"),
        ("t2", "connector", "deprecated", "warning"),
        ("t2", "key.schema-context", "invalid_value", "error")]


def test_a_missing_value_of_a_restricted_key_is_an_issue(spark, rows):
    df = make(spark, [("t", "changelog.mode", None), ("t", "key.schema-context", None)],
              "owner string, key string, value string")
    out = quality.check_properties(df, quality.STREAM_TABLE_RULES)
    assert rows(out, "key", "issue") == [
        ("changelog.mode", "invalid_value"), ("key.schema-context", "invalid_value")]


@pytest.fixture
def ref(spark):
    return make(spark, [(i, f"v{i}", "x") for i in range(5)], "id int, v string, fmt string")


def test_comparison_with_itself_and_with_changes(spark, ref):
    assert quality.golden_diff(ref, ref.union(ref)).first().asDict() == {
        "missing": 0, "extra": 0, "overlap": 5, "match_pct": 100.0, "key_match": True,
        "passed": True}
    other = ref.withColumn("fmt", F.lit("y"))
    assert not quality.golden_diff(ref, other).first()["passed"]
    assert quality.golden_diff(ref, other, ignore=["fmt"], keys=["id"]).first()["passed"]
    one_off = ref.withColumn("v", F.when(F.col("id") == 0, "z").otherwise(F.col("v")))
    got = quality.golden_diff(ref, one_off, keys=["id"]).first()
    assert (got["match_pct"], got["passed"]) == (80.0, True)
    shorter = quality.golden_diff(ref, ref.where("id > 0"), keys=["id"]).first()
    assert (shorter["match_pct"], shorter["key_match"], shorter["passed"]) == (80.0, False, False)


def test_empty_reference_matches(ref):
    assert quality.golden_diff(ref.where("false"), ref).first()["match_pct"] == 100.0


def test_bag_comparison_counts_copies(ref, rows):
    assert rows(quality.diff_counts(ref.union(ref.where("id = 1")), ref), "id", "in_reference",
                "in_result") == [(1, 2, 1)]


def test_missing_items(ref, rows):
    assert rows(quality.missing_items(ref, ref.where("id <> 3"), "id")) == [(3,)]


def test_unchanged_finished_work_is_skipped(spark, rows):
    src = make(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, text string")
    done = src.where("id < 4").select(
        "id", incremental.content_hash("text").alias("content_hash"),
        F.when(F.col("id") == 2, "failed").otherwise("migrated").alias("status"))
    plan = incremental.plan_incremental(src, done, "id", "text")
    assert rows(plan, "id", "reason") == [(2, "open"), (4, "new")]
    changed = src.withColumn("text", F.concat("text", F.lit("!")))
    again = incremental.plan_incremental(changed, done, "id", "text")
    assert rows(again, "id", "reason") == [
        (1, "changed"), (2, "changed"), (3, "changed"), (4, "new")]
    assert incremental.plan_incremental(
        src.where("id in (1, 3)"), done, "id", "text").isEmpty()


def test_outcomes_are_recorded(spark, rows):
    schema = "id int, status string, error string, updated_at string"
    manifest = make(spark, [(1, "pending", None, "t0"), (2, "failed", "old", "t0")], schema)
    results = make(spark, [(2, "failed", "new", "t1"), (2, "migrated", None, "t2")], schema)
    assert rows(incremental.update_manifest(manifest, results, "id")) == [
        (1, "pending", None, "t0"), (2, "migrated", None, "t2")]
    with pytest.raises(KeyError):
        incremental.update_manifest(manifest, make(spark, [(9, "x", None, "t")], schema), "id")


def test_undeclared_sources(spark, rows):
    refs = make(spark, [("Sink", "src"), ("Sink", "DIM"), ("Sink", "sink"), ("Sink", "known")],
                "target string, source string")
    declared = make(spark, [("KNOWN",)], "name string")
    assert rows(incremental.missing_sources(refs, declared)) == [("Sink", "DIM"), ("Sink", "src")]


def test_run_order(spark, rows):
    edges = make(spark, [("enriched", "orders"), ("enriched", "items"), ("report", "enriched"),
                         ("report", "orders")], "child string, parent string")
    assert rows(incremental.run_order(edges)) == [
        ("enriched", 1), ("items", 0), ("orders", 0), ("report", 2)]
    with pytest.raises(ValueError):
        incremental.run_order(edges.union(make(spark, [("orders", "report")], edges.schema)))
