"""Expectations, comparison and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillcask.catalog import query, table
from rillcask.operators import incremental, quality

CUSTOMERS = """(select c_custkey, c_mktsegment as segment, case when c_nationkey = 3 then null
    when c_nationkey = 4 then 'no mail' else lower(c_mktsegment) || c_custkey::varchar ||
    '@mail.example' end as email from customer)"""


def _customers(spark, folder):
    nation, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    email = F.when(nation == 4, "no mail").when(
        nation != 3, F.concat(F.lower("c_mktsegment"), key, F.lit("@mail.example"))
    )
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), email.alias("email")
    )


SEGMENTS = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")
RULES = [
    quality.Rule("c_custkey", "not_null"), quality.Rule("email", "not_null"),
    quality.Rule("email", "email"), quality.Rule("segment", "values", SEGMENTS),
]


@query("expectations", f"""
    with c as (select * from {CUSTOMERS}), f as (
      select 'c_custkey_not_null' as rule, count(*) filter (c_custkey is null) as failed from c
      union all select 'email_not_null', count(*) filter (email is null) from c
      union all select 'email_email', count(*) filter (email = 'no mail') from c
      union all select 'segment_values', count(*) filter (segment = 'FURNITURE') from c)
    select rule, (select count(*) from c) as checked, failed, failed = 0 as passed from f""")
def expectations(spark, folder):
    return quality.check_expectations(_customers(spark, folder), RULES)


@query("valid_rows", f"""
    select * from {CUSTOMERS} where email <> 'no mail' and segment <> 'FURNITURE'""")
def valid_rows(spark, folder):
    return quality.split_valid(_customers(spark, folder), RULES)[0]


@query("broken_rows", f"""
    select c_custkey, concat_ws(',', case when email is null then 'email_not_null' end,
      case when email = 'no mail' then 'email_email' end,
      case when segment = 'FURNITURE' then 'segment_values' end) as broken
    from {CUSTOMERS} where email is null or email = 'no mail' or segment = 'FURNITURE'""")
def broken_rows(spark, folder):
    return quality.split_valid(_customers(spark, folder), RULES)[1].select(
        "c_custkey", F.array_join("broken_rules", ",").alias("broken")
    )


@query("property_rules", """
    with props as (
      select o_orderkey as owner, 'changelog.mode' as key, case o_orderstatus when 'F' then 'append'
        when 'O' then 'upsert' else 'retract' end as value from orders where o_orderpriority <> '5-LOW'
      union all select o_orderkey, 'connector', 'kafka' from orders where o_orderstatus = 'P'
      union all select o_orderkey, 'value.schema-context', case o_orderstatus when 'F' then '.team-a'
        else 'team-a' end from orders
      union all select o_orderkey, 'unknown', 'x' from orders)
    select owner, key, value, 'invalid_value' as issue, 'error' as severity from props
      where (key = 'changelog.mode' and value not in ('append', 'upsert'))
        or (key = 'value.schema-context' and value not like '.%')
    union all select owner, key, value, 'deprecated', 'warning' from props where key = 'connector'
    union all select o_orderkey, 'changelog.mode', null, 'missing', 'warning' from orders
      where o_orderpriority = '5-LOW'""")
def property_rules(spark, folder):
    """Properties of a table per order, one row per key."""
    status, owner = F.col("o_orderstatus"), F.col("o_orderkey").alias("owner")
    orders = table(spark, folder, "orders")

    def pair(rows, key, value):
        return rows.select(owner, F.lit(key).alias("key"), value.alias("value"))

    mode = F.when(status == "F", "append").when(status == "O", "upsert").otherwise("retract")
    context = F.when(status == "F", ".team-a").otherwise("team-a")
    props = (
        pair(orders.where("o_orderpriority <> '5-LOW'"), "changelog.mode", mode)
        .union(pair(orders.where("o_orderstatus = 'P'"), "connector", F.lit("kafka")))
        .union(pair(orders, "value.schema-context", context))
        .union(pair(orders, "unknown", F.lit("x")))
    )
    return quality.check_properties(props, quality.STREAM_TABLE_RULES)


def _document_versions(spark, folder):
    """All documents, and a second version: German ones missing, French ones changed."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    changed = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    return docs, docs.where("lang <> 'de'").withColumn("text", changed)


VERSIONS = """with ref as (select doc_id, lang, text from documents), got as (
      select doc_id, lang, case when lang = 'fr' then upper(text) else text end as text
      from documents where lang <> 'de'),
    c as (select (select count(*) from (select * from ref except select * from got)) as missing,
      (select count(*) from (select * from got except select * from ref)) as extra,
      (select count(*) from (select * from ref intersect select * from got)) as overlap) """


@query("golden_diff", VERSIONS + """
    select missing, extra, overlap, overlap * 100::double / (overlap + missing) as match_pct,
      false as key_match, false as passed from c""")
def golden_diff(spark, folder):
    ref, got = _document_versions(spark, folder)
    return quality.golden_diff(ref, got, keys=["doc_id"])


@query("golden_diff_ignoring", """
    with ref as (select distinct lang from documents)
    select 0 as missing, 0 as extra, count(*) as overlap, 100.0::double as match_pct,
      true as key_match, true as passed from ref""")
def golden_diff_ignoring(spark, folder):
    """Only the language remains once the other columns are ignored."""
    ref, _ = _document_versions(spark, folder)
    return quality.golden_diff(ref, ref.orderBy("doc_id"), ignore=["doc_id", "text"], keys=["doc_id"])


@query("multiset_diff", """
    select l_suppkey, l_returnflag, count(*) as in_reference,
      count(*) filter (l_linestatus = 'F') as in_result from lineitem group by 1, 2
    having count(*) <> count(*) filter (l_linestatus = 'F')""")
def multiset_diff(spark, folder):
    items = table(spark, folder, "lineitem")
    columns = ["l_suppkey", "l_returnflag"]
    return quality.diff_counts(
        items.select(*columns), items.where("l_linestatus = 'F'").select(*columns)
    )


@query("missing_items", """
    select c_custkey from customer where c_custkey not in
      (select o_custkey from orders where o_totalprice > 400000)""")
def missing_items(spark, folder):
    got = table(spark, folder, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey")
    )
    return quality.missing_items(table(spark, folder, "customer"), got, "c_custkey")


MANIFEST = """(select d.doc_id, sha256(case when lang = 'fr' then upper(text) else text end)
    as content_hash, case quality when 0 then 'failed' when 1 then 'completed' else 'pending' end
    as status, d.source from documents d left join labels l using (doc_id) where lang <> 'es')"""


def _manifest(spark, folder):
    """Spanish documents are unknown, French ones have changed, labels give the status."""
    docs = table(spark, folder, "documents").where("lang <> 'es'")
    old = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    status = F.when(F.col("quality") == 0, "failed").when(
        F.col("quality") == 1, "completed"
    ).otherwise("pending")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", F.sha2(old.cast("binary"), 256).alias("content_hash"), status.alias("status"),
        "source",
    )


@query("incremental_plan", f"""
    select d.doc_id, sha256(d.text) as content_hash, case when m.doc_id is null then 'new'
      when sha256(d.text) <> m.content_hash then 'changed' else 'open' end as reason
    from documents d left join {MANIFEST} m on m.doc_id = d.doc_id
    where m.doc_id is null or sha256(d.text) <> m.content_hash or status <> 'completed'""")
def incremental_plan(spark, folder):
    return incremental.plan_incremental(
        table(spark, folder, "documents"), _manifest(spark, folder), "doc_id", "text"
    )


@query("manifest_update", f"""
    select m.doc_id, case when l.doc_id is not null then 'completed' else status end as status,
      case when toxic = 1 then 'toxic' end as error,
      case when l.doc_id is not null then 'run 2' else 'run 1' end as updated_at
    from {MANIFEST} m left join labels l on l.doc_id = m.doc_id""")
def manifest_update(spark, folder):
    manifest = _manifest(spark, folder).select(
        "doc_id", "status", F.lit(None).cast("string").alias("error"),
        F.lit("run 1").alias("updated_at"),
    )
    known = table(spark, folder, "documents").where("lang <> 'es'")
    results = table(spark, folder, "labels").join(known, "doc_id", "left_semi").select(
        "doc_id", F.lit("completed").alias("status"),
        F.when(F.col("toxic") == 1, "toxic").alias("error"), F.lit("run 2").alias("updated_at"),
    )
    return incremental.update_manifest(manifest, results, "doc_id")


@query("missing_sources", """
    select distinct c_mktsegment as target, lower(n_name) as source
    from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 0""")
def missing_sources(spark, folder):
    """Segments read nations; only those of the first region are declared, in upper case."""
    nations = table(spark, folder, "nation")
    refs = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_mktsegment").alias("target"), F.lower("n_name").alias("source"))
    declared = nations.where("n_regionkey = 0").select(F.upper("n_name").alias("name"))
    return incremental.missing_sources(refs, declared)


@query("run_order", """
    select 'region ' || r_regionkey::varchar as name, 0 as level from region
    union all select 'nation ' || n_nationkey::varchar, 1 from nation
    union all select 'customer ' || c_custkey::varchar, 2 from customer
    union all select distinct 'order ' || o_orderkey::varchar, 3 from orders""")
def run_order(spark, folder):
    """Orders need customers, customers nations, nations regions."""
    def edge(name, kind, key, parent_kind, parent):
        return table(spark, folder, name).select(
            F.concat(F.lit(f"{kind} "), F.col(key).cast("string")).alias("child"),
            F.concat(F.lit(f"{parent_kind} "), F.col(parent).cast("string")).alias("parent"),
        )

    edges = (
        edge("orders", "order", "o_orderkey", "customer", "o_custkey")
        .union(edge("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .union(edge("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    )
    return incremental.run_order(edges)
