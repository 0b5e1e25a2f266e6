"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, exact, langid, licenses, mixing, mixlm, near, packing, repeats, spelling, tokens, topk, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_exact_dedup", """
with t as (select doc_id, coalesce("text", '') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept,
       sha256(t.body) as text_sha256
from t join g on t.body = g.body
""")
def op1_exact_dedup(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"), keep="largest")


@query("op2_minhash_dedup")
def op2_minhash_dedup(spark, folder):
    return near.near_groups(table(spark, folder, "documents"), width=3, percent=85)


@query("op3_maxscore_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(
    embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
  from v as q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
""")
def op3_maxscore_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), capacity=2048)


@query("op5_language_id")
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.filter(~held))
    return langid.predict(
        docs.select("doc_id", "text", held.alias("held_out")), model
    ).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_license_scan")
def op6_license_scan(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_context_mixing")
def op7_context_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = mixlm.score_texts(docs, langid.held_out(F.col("doc_id"), 7, 2))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        (F.col("bits") * F.lit(-0.30102999566398120)).alias("score"), "bits_per_byte",
    )


@query("op8_token_packing")
def op8_token_packing(spark, folder):
    return tokens.packed_tokens(table(spark, folder, "documents").select("doc_id", "text"))


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@query("op9_url_filter", r"""
with u as (
  select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
a as (
  select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from u),
b as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from a),
p as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
rules(rhost, rpath, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
listed as (select host, path from p where host <> '' group by host, path having count(*) > 1),
best as (
  select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
         arg_max(verdict, length(rhost || rpath)) as verdict
  from (select distinct host, path from p) d join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by host, path)
select page_id, p.host, p.path, rule,
       coalesce(verdict, case when l.host is not null then 'block' else 'allow' end) as verdict
from p left join best using (host, path) left join listed l on p.host = l.host and p.path = l.path
""")
def op9_url_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.url_verdicts(pages, rules, urls.repeated(pages))


@query("op10_source_mixing", r"""
with d as (
  select doc_id, source, md5('mix:' || cast(doc_id as varchar)) as hash,
         len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) as place from d group by source),
w as (
  select *, case (place - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double
            else 2.0::double end as weight, source_size * 2.0::double as cap from s),
l as (
  select *, ((select sum(source_size) from w) * 1.5::double - coalesce(sum(cap) over (
    order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (
    order by cap / weight, place rows between current row and unbounded following) as level
  from w),
f as (
  select min_by(level, (cap / weight, place)) as level from l where level <= cap / weight),
t as (
  select source, source_size, least(cap, f.level * weight) as target from w, f),
n as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as repeats from t),
o as (
  select d.*, n.source_size, n.target, n.repeats, coalesce(sum(size) over (
    partition by d.source order by hash rows between unbounded preceding and 1 preceding), 0) as done
  from d join n on d.source is not distinct from n.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(size * (repeats + case when done + size / 2.0::double
         <= target - repeats * source_size then 1 else 0 end) as bigint) as taken
from o
""")
def op10_source_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mixture(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


@query("op11_token_alignment")
def op11_token_alignment(spark, folder):
    documents, _ = alignment.align_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return documents


@query("op12_spelling_variants")
def op12_spelling_variants(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.spelling_variants(spelling.word_counts(docs, slip=97))


@query("op13_suffix_dedup", """
with t as (select doc_id, hex(encode(coalesce("text", ''))) as hx from documents),
w as (
  select doc_id, p, substr(hx, cast(2 * p + 1 as bigint), 200) as s
  from (select doc_id, hx, unnest(generate_series(0, len(hx) // 2 - 100)) as p from t)),
f as (select s, min(doc_id) as d, arg_min(p, (doc_id, p)) as p from w group by s having count(*) > 1),
r as (select w.doc_id, w.p from w join f on w.s = f.s where w.doc_id <> f.d or w.p <> f.p),
e as (
  select *, sum(fresh) over (partition by doc_id order by p) as run
  from (select *, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1
        end as fresh from r)),
spans as (
  select doc_id, min(p) as low, max(p) + 100 as high from e group by doc_id, run),
pieces as (
  select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as back
  from spans),
cuts as (
  select doc_id, count(*) as n_spans, sum(high - low) as n_removed, max(high) as last,
    string_agg(substr(hx, cast(2 * back + 1 as bigint), cast(2 * (low - back) as bigint)), ''
      order by low) as front
  from pieces join t using (doc_id) group by doc_id)
select doc_id, cast(len(hx) // 2 as bigint) as n_bytes,
  cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(front, '') || substr(hx, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from t left join cuts using (doc_id)
""")
def op13_suffix_dedup(spark, folder):
    found = repeats.find_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
