"""URL verdicts, source mixing and the corpus pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillcask.llm import mixing, queries, urls
from tests.oracle import compare, connect

from .helpers import LOWER, best_fit, mix, near_components, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    got = compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name])
    assert got["match"] is True, got


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/", "block"),
         ("org", "/fr/", "allow"), ("net", "/", "block")]


def verdict(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark)[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, said = max(fits)
        return host, path, rule, said
    return host, path, None, "block" if host and (host, path) in listed else "allow"


def test_url_verdicts(spark):
    given = [None, "", "no scheme", "http://X.NET/a?b://c", "http://x.net", "http://b.example.net/en/1",
             "https://a.example.net/en/1#x", "http://notexample.net/en/", "http://w.org/fr/1", "http://w.org/de/1",
             "http://w.org/de/1?again", "ftp://q.com/p", "http://net/", "://net/x", "http://É.Org/fr/", "http://?x",
             "http://long.com/" + "p" * 100_000, "a://b://net/", "http://x.net\n/y"]
    rows = [(i, u, "h", "r") for i, u in enumerate(given)] + [(None, "http://x.net/a", "h", "r"), (3, given[3], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.url_verdicts(pages, rules, urls.repeated(pages)).collect()
    places = [verdict(u, set())[:2] for _, u, *_ in rows]
    listed = {p for p in places if places.count(p) > 1}
    want = sorted(((i, *verdict(u, listed)) for i, u, *_ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_url_verdicts_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([], "host string, path string")
    assert urls.url_verdicts(pages.limit(0), rules, listed).collect() == []
    assert [tuple(r) for r in urls.url_verdicts(pages, rules, listed).collect()] == [(1, "a.b", "/c", None, "allow")]


def test_bloom_filter_never_misses(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    hit = urls.bloom(keys)
    assert keys.filter(~hit(keys["key"])).isEmpty()
    others = spark.range(20_000, 60_000).selectExpr("concat('k', id) as key")
    assert others.filter(hit(others["key"])).count() < 400


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["a", "b", "c", "d", "é", "z", None]])
def test_mixing_equals_sharing_anew(spark, sources):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), sources[min(i % 11, i % len(sources))], 1, "t") for i in range(200)]
    rows += [(900, None, sources[0], 1, "t"), (901, "", sources[-1], 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, hash string")
    got = {r.doc_id: (r.target, r.size * r.times) for r in mixing.mixture(df).collect()}
    want = mix([r[:3] for r in rows])
    assert {i: t for i, (_, t) in got.items()} == {i: t for i, (_, t) in want.items()}
    assert all(abs(got[i][0] - want[i][0]) < 1e-6 for i in want)


def test_mixing_with_repeated_and_null_ids_and_of_nothing(spark):
    rows = [(None, "a b c", "s")] * 3 + [(1, "a b", "s")] * 2 + [(2, "", None), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(((r.doc_id, r.size, r.times) for r in mixing.mixture(df).collect()), key=str)
                    for _ in range(2))
    assert first == again and len(first) == 7
    assert len({t for i, _, t in first if i is None}) == 1
    assert mixing.mixture(df.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.size * r.times for r in mixing.mixture(blank).collect()} == {0}


def test_language_stage_rejects_what_the_classifier_puts_outside(spark):
    """Long texts of no learned language go although they have letters; all clean ones stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    strange = "Αυτό είναι ένα κείμενο στα ελληνικά για να δούμε την βαθμολογία του ταξινομητή. "
    more = docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn(
        "text", F.lit(strange * 4)).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), FOLDER).collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert got == clean


def test_pipeline_equals_its_steps_in_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        "doc_id", "text", "source").collect()]
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    for i, text, _ in sorted(kept):
        first.setdefault(text, i)
    kept = [r for r in kept if first[r[1]] == r[0]]
    labels, _ = near_components([r[:2] for r in kept], 5, 80)
    kept = [r for r in kept if labels[r[0]] == r[0]]
    taken = mix(kept)
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    sizes = {i: len(words(t)) for i, t, _ in kept}
    total = {}
    for i, n in zip(got["doc_id"], got["size"]):
        total[i] = total.get(i, 0) + n
    assert {i: n for i, n in total.items() if n} == {i: n for i, (_, n) in taken.items() if n}
    got = got.sort_values(["size", "doc_id", "copy", "piece", "cluster"],
                          ascending=[False, True, True, True, True], kind="stable")
    assert got["bin"].tolist() == best_fit(list(zip(got["size"], got["source"], got["cluster"])), corpus_pipeline.CAPACITY)
    assert all(n <= 2 * sizes[i] for i, n in total.items())


def test_pipeline_keeps_columns_and_odd_rows(spark, tmp_path):
    """Nulls in any column, clashing names, repeated rows and an empty table pass every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, hash int"
    rows = [(1, "the cat sat on the mat", "en", "s", 5, "r", 1), (2, None, None, None, None, None, None),
            (None, "the dog", None, None, None, None, None), (4, "...", "en", "s", 1, "r", 1),
            (5, "the cat sat on the mat", "en", None, 5, "r", 1), (6, "", "en", "s", 0, "r", 1),
            (7, "a hat", "en", "t", 0, "r", 1), (7, "a hat", "en", "t", 0, "r", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            if n < 4:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{len(data)}-{n}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        names = [(r.doc_id, r.source) for r in docs.collect()]
        assert (None, None) in names and len({i for i, _ in names}) >= 3 if data else names == []
