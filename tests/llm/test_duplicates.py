"""Exact and near duplicates against comparisons of every pair."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillcask.llm import exact, graph, near
from rillcask.llm.common import stored, stored_sum

from .helpers import near_components, shingles

SCHEMA = "doc_id long, text string"


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("keep, pick", [("largest", max), ("smallest", min)])
def test_exact_groups(spark, keep, pick):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "A"), (8, "x" * 300_000),
            (9, "x" * 300_000)]
    got = by_id(exact.exact_groups(spark.createDataFrame(rows, SCHEMA), keep=keep))
    groups = [{1, 3}, {2}, {4, 5}, {6}, {7}, {8, 9}]
    for group in groups:
        for i in group:
            text = dict(rows)[i] or ""
            assert got[i] == {
                "doc_id": i, "keep_id": pick(group), "group_size": len(group),
                "kept": i == pick(group), "text_sha256": hashlib.sha256(text.encode()).hexdigest(),
            }


def test_exact_groups_tell_apart_texts_with_one_hash(spark):
    """With a hash that is the same for all texts, bytes alone make the groups."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], SCHEMA)
    got = by_id(exact.exact_groups(docs, hash_of=lambda text: F.unhex(F.md5(F.lit("one")))))
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == {
        1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (4, 1), 5: (2, 2)}


def test_exact_groups_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "z")], SCHEMA)
    got = sorted(((r.doc_id, r.keep_id, r.kept, r.group_size)
                  for r in exact.exact_groups(docs).collect()), key=str)
    assert got == sorted([(None, 2, False, 3), (2, 2, True, 3), (2, 2, True, 3),
                          (None, None, True, 1)], key=str)


def test_drop_exact_keeps_all_columns_and_one_row_each(spark):
    docs = spark.createDataFrame(
        [(1, "a", 7, "p"), (2, "a", 8, "q"), (3, None, 9, "r"), (3, None, 9, "r")],
        "doc_id long, text string, hash int, keep_id string")
    got = exact.drop_exact(docs)
    assert got.columns == docs.columns
    assert sorted(got.collect()) == [(1, "a", 7, "p"), (3, None, 9, "r")]
    assert exact.drop_exact(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "", 1, "x"), (4, None, 2, "y"), (None, "b", 3, "z")], docs.schema)
    for keep in ("smallest", "largest"):
        assert sorted(exact.drop_exact(odd, keep=keep).collect(), key=str) == sorted(
            [(4, None, 2, "y"), (None, "b", 3, "z")], key=str)


def words_of(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def edited(rng, parts, edits):
    parts = list(parts)
    for _ in range(edits):
        at = rng.randrange(len(parts))
        what = rng.randrange(3)
        if what == 0:
            parts[at] = f"e{rng.randrange(10**6)}"
        elif what == 1 and len(parts) > 1:
            del parts[at]
        else:
            parts.insert(at, parts[at])
    return parts


def corpus(seed):
    """Near copies of a few texts with graded edits, copies, short, blank and null texts."""
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        base = words_of(rng, rng.choice([8, 30, 120]))
        for _ in range(25):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 8)))))
    rows += [" ".join(words_of(rng, 40)) for _ in range(20)]
    rows += ["one", "ONE", "one two", "one  two\t", "", " \n", None, None, rows[0].upper(), rows[3]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent, seed", [(3, 85, 1), (3, 85, 2), (5, 80, 3), (2, 50, 4)])
def test_near_groups_equal_comparing_every_pair(spark, width, percent, seed):
    rows = corpus(seed)
    bands = {"bands": 126, "rows": 2} if percent == 50 else {}
    got = by_id(near.near_groups(
        spark.createDataFrame(rows, SCHEMA), width=width, percent=percent, **bands))
    labels, sizes = near_components(rows, width, percent)
    assert {i: r["component_id"] for i, r in got.items()} == labels
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_groups_with_null_and_repeated_ids(spark):
    """Rows of one id are one document; a row without id follows its copies."""
    text, other = "a b c d e f g", "q r s t u v w"
    docs = spark.createDataFrame(
        [(5, text), (5, other), (7, other), (None, text), (None, "x y z a"), (9, None)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, 5, False),
                          (None, None, True), (9, 9, True)], key=str)


def test_near_groups_link_rows_without_id(spark):
    """Near copies without an id follow the smallest id of their group; a group without any id
    has none, and one of its rows stays."""
    rng = random.Random(8)
    texts = [" ".join(words_of(rng, 60)) for _ in range(2)]
    near_copy = [t + " end" for t in texts]
    docs = spark.createDataFrame(
        [(7, texts[0]), (None, near_copy[0]), (9, near_copy[0] + " more"),
         (None, texts[1]), (None, near_copy[1]), (None, near_copy[1])], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_groups(docs).collect()), key=str)
    assert got == sorted([(7, 7, True), (None, 7, False), (9, 7, False)] + [(None, None, True)] * 3, key=str)
    left = near.drop_near(docs).collect()
    assert len(left) == 2 and {r.doc_id for r in left} == {7, None}


def spokes_of(spark, hub, texts):
    rows = [(0, i, True, hub, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(
        rows, "hub long, node long, low boolean, hub_text string, text string").coalesce(1).mapInPandas(
        near._compare(3, 85), near.COMPARED).drop("low").withColumn("label", F.col("node"))


def test_shared_rarities_find_every_link_around_a_hub(spark):
    """Families around one hub, from near to far: no linked pair that the hub leaves open is missed."""
    rng = random.Random(11)
    base = words_of(rng, 70)
    texts = []
    for edits in (1, 4, 7, 12):
        centre = edited(rng, base, edits)
        texts += [" ".join(edited(rng, centre, rng.randrange(4))) for _ in range(12)]
    spokes = spokes_of(spark, " ".join(base), texts)
    linked = {r.node for r in spokes.filter("linked").collect()}
    rare = near._shared_rarities(spokes, 85)
    none = spark.createDataFrame([], "node long, label long")
    got = {tuple(sorted((r.x, r.y))) for r in near._pairs(rare, none, 85, star=False).collect()}
    sets = [shingles(t, 3) for t in texts]
    want = set()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if {i + 1, j + 1} - linked and sets[i] != sets[j] and 100 * both >= 85 * (
                    len(sets[i]) + len(sets[j]) - both):
                want.add((j + 1, i + 1))
    assert want and linked and want <= got


def test_a_family_of_similar_pages_makes_no_pairs(spark):
    """Pages of one template with words of their own, at a similarity of 0.74: no candidates."""
    texts = [" ".join([f"t{k}" for k in range(100)] + [f"o{i}x{k}" for k in range(17)]) for i in range(300)]
    rare = near._shared_rarities(spokes_of(spark, texts[0], texts[1:]), 85)
    assert rare.isEmpty()


def test_bands_follow_the_threshold():
    assert near.banding(85) == (42, 6) and near.banding(80) == (66, 6)
    for percent in (30, 50, 70, 80, 85, 90, 99):
        bands, rows = near.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near.MISSED
    assert near.banding(100) == (1, 6)


def test_drop_near_keeps_columns_and_clean_documents(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 1, "k"), (2, "a b c d e f", 2, "l"), (3, "p q r s t u", 3, "m"), (4, None, 4, "n")],
        "doc_id long, text string, label int, node string")
    got = near.drop_near(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    more = docs.union(spark.createDataFrame(
        [(None, "a b c d e f", 5, "o"), (None, "u n n a m e d", 6, "p"), (None, "u n n a m e d", 6, "p"),
         (None, None, 7, "q"), (None, None, 7, "q")], docs.schema))
    assert sorted(r.label for r in near.drop_near(more).collect()) == [1, 3, 4, 6, 7]
    assert near.drop_near(docs.limit(0)).collect() == []


def test_differences_to_a_hub_decide_links():
    """The counts from the differences are those of the whole sets, and folds never refute a link."""
    rng = random.Random(5)
    base = words_of(rng, 60)
    hub = near.shingle_hashes([w.encode() for w in base], 3)
    for _ in range(200):
        x, y = ({g for g in near.shingle_hashes([w.encode() for w in edited(rng, base, 4)], 3).tolist()}
                for _ in range(2))
        h = set(hub.tolist())
        shared = len(h) - len(h - x) - len(h - y) + len((h - x) & (h - y)) + len((x - h) & (y - h))
        assert shared == len(x & y)
        folds = [near._fold(np.array(sorted(s - h), np.uint64)) for s in (x, y)]
        both = sum(bin(a & b & (1 << 64) - 1).count("1") for a, b in zip(folds[0][0], folds[1][0]))
        assert both + min(folds[0][1], folds[1][1]) >= len((x - h) & (y - h))


def test_signatures_agree_as_often_as_the_sets():
    """Densified signatures estimate the similarity of small sets without bias."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(150):
        pool = np.unique(rng.integers(0, 2**63, 14).astype(np.uint64))
        a, b = pool[:12], pool[2:]
        keys = near.signatures([np.sort(near.mixed(a)), np.sort(near.mixed(b))], 252, 1)
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - 10 / 14) < 0.04


def test_components(spark):
    """A path, a star, a pair and a ring."""
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2)]
    edges += [(300, 301), (301, 302), (302, 300)]
    got = {r.node: r.label for r in graph.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260))
    assert got[2] == 1 and {got[i] for i in (300, 301, 302)} == {300}


def test_shingles_of_helper():
    assert shingles("A b\x0bc d", 3) == {("a", "b", "c d")}


def test_possible_ids_fill_one_bitmap_of_512_rows(spark, monkeypatch):
    """No id of the table is missed, few others are hit, and the driver gets a row per 4 KB."""
    ids = spark.range(0, 20_000, 2).withColumnRenamed("id", "node")
    got = []
    frame = type(ids)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    hit = near._possible(ids)
    assert len(got) == 1 and len(got[0]) <= near.FILTER_BITS // near.BUCKET_BITS
    hits = {r.node for r in spark.range(20_000).withColumnRenamed("id", "node").filter(hit(F.col("node"))).toLocalIterator()}
    assert hits >= set(range(0, 20_000, 2)) and len(hits) < 10_100


def test_components_of_stars_take_one_round(spark, monkeypatch):
    """What is final at the start is seen to be final after one round, without a job for its sum."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, label: made.append(label) or stored(df, label))
    monkeypatch.setattr(graph, "stored_sum", lambda df, label, c: made.append(label) or stored_sum(df, label, c))
    edges = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21)], "a long, b long")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 9)}, 20: 20, 21: 20}
    assert made == ["edges", "labels", "labels", "labels"]
    assert graph.components(edges.limit(0)).collect() == []


def files_left(folder):
    """Names of the tables that still hold files below a folder."""
    return {p.parent.name for p in folder.rglob("part-*.parquet")}


def test_near_copies_leave_only_what_their_result_reads(spark, monkeypatch, tmp_path):
    """Signatures, candidate texts and differences go before the documents themselves are read."""
    made = []

    def folder(_, label):
        made.append(tmp_path / f"{label}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr("rillcask.llm.common.new_folder", folder)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), "k l m n o p q", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    left = near.drop_near(docs)
    tables = files_left(tmp_path)
    assert {"members", "gone"} <= tables
    assert all(name in ("members", "gone") or name.startswith(("labels", "edges")) for name in tables)
    assert sorted(r.doc_id for r in left.collect()) == [0, 3, 4]


@pytest.mark.parametrize("hit", [None, True])
def test_drop_near_shuffles_only_what_the_filter_names(spark, monkeypatch, hit):
    """The rows that stay are one branch of the plan without any shuffle; a filter that names every
    row changes nothing."""
    if hit is not None:
        monkeypatch.setattr(near, "_possible", lambda ids: lambda column: column.isNotNull())
    docs = spark.createDataFrame(
        [(i, f"w{i} x{i} y{i} z{i} q{i} r{i}") for i in range(40)]
        + [(100 + i, f"w{i} x{i} y{i} z{i} q{i} r{i}") for i in range(5)]
        + [(7, "another text of an id that is there twice"), (None, None), (None, "n o n a m e")], SCHEMA)
    want = {r.doc_id for r in near.near_groups(docs).filter("kept").collect()}
    left = near.drop_near(docs)
    got = [r.doc_id for r in left.collect()]
    assert set(got) == want and got.count(7) == 2 and got.count(None) == 2 and len(got) == 43
    if hit is None:
        branches = left._jdf.queryExecution().sparkPlan().children()
        plans = [branches.apply(i).toString() for i in range(branches.size())]
        assert sum("Join" not in plan for plan in plans) == 1
