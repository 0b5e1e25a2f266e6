"""Search, packing and token rows against brute force and round trips."""

import itertools
import os
import random

import numpy as np
import pytest

from rillcask.llm import packing, tokens, topk

from .helpers import best_fit, words

VECTORS = "vec_id long, embedding array<float>, score int, ints string"


def brute_top(rows, asked, k, scale):
    ints = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append([int(np.floor(np.float64(np.float32(x)) * scale)) for x in v])
    out = []
    for q in sorted(asked & set(ints)):
        query = min(ints[q])
        scores = sorted(
            (-sum(a * b for a, b in itertools.zip_longest(query, v, fillvalue=0)), i)
            for i, vs in ints.items() if i != q for v in vs)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("shard, block", [(2048, 1024), (7, 3)])
def test_top_k_equals_all_products(spark, shard, block):
    """Ties, nulls, not-a-number, short and empty vectors, repeated rows; one shard or many."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(20)], 1, "x") for i in range(60)]
    rows += [(60, None, 1, "x"), (61, [0.5, None], 1, "x"), (62, [float("nan")] * 20, 1, "x"),
             (63, [float("inf")] * 20, 1, "x"), (64, [1.0], 1, "x"), (65, [], 1, "x"), (5, rows[5][1], 1, "x"),
             (None, [1.0] * 20, 1, "x"), (66, [1e30] + [0.0] * 19, 1, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk.top_k(df, df.filter("vec_id % 5 = 0"), k=10, shard_rows=shard, block_queries=block)
    want = [(q, n, i, min(max(s, -2**63), 2**63 - 1)) for q, n, i, s in brute_top(
        rows, {i for i in range(0, 70, 5)}, 10, 1024)]
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 1, "x")], VECTORS)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []
    assert topk.top_k(df.filter("vec_id = 0"), df.filter("vec_id = 0")).collect() == []
    assert [tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0"), scale=1).collect()] == [(0, 1, 1, 2)]


def test_maxscore_keeps_ties_to_the_smaller_id():
    docs = np.array([[1.0, 1.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]])
    rows, scores = topk.maxscore(np.array([3, 5, 7, 9]), docs, np.array([1.0, 1.0]), 5, 2)
    assert rows.tolist() == [0, 2] and scores.tolist() == [1.0, 1.0]


DOCS = "doc_id long, text string, source string, bin int, count string"


def documents(seed, n):
    rng = random.Random(seed)
    sources = ["big", "big", "a", "b", "c", None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 9, 20, 33]) + [str(rng.randrange(40))]),
             rng.choice(sources), 0, "y") for i in range(n)]
    return [*rows, (n, None, None, 0, "y"), (n + 1, "", "big", 0, "y"), rows[0], rows[0]]


def test_packing_equals_searching_all_bins(spark):
    rows = documents(1, 300)
    placed = packing.pack(spark.createDataFrame(rows, DOCS), 25).toPandas()
    placed = placed.sort_values(
        ["size", "doc_id", "copy", "piece", "cluster"], ascending=[False, True, True, True, True], kind="stable")
    sources = [s if isinstance(s, str) else None for s in placed["source"]]
    items = list(zip(placed["size"], sources, placed["cluster"]))
    assert placed["bin"].tolist() == best_fit(items, 25)


@pytest.mark.parametrize("shard", [4096, 50])
def test_packing_loses_nothing_and_keeps_conflicts_apart(spark, shard):
    rows = documents(2, 400)
    placed = packing.pack(spark.createDataFrame(rows, DOCS), 25, shard_items=shard).toPandas()
    sizes = {i: len(words(t)) for i, t, *_ in rows}
    copies = {}
    for i, *_ in rows:
        copies[i] = copies.get(i, 0) + 1
    for (i, copy), part in placed.groupby(["doc_id", "copy"]):
        part = part.sort_values("piece")
        assert part["size"].sum() == sizes[i] and part["start"].tolist() == [25 * n for n in range(len(part))]
    assert {i: part["copy"].nunique() for i, part in placed.groupby("doc_id")} == copies
    for _, part in placed.groupby("bin"):
        assert part["size"].sum() <= 25
        assert part["source"].dropna().is_unique and part["cluster"].is_unique


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), 25).collect() == []


def test_tightest_bin_equals_a_search_of_all_bins():
    rng = random.Random(7)
    for capacity in (1, 5, 16, 100):
        sizes = [rng.randint(1, capacity) for _ in range(300)]
        bins = tokens.best_fit_decreasing(sizes, capacity)
        room = []
        for size in sorted(sizes, reverse=True):
            fit = [left for left in room if left >= size]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - size)
            else:
                room.append(capacity - size)
        assert sorted(capacity - sum(sizes[i] for i in b) for b in bins) == sorted(room)
        assert sorted(i for b in bins for i in b) == list(range(300))


@pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="vocabulary absent")
@pytest.mark.parametrize("shard", [1 << 22, 200])
def test_token_rows_hold_every_text(spark, shard):
    """Joined by start, the segments of a document decode to its text."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "größe", "été\n", "12.5", "日本", "  x"]) for _ in range(rng.randrange(120))))
            for i in range(40)]
    rows += [(40, None), (41, ""), (42, "a" * 5000)]
    out = tokens.packed_tokens(spark.createDataFrame(rows, "doc_id long, text string"), 64, shard_tokens=shard)
    ranks = tokens.read_ranks(tokens.RANKS)
    back = {v: k for k, v in ranks.items()}
    parts = {}
    for row in out.collect():
        ids = np.frombuffer(row.ids, "<u2")
        assert len(ids) == 64 and row.cu_seqlens[-1] == row.n_tokens <= 64
        assert row.resets == row.cu_seqlens[:-1] and (ids[row.n_tokens :] == len(ranks)).all()
        for at, to, s in zip(row.cu_seqlens, row.cu_seqlens[1:], row.segments):
            assert to - at == s.length
            parts.setdefault(s.doc_id, {})[s.start] = ids[at:to].tolist()
    for i, text in rows:
        ids = [t for _, part in sorted(parts[i].items()) for t in part]
        assert ids[-1] == len(ranks)
        assert b"".join(back[t] for t in ids[:-1]).decode() == (text or "")
    assert tokens.packed_tokens(spark.createDataFrame([], "doc_id long, text string"), 64).collect() == []
