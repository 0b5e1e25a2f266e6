"""Spelling variants against comparing every pair of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from rillcask.llm.spelling import spelling_variants, word_counts


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts, factor=2):
    near = {w: set() for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return sorted(
        (w, n, len(near[w]), form[w], counts[form[w]] if form[w] is not None else None, root(w))
        for w, n in counts.items()
    )


def plain_counts(docs, slip=97):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if slip:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % slip == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling_variants(df)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed,alphabet,size", [(1, "ab", 60), (2, "abcé", 250), (3, "abcdefgh×一\U0001f600", 300)])
def test_equals_comparing_every_pair(spark, seed, alphabet, size):
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(alphabet, k=rnd.randint(1, 7))) for _ in range(size)}
    for w in rnd.sample(sorted(words), size // 5):
        at = rnd.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rnd.choice(alphabet) + w[at:],
                  w[:at] + rnd.choice(alphabet) + w[at + 1 :]}
    words.discard("")
    counts = {w: int(2 ** rnd.uniform(0, 9)) for w in sorted(words)}
    assert variants(spark, counts) == plain_variants(counts)


def test_long_words_and_nested_prefixes(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcd", k=3000))
    words = [long, long[:1700] + long[1701:], long[:10] + "z" + long[11:], long + "a", long[1:]]
    words += ["a" * k for k in range(1, 40)]
    counts = {w: 1 + 3 * i for i, w in enumerate(dict.fromkeys(words))}
    assert variants(spark, counts) == plain_variants(counts)


def test_forms_chain_to_a_root_and_ties_take_the_smaller_word(spark):
    counts = {"nation": 100, "nations": 40, "natlons": 10, "natlonz": 5, "batch": 9, "catch": 18,
              "match": 18, "lonely": 3}
    got = {r[0]: r[1:] for r in variants(spark, counts)}
    assert got["natlonz"] == (5, 1, "natlons", 10, "nation")
    assert got["batch"] == (9, 2, "catch", 18, "catch")
    assert got["catch"] == (18, 2, None, None, "catch")
    assert got["lonely"] == (3, 0, None, None, "lonely")


def test_counts_take_whole_texts_and_planted_slips(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefÀéÿ", k=rnd.randint(3, 9))) for _ in range(60)]
    docs = [(2**60 + i, " ".join(rnd.choices(vocabulary, k=200)).replace("a", "A", i)) for i in range(30)]
    docs += [(None, "xx " + vocabulary[0] + "1" + vocabulary[1]), (None, None), (3, ""), (3, "Z" * 5000 + ",") ] * 3
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    for slip in (97, 5, None):
        got = {r.word: r.n for r in word_counts(df, slip=slip).collect()}
        assert got == plain_counts(docs, slip)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_counts(docs).collect() == []
    assert variants(spark, {}) == []


def test_documents_of_the_driver(spark):
    """The registered query on the smallest tables against comparing words by their deletions."""
    import os

    from rillcask.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables absent")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    counts = plain_counts([tuple(r) for r in rows])
    got = sorted(tuple(r) for r in QUERIES["op12_spelling_variants"](spark, folder).select(*COLUMNS).collect())
    assert [r[:2] for r in got] == sorted(counts.items())
    # the same neighbours by their patterns: a place that may hold any letter, or none
    patterns = {}
    for w in counts:
        for i in range(len(w)):
            patterns.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            near[w] |= patterns[(w[:i], w[i + 1 :])] - {w}
            gone = w[:i] + w[i + 1 :]
            if gone in counts:
                near[w].add(gone)
                near[gone].add(w)
    assert {r[0]: r[2] for r in got} == {w: len(o) for w, o in near.items()}
    best = {w: min(o, key=lambda x: (-counts[x], x), default=None) for w, o in near.items()}
    assert {r[0]: r[3] for r in got} == {
        w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()
    }
