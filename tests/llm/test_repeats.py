"""Repeated passages against a plain search over all strings."""

import random

import numpy as np
import pytest

from rillcask.llm import repeats
from rillcask.llm.repeats import find_repeats

SCHEMA = "doc_id long, text string, n_bytes string, h string, bytes int"


def plain(docs, length):
    """[(id, spans, kept)] by looking every string up; rows of one id in any order agree here."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - length + 1):
            part = raw[at : at + length]
            if part in seen:
                gone[at : at + length] = [True] * length
            seen.add(part)
        spans, at = [], 0
        while at < len(raw):
            if gone[at]:
                end = at
                while end < len(raw) and gone[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((doc_id, len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def mine(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA)
    found = find_repeats(df, **options)
    assert found.columns == ["doc_id", "n_bytes", "spans", "kept"]
    return sorted(
        ((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in found.collect()), key=repr
    )


def sample(seed):
    """Texts that share passages of all lengths, copies, runs of one letter, some with wide letters."""
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcdé ", k=rnd.randint(10, 90))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            parts.append("".join(rnd.choices("abcdeé ", k=rnd.randint(0, 40))))
            if rnd.random() < 0.7:
                p = rnd.choice(passages)
                cut = rnd.randint(0, 10)
                parts.append(p[cut : len(p) - rnd.randint(0, 5)])
        docs.append((i * 3, "".join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(8)]
    docs += [(5, "a" * 300), (7, "a" * 120 + "b" + "a" * 150), (8, "ab" * 90), (9, None), (10, "")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_looking_every_string_up(spark, seed):
    docs = sample(seed)
    assert mine(spark, docs, length=20, gram=6) == plain(docs, 20)


def test_default_length_and_ids_beyond_doubles(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choices("abcdefgh ", k=400))
    docs = [(2**60 + i, "".join(rnd.choices("abcdefgh ", k=50)) + passage[i : 300 + i]
             + "".join(rnd.choices("abcdefgh ", k=60))) for i in range(9)]
    docs += [(None, passage[:99]), (2**60 + 50, passage[:100])]
    assert mine(spark, docs) == plain(docs, 100)


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    """Pieces of a text cut its rows at other places than those of its copies."""
    rnd = random.Random(4)
    body = "".join(rnd.choices("abcdefghijklm ", k=3 * repeats.CHUNK // 2))
    docs = [(1, body), (2, "zz" + body[5000:] + "q"), (3, body[:700] + "x" + body[:700])]
    assert mine(spark, docs) == plain(docs, 100)


def test_null_ids_come_last_and_equal_rows_get_one_result(spark):
    text, other = "abcdefghij" * 12 + "xyz", "0123456789" * 15
    docs = [(None, text), (4, text), (4, text), (None, other), (None, other)]
    got = mine(spark, docs, length=100)
    first = [r for r in got if r[0] == 4]
    assert len(got) == 5 and len(first) == 2 and first[0] == first[1]
    # the text repeats itself, so its later bytes go even where it stays
    assert first[0][2] == [(10, 120)]
    assert [r[2] for r in got if r[0] is None and r[1] == len(text)] == [[(0, 123)]]
    later = [r for r in got if r[0] is None and r[1] == len(other)]
    assert later[0] == later[1] and later[0][2] == [(10, 150)]


def test_rows_of_one_id_follow_each_other(spark):
    """One of two texts under an id keeps a shared passage, the other one loses it."""
    shared = "".join(chr(97 + i * 7 % 26) for i in range(26)) + "0123456789" * 9
    docs = [(1, "first" + shared), (1, "second" + shared)]
    got = mine(spark, docs, length=100)
    lost = sorted(sum(b - a for a, b in r[2]) for r in got)
    assert lost == [0, len(shared)]


def test_empty_table(spark):
    assert mine(spark, []) == []


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x" * 40), ("a", "x" * 30)], "key string, body string")
    got = find_repeats(df, 20, "key", "body", 8)
    assert {r.key: [tuple(s) for s in r.spans] for r in got.collect()} == {
        "a": [(1, 30)], "b": [(0, 40)]
    }


def test_places_of_the_leftmost_smallest_value():
    """Ties go to the left, over any width; gram ids of every place are those of its bytes."""
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 69):
        v = rng.integers(0, 4, 300).astype(np.uint64) + np.uint64(2**32 - 4)
        want = [at + int(v[at : at + width].argmin()) for at in range(len(v) - width + 1)]
        assert repeats._lowest(v, width).tolist() == want
    hashes, data = repeats.Hashes(repeats._BASES[0], 64), rng.integers(0, 256, 500).astype(np.uint8)
    hashes.load(data)
    at = np.arange(len(data) - 32 + 1)
    assert hashes.every(32).tolist() == hashes.of(at, at + 32).tolist()
