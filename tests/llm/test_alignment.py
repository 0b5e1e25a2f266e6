"""Aligned tokens against the public tokenizers and pairing token by token."""

import hashlib
import json
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillcask.llm import alignment
from rillcask.llm.alignment import VOCABULARIES, align_tokens
from rillcask.llm.bytebpe import ByteBpe, ranks_of

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    byte_side = Tokenizer.from_file(VOCABULARIES[0])
    byte_side.encode_special_tokens = True
    return byte_side, sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[1])


def letters():
    """Bytes of the letters in a byte-level vocabulary, from its own words for single bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    out = {}
    for text in map(chr, [*range(0x800), *range(0x800, 0xD800, 256), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)]):
        raw = text.encode()
        for letter, byte in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0], raw):
            out[letter] = byte
    return out


def plain_groups(models, text, table):
    """[(a ids, b ids)] by walking both sides."""
    if not text:
        return []
    byte_side, piece_side = models
    a = byte_side.encode(f" {text}", add_special_tokens=False)
    b = piece_side.encode(text)
    a_bytes = [bytes(table.get(c, 0) for c in t) for t in a.tokens]
    b_bytes = [
        bytes([int(p[3:5], 16)]) if piece_side.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in zip(b, piece_side.id_to_piece(b))
    ]
    if b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
        return []

    def cuts(parts):
        total, out = 0, []
        for p in parts:
            total += len(p)
            out.append(total)
        return out

    a_cuts, b_cuts = cuts(a_bytes), cuts(b_bytes)
    groups, x, y = [], 0, 0
    for end in sorted(set(a_cuts) & set(b_cuts)):
        i, j = a_cuts.index(end) + 1, b_cuts.index(end) + 1
        groups.append((a.ids[x:i], b[y:j]))
        x, y = i, j
    return groups


def plain(models, docs):
    table = letters()
    grouped = [(i, plain_groups(models, t, table)) for i, t in docs]
    held = Counter()
    for _, groups in grouped:
        held.update({(a, b) for x, y in groups for a in x for b in y})
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for i, groups in grouped:
        links = [(a, b) for x, y in groups for a in x for b in y]
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(line.encode()).hexdigest() if line else "",
        ))
    pairs = sorted((a, b, n, n == top[a]) for (a, b), n in held.items())
    return sorted(out, key=repr), pairs


def mine(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, pair int, block string")
    found, pairs = align_tokens(df)
    return (
        sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=repr),
        sorted(tuple(r) for r in pairs.collect()),
    )


def sample():
    rnd = random.Random(1)
    words = ["the", "nation's", "Èonai", "ouêoi", "naïve", "12345", "été", "<|endoftext|>", "</s>", "<s>", "a-b",
             "x▁y", "日本語", "😀", "́e", "don't", "\t", "\n\n", "   ", "..."]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(60)]
    docs += [(2**60 + 1, "the the the"), (None, "the nation"), (None, None), (3, ""), (3, ""), (5, " "), (6, "▁"),
             (7, "x" * 5000), (8, "=" * 3001 + " " * 777 + "q"), (9, "the the the"), (10, "<0x41>")]
    return docs


@pytest.mark.parametrize("links,wide,block", [(2_000_000, 4096, 6 << 20), (50, 6, 700)])
def test_equals_pairing_token_by_token(spark, models, monkeypatch, links, wide, block):
    """The same rows whatever is aligned, joined or counted together."""
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = sample()
    got, want = mine(spark, docs), plain(models, docs)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_texts_without_tokens(spark, models):
    docs = [(1, None), (2, ""), (3, "a▁b")]
    got, pairs = mine(spark, docs)
    assert got == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    assert pairs == []
    assert mine(spark, []) == ([], [])


def test_long_runs_have_the_ids_of_the_file(models):
    own = ByteBpe(ranks_of(open(VOCABULARIES[0], encoding="utf-8").read()))
    for text in [" " * 30000, "a" + " " * 30001 + "b", "\n" * 25000 + " x", "x \t\n" + "　 " * 15000 + "\n'll",
                 " " * 20000, "\n" * 19999 + "y", "q" + "\r\n" * 20000 + "1"]:
        assert own.ids(text).tolist() == models[0].encode(text, add_special_tokens=False).ids


def test_runs_of_two_million_blanks(spark):
    """Both sides cut a run out of step; its tokens are counted, not paired one by one."""
    docs = [(1, "x" + " " * 2_000_000 + "y"), (2, "\n" * 300_000)]
    got, _ = mine(spark, docs)
    assert [r[0] for r in got] == [1, 2] and all(r[3] >= 1 and r[4] >= r[1] for r in got)


def test_merges_out_of_order_are_refused():
    file = json.loads(open(VOCABULARIES[0], encoding="utf-8").read())
    file["model"]["merges"] = file["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        ranks_of(json.dumps(file))


def test_documents_of_the_driver(spark, models):
    from rillcask.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables absent")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_alignment"](spark, folder).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(models, docs)[0]
