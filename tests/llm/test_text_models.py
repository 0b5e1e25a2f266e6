"""Language, license and language-model operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillcask.llm import langid, licenses, mixlm

FOLDER = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def test_language_of_held_out_texts(spark, docs):
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.filter(~held))
    got = langid.predict(docs.select("text", "lang", held.alias("held")), model).filter("held").collect()
    assert len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "s") for i in range(8)]
    rows += [(10 + i, "der hund und die katze " * 3, "de", "s") for i in range(8)]
    rows += [(30, None, "en", "s"), (31, "the words", None, "s"), (None, "x", "fr", "s")]
    model = langid.learn(spark.createDataFrame(rows, TEXTS))
    assert model[0] == ["de", "en"]
    asked = [(1, None), (2, ""), (3, "12 ... 45"), (4, "the dog and the cat"), (5, "und die katze"),
             (6, "the and " * 100_000), (None, "der hund")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(
        spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6, None)] == ["en", "de", "en", "de"]
    empty = langid.learn(spark.createDataFrame([], TEXTS))
    assert {r.lang_pred for r in langid.predict(
        spark.createDataFrame(asked, "doc_id long, text string"), empty).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    rows = [(i, "the cat", "en" if i % 3 else "de", "s") for i in range(300)] + [(7, "x", "en", "s")] * 300
    assert langid.sample(spark.createDataFrame(rows, TEXTS), "doc_id", "text", "lang", 20).count() <= 20


def test_folded_weights_equal_the_kernel_sum():
    """Scoring with one weight per n-gram is the kernel expansion over the landmarks."""
    rng = np.random.default_rng(0)
    rows = (rng.random((40, langid.SLOTS)) < 0.01).astype(np.float32)
    names, weights = langid.fit(rows, ["a"] * 20 + ["b"] * 20)
    unit = rows / np.sqrt(rows.sum(1, keepdims=True))
    values = unit @ weights
    assert names == ["a", "b"] and (values.argmax(1) == np.repeat([0, 1], 20)).all()
    sets = [set(np.flatnonzero(line)) for line in rows]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    left = kernel.T @ kernel + langid.RIDGE * kernel
    left += 1e-6 * np.eye(40) * max(1.0, np.trace(left) / 40)
    goal = np.array([[1.0, -1.0]] * 20 + [[-1.0, 1.0]] * 20)
    expansion = kernel @ np.linalg.solve(left, kernel.T @ goal)
    assert np.abs(values - expansion).max() < 1e-3


def test_foreign_texts_are_told_from_learned_languages(spark):
    """Long texts of other alphabets are foreign; learned languages and short texts are not."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    got = langid.predict(docs, model)
    assert got.filter("foreign").count() == 0
    russian = "Это проверочный текст на русском языке, он написан чтобы посмотреть на оценку. " * 3
    code = "7f3a 99c0 b1de 04aa e5f6 " * 2 + "".join(f"{i * 7919:x} " for i in range(1, 200))
    rows = [(1, russian), (2, code), (3, "Это"), (4, None), (5, "")]
    told = {r.doc_id: r.foreign for r in langid.predict(
        spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert told == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_licenses(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, f"{filler}\nReleased under the MIT License.\n{filler}"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "Licensed under the Apache License, Version 1.1."),
        (4, "LICENSED UNDER CC BY-NC 4.0"), (5, "Licensed under CC BY 4.0."),
        (6, "his driver license was released"), (7, None), (8, ""),
        (9, f"All rights reserved. {filler} This work is licensed under the GNU General Public License, version 3."),
        (10, "Permission is hereby granted, free of charge, to any persons obtaining a copy of this software "
             "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
             "sublicense, and/or sell copies of the Software"),
        (11, "No rights reserved."),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: ["CC-BY-NC-4.0"], 5: ["CC-BY-4.0"], 6: [], 7: [], 8: [],
            9: ["All-Rights-Reserved", "GPL-3.0"], 10: ["MIT"], 11: []}
    assert {i: r.licenses for i, r in got.items()} == want
    notice = got[1].notices[0]
    assert rows[0][1][notice.start : notice.end] == "Released under the MIT License"
    assert got[10].notices[0].edits == 1 and got[7].n_blocks == 0


def test_every_license_template_is_found_verbatim():
    """In short, repetitive and crowded texts too, where a template saves few bytes."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    crowd = " ".join(text for _, text in licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        for given in (text, f"{text} " * 3, f"{crowd} {text}", f"the words of it the words {text}"):
            found = scanner.scan(given)[1]
            ends = {given[m["start"] : m["end"]] for m in found if m["license"] == name and not m["edits"]}
            assert any(text.startswith(e) and len(e) > len(text) - 2 for e in ends), (given, found)
    assert sorted({m["license"] for m in scanner.scan(crowd)[1]}) == sorted({n for n, _ in licenses.TEMPLATES})


def test_one_word_in_ten_of_a_notice_may_differ(spark):
    """Wherever the words are, first and cue words included, and however long the template is."""
    rng = random.Random(3)
    own = " ".join(f"clause{i}" if i % 9 else "of the" for i in range(300))
    templates = [*licenses.TEMPLATES, ("Own", own), ("Ünique", "ünïque wörds")]
    filler = " ".join(f"word{i}" for i in range(90))
    mit = licenses.TEMPLATES[3][1]
    rows = [(0, "MIT", mit.replace("sublicense, ", "")), (1, "MIT", mit.replace("Permission", "Permissions")),
            (2, "Own", own), (3, "Ünique", "ÜNÏQUE WÖRDS")]
    for name, text in templates * 3:
        parts = text.split()
        known = [licenses.word_list(w) for w in parts]
        loose = [i for i, w in enumerate(known) if len(w) == 1 and not licenses._fixed(w[0][0])]
        for i in rng.sample(loose, len(licenses.word_list(text)) // 10):
            parts[i] = rng.choice(["", "other", f"{parts[i]} more"])
        rows.append((len(rows), name, " ".join(parts)))
    df = spark.createDataFrame([(i, f"{filler} {t} {filler}") for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(df, templates=templates).collect()}
    assert [(i, name) for i, name, _ in rows if name not in got[i]] == []
    text = mit.replace("Permission is", "Permissions was").replace("free of charge", "at charge")
    found = licenses.Scanner(templates).scan(text.replace("Software", "Work"))[1]
    assert found == []  # more words differ than may


def plain_base(rows):
    """Counts over learned texts and the log10 probability of each text, word by word."""
    parts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    counts = Counter(w for i, ws in parts for w in ws if zlib.crc32(str(i).encode()) % 7 != 2)
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(ws), sum(counts[w] > 0 for w in ws),
                   sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in parts}


def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in mixlm.score_texts(df, langid.held_out(F.col("doc_id"), 7, 2)).collect()}


def test_language_model_base_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, "the the THE"), (10_005, "é" * 4000)]
    got = scored(spark, rows)
    n, want = plain_base(rows)
    for i, (tokens, known, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 and r.bits > 0 and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert got[10_001].bits == got[10_002].bits == got[10_003].bits


def test_language_model_learns_order_of_letters(spark):
    """Held-out words made of known syllables cost less than words of random letters."""
    rng = random.Random(1)
    syllables = ["ba", "ko", "ti", "ren", "mu", "sal"]
    made = ["".join(rng.choice(syllables) for _ in range(4)) for _ in range(3000)]
    rows = [(i, " ".join(made[i * 30 : i * 30 + 30])) for i in range(100)]
    held = [i for i in range(200, 400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows += [(held[0], "kobatiren salmutiba"), (held[1], "qxzvwjfgh pyqdxcvbn")]
    got = scored(spark, rows)
    assert got[held[0]].bits < 0.5 * got[held[1]].bits


def test_language_model_is_a_distribution():
    """Given a prefix, the costs of all next bytes add up to probability one."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 50, (mixlm.OFFSETS[-1], 2)).astype(np.uint16)
    cells = rng.integers(0, 9, (256 * mixlm.BINS, 2)).astype(float)
    model = mixlm.ContextMixer(table, refined=mixlm.refinement(cells))
    flat = np.concatenate([np.frombuffer(b"A " + bytes((b,)), np.uint8) for b in range(256)])
    slots, bits, node, place, owner = mixlm.events(flat, np.full(256, 3))
    _, _, p, cell = model._mix(slots, bits, node, place)
    p = (p + model.refined[cell]) / 2
    cost = np.bincount(owner, -np.log2(np.where(bits == 1, p, 1 - p)))
    assert abs((2.0 ** -cost).sum() - 1) < 1e-6


def test_whole_word_predictors_learn_every_count():
    """A word seen twice in each of eight topics counts 16 times without the topic, twice with it:
    short contexts in the shared tables, longer ones in the group's own."""
    keys = [bytes((65 + t,)) + b"zebra" for t in range(8)]
    rows = pd.DataFrame({"words": [mixlm._pressed(keys)], "counts": [mixlm._thin(np.full(8, 2))]})
    table = np.zeros(mixlm.OFFSETS[-1] * 2, np.int64)
    for piece in mixlm._fill(iter([rows])):
        some = mixlm._wide(piece["counts"][0], np.int64)
        table[piece["piece"][0] :][: len(some)] = some
    (numbers, depths), = mixlm.grouped(keys)
    assert numbers.tolist() == list(range(8)) and set(depths) == {mixlm.DEPTH}
    slots, bits, _, place, _ = mixlm.events(*mixlm.laid_out(keys), depths)
    own = mixlm.own_counts(slots, bits, np.full(len(bits), 2)).reshape(-1)
    table = np.r_[table, own]
    for (size, by_topic), at in zip(mixlm.CONTEXTS, slots):
        if size is None:
            assert ((at >= mixlm.OFFSETS[-1]) == (place - 2 >= mixlm.DEPTH)).all()
            assert set(table[at * 2 + bits]) == {2 if by_topic else 16}


def test_contexts_of_a_group_occur_in_no_other():
    """Words that begin alike, more of them than a group holds, are cut at greater depths."""
    rng = random.Random(5)
    words = {"http" + "".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(900)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {""}
    keys = sorted((b"A" + w.encode() for w in words), key=zlib.crc32)
    groups = list(mixlm.grouped(keys, 64))
    assert sorted(i for numbers, _ in groups for i in numbers) == list(range(len(keys)))
    seen: dict = {}
    for g, (numbers, depths) in enumerate(groups):
        assert len(numbers) <= 64 and (np.diff(numbers) > 0).all()
        for i, depth in zip(numbers, depths):
            for n in range(depth, len(keys[i])):
                assert seen.setdefault(keys[i][1 : n + 1], g) == g


def test_language_model_beats_single_words(spark):
    """Held-out texts cost less than under the base, those without unknown words too, and so do
    learned ones."""
    from rillcask.llm import queries

    rows = queries.QUERIES["op7_context_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    held = rows["held_out"]
    for some in (held, held & (rows["n_known"] == rows["n_tokens"]), ~held):
        assert rows.loc[some, "score"].sum() > rows.loc[some, "base_score"].sum()


def test_topics_are_fitted_on_all_learned_texts(spark, monkeypatch):
    """A word that only texts outside the start have gets its share of all words."""
    monkeypatch.setattr(mixlm, "TOPIC_TEXTS", 20)
    ids = spark.range(200).select("id", F.lit(False).alias("held_out"))
    first = {r.id for r in ids.orderBy(F.xxhash64("id", F.lit("topics"))).limit(20).collect()}
    rows = [(i, f"{'river' if i % 2 else 'stone'} " * 9 + ("moon" if i in first else "zebra"), False) for i in range(200)]
    rows += [(900, "yak " * 5000, True), (901, None, False), (902, "", False)]
    model = mixlm.topic_model(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    share = np.exp(model[mixlm.topic_slot(b"zebra")] + model[-1]).sum()
    assert 0.03 < share < 0.1 and abs(np.exp(model[-1]).sum() - 1) < 1e-5
    assert np.exp(model[mixlm.topic_slot(b"yak")]).max() < 1e-3


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mixlm.score_texts(df, F.lit(False)).collect() == []
    held = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = mixlm.score_texts(held, F.lit(True)).collect()
    assert len(got) == 2 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_fit_asks_for_few_rows_at_a_time():
    """The driver never holds more than the landmarks' rows unpacked, and fits as on the whole."""
    rng = np.random.default_rng(5)
    rows, langs, asked = (rng.random((700, langid.SLOTS)) < 0.01).astype(np.uint8), ["a", "b"] * 350, []
    bits = np.packbits(rows, axis=1)
    names, weights = langid.fit_parts(
        lambda at, to: asked.append(to - at) or np.unpackbits(bits[at:to], axis=1), len(bits), langs
    )
    whole = langid.fit(rows, langs)
    assert names == whole[0] and np.array_equal(weights, whole[1])
    assert max(asked) == langid.LANDMARKS


def test_slots_of_many_words_are_those_of_each():
    some = [b"", b"zebra", "größe".encode(), b"yak", b"zebra"]
    assert mixlm.topic_slots(some).tolist() == [mixlm.topic_slot(w) for w in some]
    assert mixlm.topic_slots([]).tolist() == []


def test_texts_are_cut_into_words_once_for_all_rounds():
    """The rounds of the topics read slots, not texts."""
    texts = ["river " * 3 + "Moon", "stone", "", " \t"]
    blobs = next(mixlm._slots(iter([pd.DataFrame({"text": texts})])))["slots"]
    for text, blob in zip(texts, blobs):
        want = [mixlm.topic_slot(w) for w in text.lower().encode().split()]
        assert np.frombuffer(blob, np.uint16).tolist() == want
    assert mixlm.TOPIC_SLOTS <= 1 << 16


def test_counts_are_scaled_as_pairs():
    top = mixlm.TOP
    total = np.array([0, 0, 1, 7, top, 3, 3 * top, 1, 2, 2 * top + 1, top + 1, top + 1])
    got = mixlm._fitting(total)
    assert got.dtype == np.uint16 and got[:3].tolist() == [[0, 0], [1, 7], [top, 3]]
    assert got[3].tolist() == [top, 1] and got[5].tolist() == [top, top]
    assert got[4].tolist() == [1, top]
