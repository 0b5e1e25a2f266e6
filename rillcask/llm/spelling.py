"""Spelling variants: words one edit apart, found on tries that are tables of edges.

A node of a trie is a prefix, named by a 64-bit hash of its letters and their places; an edge is
(parent, letter, child). A search state is (word, position, node, edits) and the frontier of all
states moves by joins with the edge table. A word's own path needs no search, so states begin at
the edit: either they skip a letter, or they take an edge with another one. From there on the
rest of the word must lie in the trie letter by letter; each level checks twice as many letters as
the one before, so the number of joins is the logarithm of the longest rest. The second half of a
word is edited in the trie of words, the first half in the trie of reversed words: at the depth of
half a word few letters follow a node, where at the root all do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS = "A-Za-zÀ-ÿ"
HELD = 300_000  # distinct words a task holds before it hands their counts on
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _counted(pattern: str, slip: int | None):
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({
            "word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(pattern).findall, Counter()
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                found = Counter(find(raw.to_pybytes().lower().decode()))
                if slip is None:
                    total.update(found)
                else:
                    before = zlib.crc32(f"{doc}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), before)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                if len(total) >= HELD:
                    yield rows(total)
                    total = Counter()
        if total:
            yield rows(total)

    return run


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
    min_count: int = 3, letters: str = LETTERS, slip: int | None = None,
) -> DataFrame:
    """word, n: maximal runs of ``letters`` (inside a character class) in whole texts, A-Z lowered.

    Words shorter than ``min_length`` code points or rarer than ``min_count`` are left out. With
    ``slip`` a run loses a letter in one document of ``slip``, always the same ones: where ``slip``
    divides the crc32 h of "<id>:<lowered run>", code point h % length goes before counting. That
    plants misspellings whose origin is known. Null ids count as "", null texts hold nothing.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")
    )
    counts = rows.mapInArrow(_counted(f"[{letters}]{{{max(min_length, 1)},}}", slip), "word string, n long")
    return counts.where(F.char_length("word") >= min_length).groupBy("word").agg(
        F.sum("n").alias("n")
    ).where(F.col("n") >= min_count)


class Spelled:
    """Prefix hashes of many words at once, forwards or backwards."""

    def __init__(self, words: list[str], backwards: bool) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(codes)) - self.base[self.word]
        if backwards:
            codes = codes[self.base[self.word] + self.sizes[self.word] - 1 - self.place]
        self.codes, self.backwards = codes, backwards
        self.own = self._sums(self.place)
        # as if one letter before had been left out
        self.shifted = self._sums(self.place - 1)

    def _sums(self, place: np.ndarray) -> np.ndarray:
        """Hashes of letters at their places, added up (xor) from the first word on."""
        x = (place.astype(np.uint64) << np.uint64(22)) + self.codes
        x = (x * np.uint64(2) + np.uint64(self.backwards)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return np.append(np.uint64(0), np.bitwise_xor.accumulate(x ^ (x >> np.uint64(31))))

    def prefix(self, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Node of the first ``size`` letters of a word."""
        at = self.base[word]
        return self.own[at + size] ^ self.own[at] ^ np.uint64(self.backwards)

    def edges(self) -> tuple[np.ndarray, ...]:
        """(parent, letter, child) of every letter."""
        return self.prefix(self.word, self.place), self.codes, self.prefix(self.word, self.place + 1)

    def edits(self, skip: bool) -> tuple:
        """States (word, node, child, letter) and the nodes to come, with list offsets.

        Nodes to come lie 1, 3, 7, ... letters behind the edit and at the end of the word.
        """
        half = self.sizes // 2
        at = np.flatnonzero(self.place >= (self.sizes - half if self.backwards else half)[self.word])
        word, place = self.word[at], self.place[at]
        rest = self.sizes[word] - 1 - place
        steps = np.ones(len(at), np.int64)
        while (more := (np.int64(1) << steps) - 1 < rest).any():
            steps += more
        ends = np.cumsum(steps)
        row = np.repeat(np.arange(len(at)), steps)
        level = np.arange(len(row)) - (ends - steps)[row] + 1
        ahead = np.minimum((np.int64(1) << level) - 1, rest[row])
        start = self.base[word] + place + 1
        if skip:
            to = self.prefix(word, place)[row] ^ self.shifted[start[row] + ahead] ^ self.shifted[start[row]]
        else:
            to = self.prefix(word[row], place[row] + 1 + ahead)
        return word, self.prefix(word, place), self.prefix(word, place + 1), self.codes[at], to, ends


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of both tries; the last one of a word holds its id."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        for backwards in (False, True):
            s = Spelled(words, backwards)
            parent, letter, child = s.edges()
            last = np.flatnonzero(s.place == s.sizes[s.word] - 1)
            ids = batch.column("wid")
            yield pa.record_batch({
                "parent": _long(np.append(parent, parent[last])),
                "letter": pa.array(np.append(letter, letter[last]).astype(np.int32)),
                "child": _long(np.append(child, child[last])),
                "ends": pa.concat_arrays([pa.nulls(len(parent), pa.int64()), ids.take(pa.array(s.word[last]))]),
            })


def _states(skip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for backwards in (False, True):
                word, node, child, letter, to, ends = Spelled(words, backwards).edits(skip)
                yield pa.record_batch({
                    "wid": batch.column("wid").take(pa.array(word)), "node": _long(node),
                    "own": _long(child), "letter": pa.array(letter.astype(np.int32)),
                    "ahead": pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends).astype(np.int32)), _long(to)
                    ),
                })

    return run


_STATE = "wid long, node long, own long, letter int, ahead array<long>"


def near_words(words: DataFrame) -> DataFrame:
    """a, b (ids): pairs of different words exactly one inserted, deleted or replaced code point
    apart, each pair in one direction only. ``words`` has wid (unique) and word (unique).

    Hashes only guide the search: what they find is confirmed on the words themselves.
    """
    edges = words.select("wid", "word").mapInArrow(_edges, "parent long, letter int, child long, ends long")
    edges = stored(edges.distinct(), "spelling-edges")
    inner, ends = edges.where("ends is null").drop("ends"), edges.where("ends is not null")
    ends = ends.select(F.col("child").alias("end"), "ends")
    skipped = words.mapInArrow(_states(True), _STATE).select("wid", "ahead")
    states = words.mapInArrow(_states(False), _STATE)
    # another letter at this place; of two such words the one with the smaller letter finds the other
    step = inner.select(F.col("parent").alias("from"), F.col("letter").alias("other"), "child")
    replaced = states.join(step, (F.col("node") == F.col("from")) & (F.col("letter") < F.col("other")))
    turn = F.col("own").bitwiseXOR(F.col("child"))
    replaced = replaced.select("wid", F.transform("ahead", lambda x: x.bitwiseXOR(turn)).alias("ahead"))
    nodes = inner.select(F.col("child").alias("node")).distinct()
    found, level, frontier = None, 0, skipped.unionByName(replaced)
    while True:
        here = frontier.withColumn("node", F.element_at("ahead", level + 1))
        last = F.size("ahead") == level + 1
        # a state at the end of its word is a neighbour if a word ends there too
        done = here.where(last).join(ends, F.col("node") == F.col("end")).select("wid", F.col("ends").alias("near"))
        done = stored(done, "spelling-found")
        found = done if found is None else found.unionByName(done)
        frontier = stored(here.where(~last).join(nodes, "node", "left_semi").drop("node"), "spelling-states")
        level += 1
        if frontier.isEmpty():
            break
    pairs = found.select(
        F.least("wid", "near").alias("a"), F.greatest("wid", "near").alias("b")
    ).where("a <> b").distinct()
    first = words.select(F.col("wid").alias("a"), F.col("word").alias("word_a"))
    second = words.select(F.col("wid").alias("b"), F.col("word").alias("word_b"))
    return pairs.join(first, "a").join(second, "b").where(
        F.levenshtein("word_a", "word_b", 1) == 1
    ).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """wid, root: the end of each chain of forms, the way halved in every round."""
    up = stored(forms.select("wid", F.col("form_id").alias("root")), "spelling-roots")
    while True:
        far = up.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(far, "root", "left").select(
            "wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ), "spelling-roots")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return up


def spelling_variants(counts: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of ``counts`` (word, n; words unique).

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the
    one of them with the largest n (ties: the smallest in code-point order), if its n is at least
    ``factor`` (over 1) times the word's own, else null. ``root`` is where the chain of forms ends,
    the word itself if it has none. Words of any length are looked at, null is left out, and an empty
    table gives no rows.
    """
    words = stored(
        counts.where("word is not null").select("word", "n")
        .withColumn("wid", F.monotonically_increasing_id()), "spelling-words",
    )
    pairs = stored(near_words(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("less"), "word", "wid").alias("other"))
    best = both.join(other, "b").groupBy(F.col("a").alias("wid")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best")
    )
    told = stored(words.join(best, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= F.col("n") * factor, F.col("best")).alias("best"),
    ), "spelling-forms")
    roots = _roots(told.where("best is not null").select("wid", F.col("best.wid").alias("form_id")))
    named = roots.join(
        words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root"
    ).select("wid", "root_word")
    return told.join(named, "wid", "left").select(
        "word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"),
    )
