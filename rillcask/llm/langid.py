"""Language identification with n-gram presence kernels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LENGTHS = (2, 3, 4)  # the blended spectrum, in characters
SLOTS = 1 << 15  # hashed n-grams
SAMPLE_ROWS = 2048  # labelled rows the classifier is fitted on, spread over the languages
LANDMARKS = 512  # of them
RIDGE = 1e-2
BATCH = 256
UNKNOWN = "und"
FOREIGN = 100  # distinct n-grams from which on a text is told to be of no learned language
_GAP = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def present(text: str, out: np.ndarray) -> None:
    """Mark the hashed n-grams of the whole text; all but letters counts as one gap."""
    plain = f" {_GAP.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in LENGTHS:
        if len(codes) >= n:
            size = len(codes) - n + 1
            h = np.full(size, n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : i + size]) * _FACTORS[i]
                h ^= h >> np.uint32(15)
            out[h % np.uint32(SLOTS)] = 1


def _presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(out, texts):
        present(text, row)
    return out


def fit(rows: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and one weight column per language, from rows of 0 and 1.

    Kernel: shared n-grams over the root of both counts. Nyström: the kernel to the landmarks
    stands for the whole kernel, and the ridge regressions, one language against the rest, are
    solved in their span. Since the kernel is a product of presence vectors, the landmark
    coefficients fold into one weight per n-gram, and scoring is a product of matrices.
    """
    return fit_parts(lambda at, to: rows[at:to], len(rows), langs)


def fit_parts(
    rows: Callable[[int, int], np.ndarray], n: int, langs: list[str]
) -> tuple[list[str], np.ndarray]:
    """``fit`` on ``n`` rows that are asked for part by part."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((SLOTS, 0), np.float32)
    def unit(part: np.ndarray) -> np.ndarray:
        part = part.astype(np.float32)
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1))
        return part

    marks = unit(rows(0, LANDMARKS))
    to_marks = np.concatenate([
        unit(rows(at, at + BATCH)) @ marks.T for at in range(0, n, BATCH)
    ]).astype(float)
    among = to_marks[: len(marks)]
    goal = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    left = to_marks.T @ to_marks + RIDGE * n * among / max(1, len(marks))
    left += 1e-6 * np.eye(len(marks)) * max(1.0, np.trace(left) / len(marks))
    held = np.linalg.solve(left, to_marks.T @ goal)
    # a part of the slots at a time: the product makes doubles of the landmarks
    return names, np.concatenate([
        (marks[:, at : at + SLOTS // 8].T @ held).astype(np.float32) for at in range(0, SLOTS, SLOTS // 8)
    ])


def score(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the regressions, (texts, languages), and the distinct n-grams of each text."""
    rows = _presence(texts)
    sizes = rows.sum(1, keepdims=True)
    return rows @ weights / np.sqrt(np.maximum(sizes, 1)), sizes[:, 0].astype(int)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows: the first of each language in hash order, then the second,
    and so on. Languages are counted first, and only the part of a language's hash range that
    holds about twice ``rows`` of its rows is ranked, however many it has."""
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(id_col), F.lit("sample")).alias("place"),
    )
    counts = stored(labelled.groupBy("lang").count(), "languages")
    share = F.shiftrightunsigned("place", 1) / F.lit(2.0**63)
    chosen = labelled.join(counts, "lang").filter(share * F.col("count") <= 2 * rows).drop("count")
    chosen = chosen.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    chosen = chosen.orderBy("nth", "place", "lang").limit(rows)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).filter("text is not null and lang is not null")
    # At most ``rows`` ids: a bounded list.
    return texts.join(F.broadcast(chosen), ["doc_id", "lang"]).orderBy("nth", "place", "lang").limit(rows)


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bits = [np.packbits(_presence([t]).astype(bool)).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"lang": batch["lang"], "nth": batch["nth"], "place": batch["place"],
                            "bits": bits})


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> tuple[list[str], np.ndarray]:
    """Classifier from the labelled rows of ``docs``. The driver gets at most ``sample_rows`` bit
    sets of 4 KB, never texts."""
    got = sample(docs, id_col, text_col, lang_col, sample_rows).mapInPandas(
        _marked, "lang string, nth int, place long, bits binary"
    ).toPandas().sort_values(["nth", "place", "lang"], kind="stable")
    bits = np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), SLOTS // 8)
    return fit_parts(
        lambda at, to: np.unpackbits(bits[at:to], axis=1), len(bits), got["lang"].tolist()
    )


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``foreign`` to a table whose column ``text`` is
    the text.

    ``foreign``: each regression, one language against the rest, puts the text with the rest (a score
    below 0.5), and the text has ``FOREIGN`` n-grams, enough to tell.
    A text that is null, empty or without a letter, or a model without languages, gives ``und``
    with score 0, not foreign. Ties go to the first language in order. Texts are taken whole.
    """
    names, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("lang_pred string, score double, foreign boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        pred, best, foreign = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        told = [i for i, t in enumerate(texts) if has_letter(t)] if names else []
        for at in range(0, len(told), BATCH):
            part = told[at : at + BATCH]
            for i, line, size in zip(part, *score([texts.iloc[i] for i in part], shared.value)):
                top = int(line.argmax())
                pred[i], best[i] = names[top], float(min(1.0, max(0.0, (line[top] + 1) / 2)))
                foreign[i] = bool(line[top] < 0 and size >= FOREIGN)
        return pd.DataFrame({"lang_pred": pred, "score": best, "foreign": foreign})

    rest = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*rest, guess("text").alias("__guess")).select(*rest, "__guess.*")


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
