"""License notices: conditional compression with templates, confirmed by their wording."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

# The customary wording of public license notices. Several may share a license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
     "this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met:"),
    ("All-Rights-Reserved", "All rights reserved."),
]
LOST = 0.1  # greatest share of a template's words that may differ
NEGATIONS = ("not", "non", "without", "no")
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def word_list(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places; signs around them don't count."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _fixed(word: str) -> bool:
    """Numbers and negations must be the same: a version or a "non" makes another license."""
    return word in NEGATIONS or any(ch.isdigit() for ch in word)


def _allowed(template: list[str]) -> int:
    return int(LOST * len(template))


def cues_of(templates: list[list[str]]) -> dict[str, int]:
    """Cue words, and how many words around each a notice reaches.

    A notice with as many differing words as allowed still has one of a template's longest words,
    if one more of them is a cue than may differ.
    """
    reach: dict[str, int] = {}
    for words in templates:
        lost = _allowed(words)
        for word in sorted(words, key=lambda w: (not w.isascii(), -len(w), w))[: lost + 1]:
            reach[word] = max(reach.get(word, 0), len(words) + lost)
    return reach


def align(template: list[str], piece: list[str], most: int) -> tuple[int, int, int] | None:
    """(begin, end, differing words) of the place in the piece that is most like the template, if
    at most so many words differ; from the first word that is the same to the last one."""
    never = (most + 1, -1, -1)
    loose = [not _fixed(other) for other in piece]
    line: list[tuple[int, int, int]] = [(0, -1, -1)] * (len(piece) + 1)
    for word in template:
        may, last = not _fixed(word), line
        line = [(last[0][0] + 1, -1, -1) if may else never]
        for j, other in enumerate(piece):
            if word == other:
                cost, begin, _ = last[j]
                line.append((cost, j if begin < 0 else begin, j + 1))
                continue
            best = last[j] if may and loose[j] else never
            if may and last[j + 1][0] < best[0]:
                best = last[j + 1]
            if loose[j] and line[j][0] < best[0]:
                best = line[j]
            line.append((best[0] + 1, *best[1:]))
        if min(line)[0] > most:
            return None
    cost, begin, end = min(line, key=lambda x: x[0])
    return (begin, end, cost) if begin >= 0 and cost <= most else None


class Scanner:
    """Compressors primed with each template; built once per task."""

    def __init__(self, templates: list[tuple[str, str]]):
        templates = [(name, text) for name, text in templates if _WORD.search(text)]
        self.names = [name for name, _ in templates]
        self.words = [[w for w, _, _ in word_list(text)] for _, text in templates]
        self.cues = cues_of(self.words)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.primed = []
        for words in self.words:
            raw = " ".join(words).encode()
            primer = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.primed.append(zstandard.ZstdCompressor(
                level=3, dict_data=primer, write_content_size=False, write_dict_id=False))

    def blocks(self, words: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        """Spans of words around the cues, as far as a notice reaches; spans that touch are one."""
        spans: list[tuple[int, int]] = []
        for at, (word, _, _) in enumerate(words):
            if (reach := self.cues.get(word)) is None:
                continue
            begin, end = max(0, at - reach), min(len(words), at + reach + 1)
            while spans and begin <= spans[-1][1]:
                first, last = spans.pop()
                begin, end = min(begin, first), max(end, last)
            spans.append((begin, end))
        return spans

    def confirm(self, template: list[str], block: list[str]) -> list[tuple[int, int, int]]:
        """(begin, end, differing words) of every place where the block has the wording.

        The template is cut into one part more than words may differ; a notice has one of them
        unchanged, wherever it is, and is compared from there.
        """
        most, n = _allowed(template), len(template)
        line, starts = f" {' '.join(block)} ", []
        at = 0
        for word in block:
            starts.append(at)
            at += len(word) + 1
        edges = [n * i // (most + 1) for i in range(most + 2)]
        begins = set()
        for a, b in zip(edges, edges[1:]):
            part = f" {' '.join(template[a:b])} "
            at = line.find(part)
            while at >= 0:
                begins.add(bisect_left(starts, at) - a)
                at = line.find(part, at + 1)
        found, spans = [], set()
        for begin in sorted(begins, key=lambda x: (block[max(x, 0) : max(x, 0) + n] != template, x)):
            if begin >= 0 and block[begin : begin + n] == template:
                got = (begin, begin + n, 0)
            else:
                low = max(0, begin - most)
                got = align(template, block[low : max(0, begin + n + most)], most)
                got = got and (low + got[0], low + got[1], got[2])
            if got and got not in spans:
                spans.add(got)
                found.append(got)
        return sorted(found, key=lambda x: (x[2], x[0]))

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of candidate blocks, and the confirmed notices, best saving first."""
        words = word_list(text)
        spans = self.blocks(words)
        out: list[dict] = []
        for begin, end in spans:
            block = [w for w, _, _ in words[begin:end]]
            raw = " ".join(block).encode()
            alone = len(self.plain.compress(raw))
            saved = [alone - len(c.compress(raw)) for c in self.primed]
            ranked = sorted(range(len(saved)), key=lambda i: (-saved[i], -len(self.words[i]), i))
            taken: list[tuple[int, int]] = []
            for i in ranked:
                for a, b, edits in self.confirm(self.words[i], block):
                    if any(a < y and x < b for x, y in taken):
                        continue
                    taken.append((a, b))
                    out.append({
                        "license": self.names[i], "start": words[begin + a][1],
                        "end": words[begin + b - 1][2], "saved": saved[i], "edits": edits,
                    })
        return len(spans), out


def _scan(templates):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(0, []) if t is None else scanner.scan(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_blocks": [n for n, _ in rows],
                "licenses": [sorted({m["license"] for m in found}) for _, found in rows],
                "notices": [found for _, found in rows],
            })

    return run


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """doc_id, n_blocks, licenses, notices: one row per input row.

    ``notices`` holds license, start and end (characters), bytes saved and differing words. Blocks
    of the whole text around the templates' rarest (longest) words, as wide as a notice reaches, are
    compressed alone and with each template as raw dictionary. Every template is looked for word by word, with one word in ten
    differing at most and no number or negation; where two notices overlap, the one whose template
    saves more bytes stays. A null or empty text, and one without such a word, has none. Only texts
    with such a word leave the JVM; nothing is shuffled.
    """
    cues = sorted(Scanner(templates).cues)
    hint = F.lit(False)
    if all(c.isascii() for c in cues):
        lower = F.lower(F.col(text_col))
        # A cue that is part of another one finds the texts of both.
        for cue in (c for c in cues if not any(d in c for d in cues if d != c)):
            hint = hint | lower.contains(cue)
    else:
        hint = F.lit(True)  # other letters are not lower-cased alike everywhere
    hinted = F.when(hint, F.col(text_col))
    return docs.select(id_text(id_col).alias("doc_id"), hinted.alias("text")).mapInPandas(
        _scan(templates), "doc_id string, n_blocks int, licenses array<string>, "
        "notices array<struct<license:string,start:int,end:int,saved:int,edits:int>>",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
