"""Byte-level BPE over whole texts of any length."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# Fixed value: how the vocabulary's makers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of what \s means there; longer ones exceed the stack of the pattern matcher.
_LONG_RUN = re.compile(
    "[\t-\r \x85\xa0  -     　]{20000,}"
)


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(model: str) -> dict[bytes, int]:
    """Bytes and id of each ordinary token of a byte-level BPE file (JSON text).

    Ids must have the order of the merges, as then the lowest id is merged first.
    """
    file, letters = json.loads(model), byte_letters()
    special = {t["content"] for t in file["added_tokens"]}
    vocabulary = file["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    if ids != sorted(ids):
        raise ValueError("the vocabulary does not list its tokens in the order of their merges")
    return {
        bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special
    }


class ByteBpe:
    """Ids of whole texts; no string in a text is special."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.own = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """A run of white space before other text is one piece but for its last letter, and so is a
        run at the end: long ones are merged on their own, which gives the same ids."""
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            piece = text[run.start() : end].encode()
            merged = self.own._core_bpe.encode_single_piece(piece)
            parts += [self._short(text[at : run.start()]), np.array(merged, np.uint32)]
            at = end
        parts.append(self._short(text[at:]))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _short(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, disallowed_special=())
