"""Token ids in packed rows of fixed width."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe
from .common import id_text

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_TOKENS = 1 << 22  # tokens packed together by one task


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary from a local rank file, read on the driver and broadcast (about 1 MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TightestBin:
    """Finds the tightest bin with room for an item: a segment tree over room left, whose leaves
    say how many bins have exactly that room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest fit, taken out; None if no bin has the room."""
        at = size + self.width
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at *= 2
                if not self.count[at]:
                    at += 1
        room = at - self.width
        number = self.bins[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, number


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, largest items first."""
    tree, out = TightestBin(capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[item])
        if found is None:
            found = capacity, len(out)
            out.append([])
        out[found[1]].append(item)
        tree.add(found[0] - sizes[item], found[1])
    return out


def _pack(ranks, width: int, end: int, kind: str, shard: int):
    def emit(pieces, first):
        rows = []
        for n, items in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], width)):
            ids = np.full(width, end, kind)
            edges, segments = [0], []
            for i in items:
                doc_id, start, part = pieces[i]
                ids[edges[-1] : edges[-1] + len(part)] = part
                segments.append({"doc_id": doc_id, "start": start, "length": len(part)})
                edges.append(edges[-1] + len(part))
            rows.append((first + n, edges[-1], edges, edges[:-1], segments, ids.tobytes()))
        return pd.DataFrame(
            rows, columns=["pack", "n_tokens", "cu_seqlens", "resets", "segments", "ids"]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = ByteBpe(ranks.value)
        number = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        total = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(tokenizer.ids(text or ""), np.uint32(end)).astype(kind)
                own = None if doc_id is None else int(doc_id)
                for at in range(0, len(ids), width):
                    pieces.append((own, at, ids[at : at + width]))
                total += len(ids)
                if total >= shard:
                    yield (rows := emit(pieces, number))
                    number, pieces, total = number + len(rows), [], 0
        if pieces:
            yield emit(pieces, number)

    return run


def packed_tokens(
    docs: DataFrame, width: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    ranks_path: str = RANKS, end_id: int | None = None, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """pack, n_tokens, cu_seqlens, resets, segments, ids: one row of ``width`` ids per pack.

    ``ids`` is little-endian, in 16 bits if the vocabulary fits and else in 32, padded with the
    end id; ``cu_seqlens`` are the cumulative lengths of the segments, ``resets`` the places where
    positions start again at 0; ``segments`` names document, first token and length. Texts are
    taken whole and end with ``end_id`` (the first free id); a longer document is cut into pieces
    of ``width`` that lie in different rows; joined by ``start`` they are the document. A null or
    empty text is its end id alone. Repeated rows are packed each; a null id stays null.

    Nothing is shuffled: a task packs its own documents, a bounded number of tokens at a time.
    Write the rows with any writer, e.g. ``df.write.parquet``: they are finished binary matrices.
    """
    vocabulary = read_ranks(ranks_path)
    end = len(vocabulary) if end_id is None else end_id
    kind = "<u2" if max(end, max(vocabulary.values())) < 1 << 16 else "<u4"
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(
        id_text(id_col).alias("doc_id"), F.col(text_col).alias("text")
    ).mapInPandas(
        _pack(ranks, width, end, kind, shard_tokens),
        "pack long, n_tokens int, cu_seqlens array<int>, resets array<int>, "
        "segments array<struct<doc_id:long,start:long,length:int>>, ids binary",
    )
