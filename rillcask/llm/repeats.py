"""Repeated passages across documents: buckets of equal strings, refined by later offsets.

The suffixes of a text begin in buckets of equal q-grams. A bucket is refined by the identifiers of
the strings at further offsets, bucket by bucket and round by round, until what is left in a bucket
agrees on the whole length. An identifier is made from its string alone, so tasks agree on it
without a global sort, and a round is a grouping.

Only suffixes that can decide something take part. The *anchor* of a window of ``length`` bytes is
its q-gram of smallest hash (the leftmost on ties). Equal windows have equal anchors at equal
places, so windows need comparing only inside the bucket of their anchor, and one row stands for
all windows that share an anchor (about one row per 35 bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

GRAM = 32  # bytes of the first buckets
STEPS = (16, 4, 1)  # offsets that share a row in each later round
CHUNK = 1 << 18  # bytes of text hashed together
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that powers can be undone


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """64-bit identifiers of any substring of a chunk, from sums of weighted bytes."""

    def __init__(self, base: int, room: int) -> None:
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)
        self.grow(room)

    def grow(self, room: int) -> None:
        self.up, self.down = _powers(self.base, room), _powers(self.back, room)

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, width: int) -> np.ndarray:
        """``of`` for the ``width`` bytes from every place on."""
        x = self.sums[width:] - self.sums[:-width]
        x *= self.down[: len(x)]
        return _mixed(x)


def _lowest(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of ``width`` 32-bit values, from every place on."""
    # the place in the low half makes the leftmost the smallest of equal values
    v = v.astype(np.uint64) << np.uint64(32) | np.arange(len(v), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        v = np.minimum(v[: len(v) - step], v[step:])
        size += step
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs(change: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs, given where a new one begins."""
    begin = np.flatnonzero(change)
    return begin, np.diff(np.append(begin, n))


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges as maximal ones."""
    order = np.argsort(begin, kind="stable")
    begin, far = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > far[:-1]) if len(begin) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    return begin[first], far[last]


def _places(data: np.ndarray, sizes: np.ndarray, length: int, gram: int, one: Hashes) -> tuple:
    """Rows (document, first window, windows, anchor, gram id)."""
    one.load(data)
    grams = one.every(gram)
    lowest = _lowest(grams >> np.uint64(32), length - gram + 1)
    # windows start where the rest of the document is as long as they are
    ends = np.cumsum(sizes)
    starts = np.maximum(sizes - length + 1, 0)
    before = np.cumsum(starts) - starts
    window = np.arange(starts.sum()) + np.repeat(ends - sizes - before, starts)
    anchor = lowest[window]
    change = np.ones(len(window), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first, count = _runs(change, len(window))
    begin, anchor = window[first], anchor[first]
    doc = np.searchsorted(ends, begin, side="right")
    return doc, begin, count, anchor, grams[anchor]


def _anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int, hashes) -> tuple:
    """Rows (document, first window, windows, anchor, gram id, two ids of all their bytes)."""
    one, two = hashes
    doc, begin, count, anchor, h = _places(data, sizes, length, gram, one)
    two.load(data)
    end = begin + count - 1 + length
    place = _mixed(((anchor - begin) * 65536 + count).astype(np.uint64))
    return doc, begin, count, anchor, h, one.of(begin, end) ^ place, two.of(begin, end)


_ROWS = [("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("pos", pa.int32()),
         ("n", pa.int32()), ("off", pa.int32())]


def _chunks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list, list, list]]:
    """(rows, offsets, bytes) of pieces with at least one window, CHUNK bytes or so at a time.

    A long text comes in pieces that share ``length`` - 1 bytes, so every window is in one of them.
    """
    rows, offsets, pieces, total = [], [], [], 0
    for i, text in enumerate(batch.column("bytes")):
        raw = text.as_buffer()
        size = 0 if raw is None else raw.size
        for at in range(0, size - length + 1, CHUNK):
            piece = raw.slice(at, min(CHUNK + length - 1, size - at))
            rows.append(i)
            offsets.append(at)
            pieces.append(piece)
            total += piece.size
            if total >= CHUNK:
                yield rows, offsets, pieces
                rows, offsets, pieces, total = [], [], [], 0
    if rows:
        yield rows, offsets, pieces


def _emit(length: int, gram: int, only_grams: bool):
    """Anchors of each document, a repeated set of windows once (h set), and the ranges in which a
    document repeats itself (h null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hashes(b, 2 * CHUNK) for b in _BASES]
        for batch in batches:
            for rows, offsets, pieces in _chunks(batch, length):
                data = np.frombuffer(b"".join(pieces), np.uint8)
                sizes = np.array([p.size for p in pieces])
                doc, begin, count, anchor, h, s1, s2 = _anchors(data, sizes, length, gram, hashes)
                order = np.lexsort((begin, s2, s1, h, doc))
                same = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                same[1:] = (doc[a] == doc[b]) & (h[a] == h[b]) & (s1[a] == s1[b]) & (s2[a] == s2[b])
                again = np.sort(order[same])
                keep = np.sort(order[~same])
                if only_grams:
                    yield pa.record_batch({"h": pa.array(h[keep].view(np.int64))})
                    continue
                base = np.cumsum(sizes) - sizes
                shift = np.array(offsets) - base
                low, high = _merged(begin[again], begin[again] + count[again] - 1 + length)
                who = np.searchsorted(base, low, side="right") - 1
                index = pa.array(np.array(rows)[np.append(doc[keep], who)])
                empty = pa.nulls(len(low), pa.int64())
                columns = [
                    *[pa.concat_arrays([pa.array(x[keep].view(np.int64)), empty]) for x in (h, s1, s2)],
                    pa.array(np.append(begin[keep] + shift[doc[keep]], low + shift[who]), pa.int32()),
                    pa.array(np.append(count[keep], high - low - length + 1), pa.int32()),
                    pa.array(np.append(anchor[keep] - begin[keep], np.zeros(len(low), int)), pa.int32()),
                ]
                yield pa.record_batch(
                    [batch.column(c).take(index) for c in ("id", "fp")] + columns,
                    names=["id", "fp", *[n for n, _ in _ROWS]],
                )

    return run


def _owner(*extra: str) -> Column:
    """Sorts like the place of a string: documents by id, nulls last, then by the text's hash."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "fp", *extra)


def _same_doc(prefix: str) -> Column:
    return F.col("id").eqNullSafe(F.col(f"{prefix}id")) & (F.col("fp") == F.col(f"{prefix}fp"))


def _ranges(length: int) -> list[Column]:
    return [F.col("id"), F.col("fp"), F.col("pos").alias("begin"),
            (F.col("pos") + F.col("n") - 1 + length).alias("end")]


def _first_round(docs: DataFrame, id_type: str, length: int, gram: int, scratch: Scratch):
    """(ranges to remove, strings that stay undecided) from whole sets of windows."""
    counts = docs.select("bytes").mapInArrow(_emit(length, gram, True), "h long").groupBy("h").agg(
        F.count(F.lit(1)).alias("members")
    )
    shared = scratch.keep(counts.where("members > 1").select(F.col("h").alias("gram")), "grams")
    rows = docs.mapInArrow(
        _emit(length, gram, False),
        f"id {id_type}, fp long, h long, s1 long, s2 long, pos int, n int, off int",
    )
    found = scratch.keep(rows.join(shared, F.col("h") == F.col("gram"), "left").where(
        "h is null or gram is not null"
    ).drop("gram"), "anchors")
    again = found.where("h is null").select(*_ranges(length))
    rows = found.where("h is not null")
    classes = scratch.keep(
        rows.groupBy("h", "s1", "s2").agg(F.min(_owner("pos", "n", "off")).alias("first")), "classes"
    )
    key = [F.col(c).alias(f"k_{c}") for c in ("h", "s1", "s2")]
    later = rows.join(
        classes.select(*key, "first"),
        (F.col("h") == F.col("k_h")) & (F.col("s1") == F.col("k_s1")) & (F.col("s2") == F.col("k_s2")),
    ).where(~_owner("pos", "n", "off").eqNullSafe(F.col("first")))
    mixed = classes.groupBy(F.col("h").alias("gram")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    undecided = classes.join(mixed, F.col("h") == F.col("gram"), "left_semi").select("h", "first.*").drop("none")
    out = [scratch.keep(again.unionByName(later.select(*_ranges(length))), "ranges"),
           scratch.keep(undecided, "undecided")]
    scratch.drop("grams", "anchors", "classes")
    return out


def _next_round(rows: DataFrame, step: int, length: int, scratch: Scratch) -> list[DataFrame]:
    """One refinement of rows (h, id, fp, pos, n, off, bytes): ranges to remove, and what is left.

    The windows of a row are cut into aligned blocks of ``step`` offsets to the anchor; ``off`` is
    the anchor's offset in the row's first window. A block has its own bytes and those that all
    windows of a whole block at this place hold (``core``); a clipped block holds them too.
    """
    bounds = [F.floor((F.col("off") - F.col("n") + 1) / step), F.floor(F.col("off") / step)]
    rows = rows.withColumn("block", F.explode(F.sequence(*bounds))).withColumn("block", F.col("block").cast("int"))
    high = F.least(F.col("off"), F.col("block") * step + step - 1)
    low = F.greatest(F.col("off") - F.col("n") + 1, F.col("block") * step)
    cut = rows.withColumns({"high": high, "low": low})
    skip = F.col("off") - F.col("high")
    part = F.substring(F.col("bytes"), skip + 1, F.col("high") - F.col("low") + length)
    inner = F.substring(
        F.col("bytes"), F.col("off") - F.col("block") * step + 1, F.lit(length - step + 1)
    )
    where = [F.col(c).cast("string") for c in ("h", "block")]
    cut = cut.select(
        "h", "id", "fp", (F.col("pos") + skip).alias("pos"),
        (F.col("high") - F.col("low") + 1).alias("n"), F.col("high").alias("off"),
        part.alias("bytes"),
        F.unhex(F.md5(F.concat(F.concat_ws(":", *where).cast("binary"), inner))).alias("core"),
        F.unhex(F.md5(F.concat(F.concat_ws(
            ":", *where, F.col("low").cast("string"), F.col("high").cast("string")
        ).cast("binary"), part))).alias("whole"),
    )
    cut = scratch.keep(cut, f"blocks-{step}")
    classes = scratch.keep(cut.groupBy("whole").agg(
        F.min(_owner("pos", "n", "off")).alias("first"), F.any_value("h").alias("h"),
        F.any_value("core").alias("core"), F.any_value("bytes").alias("bytes"),
    ), f"classes-{step}")
    later = cut.select("whole", "id", "fp", "pos", "n", "off").join(
        classes.select(F.col("whole").alias("k_whole"), "first"), F.col("whole") == F.col("k_whole")
    ).where(~_owner("pos", "n", "off").eqNullSafe(F.col("first"))).select(*_ranges(length))
    mixed = classes.groupBy(F.col("core").alias("k_core")).agg(F.count(F.lit(1)).alias("kinds"))
    left = classes.join(
        mixed.where("kinds > 1"), F.col("core") == F.col("k_core"), "left_semi"
    ).select("h", "first.*", "bytes").drop("none")
    out = [scratch.keep(later, f"ranges-{step}"), scratch.keep(left, f"left-{step}")]
    scratch.drop(f"blocks-{step}", f"classes-{step}")
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a document's ranges and leave their bytes out."""
    for batch in batches:
        spans, kept = [], []
        for text, ranges in zip(batch.column("bytes"), batch.column("ranges")):
            raw, listed = text.as_buffer() or b"", ranges.values
            if not listed:
                spans.append([])
                kept.append(bytes(raw))
                continue
            low, high = _merged(*[listed.field(i).to_numpy().astype(np.int64) for i in (0, 1)])
            raw, edges = memoryview(raw), [0, *np.stack([low, high], 1).ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"begin": a, "end": b} for a, b in zip(edges[1:-1:2], edges[2:-1:2])])
        yield pa.record_batch([
            batch.column("id"), batch.column("n_bytes"),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary()),
        ], names=["id", "n_bytes", "spans", "kept"])


def find_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
    gram: int = GRAM,
) -> DataFrame:
    """doc_id, n_bytes, spans, kept: one row per input row.

    ``spans`` are the maximal byte ranges of the text (UTF-8) covered by a string of ``length`` bytes
    that also starts earlier, ``kept`` the other bytes. Earlier means in a document of smaller id, or
    further in front in the same document; occurrences may overlap, and strings are looked for in
    the texts as given, not in what is left of them. A null or shorter text has no such string and
    is kept (null as no bytes). Ids may be of any type that can be ordered; null is the largest.
    Documents that share an id come in the order of a hash of their texts; rows equal in both are
    one document, each returned. An empty table gives no rows; other columns are not looked at.

    Rounds: grams that occur once leave. Anchors whose windows agree altogether form a class; all
    but its first member go, the first one stays undecided if the bucket holds other classes. Their
    bytes are then cut into blocks of 16, 4 and 1 windows; in each round a block that agrees with an
    earlier one goes, one whose core nobody shares is done, the others are cut further. Groups are
    folded map-side and joined back by key, so a passage in a third of all documents is never
    gathered. Strings are told apart by 64 bits for the q-gram and 128 for all windows of a row.
    """
    if not max(gram, *STEPS) <= length < 1 << 15:
        raise ValueError("a passage holds at least one gram and the windows of a block overlap")
    text = F.col(text_col)
    docs = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("fp"),
        F.coalesce(text, F.lit("")).cast("binary").alias("bytes"),
    )
    id_type = docs.schema["id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "repeats")
    ranges, undecided = _first_round(docs, id_type, length, gram, scratch)
    wanted = undecided.select("h", *[F.col(c).alias(f"w_{c}") for c in ("id", "fp", "pos", "n", "off")])
    rows = docs.join(wanted, _same_doc("w_")).select(
        "h", "id", "fp", F.col("w_pos").alias("pos"), F.col("w_n").alias("n"), F.col("w_off").alias("off"),
        F.substring("bytes", F.col("w_pos") + 1, F.col("w_n") - 1 + length).alias("bytes"),
    )
    for step in STEPS:
        later, rows = _next_round(rows, step, length, scratch)
        ranges = ranges.unionByName(later)
    lists = ranges.groupBy(F.col("id").alias("r_id"), F.col("fp").alias("r_fp")).agg(
        F.collect_list(F.struct("begin", "end")).alias("ranges")
    )
    found = docs.join(lists, _same_doc("r_"), "left").select(
        "id", F.octet_length("bytes").cast("long").alias("n_bytes"), "bytes", "ranges"
    )
    return found.mapInArrow(
        _cut_out,
        f"id {id_type}, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary",
    ).withColumnRenamed("id", id_col)
