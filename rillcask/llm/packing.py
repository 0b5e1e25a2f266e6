"""Best-fit packing of documents into bins under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_words, stored

SHARD_ITEMS = 4096  # pieces packed together by one task
BINS = 1 << 24  # bin numbers set aside for each shard


def _bits(values: pd.Series) -> list[int]:
    """A one-bit mask per value; values that are null or occur once can't conflict: no bit."""
    counts = values.value_counts()
    place = {v: 1 << i for i, v in enumerate(sorted(counts.index[counts > 1]))}
    return [0 if pd.isna(v) else place.get(v, 0) for v in values]


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """Bin of each item, in the given order.

    Bins are ordered by what room they have left. The search starts at the tightest bin that can
    hold the item and goes on to its successors until a bin carries none of the item's bits.
    """
    room: list[tuple[int, int]] = []  # (left, bin), sorted
    carried: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        at = bisect_left(room, (size, -1))
        while at < len(room) and carried[room[at][1]] & mask:
            at += 1
        if at < len(room):
            left, number = room.pop(at)
            carried[number] |= mask
        else:
            left, number = capacity, len(carried)
            carried.append(mask)
        insort(room, (left - size, number))
        out.append(number)
    return out


def _pack(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        number = [None if pd.isna(i) else int(i) for i in items["doc_id"]]
        items = items.assign(number=pd.Series(number, items.index, object)).sort_values(
            ["size", "number", "copy", "piece", "cluster"], ascending=[False, True, True, True, True],
            na_position="last", kind="stable",
        )
        sources, clusters = _bits(items["source"]), _bits(items["cluster"])
        shift = max((m.bit_length() for m in sources), default=0)
        masks = [s | c << shift for s, c in zip(sources, clusters)]
        number = best_fit(items["size"].tolist(), masks, capacity)
        out = items.assign(bin=[int(items["shard"].iloc[0]) * BINS + n for n in number])
        return out[["doc_id", "copy", "piece", "start", "size", "source", "cluster", "bin"]]

    return run


def pack(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", size: Column | None = None,
    source: Column | None = None, cluster: Column | None = None, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """doc_id, copy, piece, start, size, source, cluster, bin: one row per placed piece.

    No bin exceeds ``capacity`` or holds two pieces of one source or of one duplicate cluster; a
    null source or cluster conflicts with nothing. Defaults: size in words, column ``source``,
    and the hash of the text as cluster. A document longer than a bin is cut into pieces of
    ``capacity`` and a remainder, from ``start`` on; nothing is lost. An empty one takes no room
    but has a place. Rows that repeat an id are copies 0, 1, ... An empty table gives no rows.

    Only ids, sizes, sources and clusters are shuffled. Pieces are dealt by hash into shards of
    about ``shard_items``; a shard is one task, and its bins keep the conflicts of the whole, since
    a bin lies in one shard. Equal rows are counted first and dealt by copy, so no shard is hot.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    size = n_words(F.col("text")) if size is None else size
    source = F.col("source") if source is None else source
    cluster = F.md5(text) if cluster is None else cluster
    items = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.cast("long").alias("whole"),
        source.cast("string").alias("source"), cluster.cast("string").alias("cluster"),
    ).groupBy("doc_id", "whole", "source", "cluster").count()
    last = F.greatest(F.ceil(F.col("whole") / F.lit(capacity)) - 1, F.lit(0)).cast("long")
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    items = stored(items.select(
        "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).alias("size"),
        "source", "cluster",
    ), "pieces")
    shards = max(1, -(-items.count() // shard_items))
    place = F.pmod(F.xxhash64("doc_id", "copy", "piece", "source", "cluster"), F.lit(shards))
    items = items.withColumn("shard", place).withColumn("doc_id", id_text("doc_id"))
    return items.groupBy("shard").applyInPandas(
        _pack(capacity),
        "doc_id string, copy long, piece long, start long, size long, source string, "
        "cluster string, bin long",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
