"""Tokens of two vocabularies aligned by the bytes they cover, on Arrow tables.

A task lists the tokens of a block of documents, flattens the lists, sums token lengths document by
document and joins the ends of both sides with an Acero hash join: places where both end cut the
text into groups. A second join pairs the tokens of a group, group_by counts the pairs of each
document and then the documents of each pair. Spark adds the counts of the blocks up and brings
back to each block the counts of its own pairs only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, ranks_of
from .common import stored

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
CHUNK = 1 << 19  # letters of text aligned together
BLOCK = 6 << 20  # letters of text whose pairs are counted together
LINKS = 2_000_000  # links made by one join
WIDE = 4096  # links of a group from which its tokens are counted before they are paired


def _piece_bytes(processor) -> list[bytes]:
    """The bytes each piece stands for: U+2581 is a blank, <0xHH> a byte."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(
            bytes([int(piece[3:5], 16)]) if processor.is_byte(i)
            else piece.replace("▁", " ").encode()
        )
    return out


class Sides:
    """Both tokenizers of a task and the bytes of their tokens."""

    def __init__(self, byte_model: str, piece_model: bytes) -> None:
        ranks = ranks_of(byte_model)
        self.bytes_bpe = ByteBpe(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        names = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            names[i] = token
        self.names = [pa.array(names, pa.binary()), pa.array(_piece_bytes(self.pieces), pa.binary())]
        self.sizes = [pc.binary_length(n) for n in self.names]
        self.widths = [len(n) for n in self.names]
        marks = ((self.widths[0], ",|"), (self.widths[1], ",;"))
        self.lines = pa.array([f"{i}{m}" for n, two in marks for m in two for i in range(n)])

    def lists(self, texts: list[str | None]) -> list[pa.ListArray]:
        """Ids per text on both sides; none where a side does not give the text back."""
        wanted = [f" {t}".encode() if t else b"" for t in texts]
        found = [
            [self.bytes_bpe.ids(f" {t}").astype(np.int32) if t else [] for t in texts],
            [np.array(ids, np.int32) for ids in self.pieces.encode([t or "" for t in texts], num_threads=1)],
        ]
        good = np.array([bool(w) for w in wanted])
        for ids, names in zip(found, self.names):
            ends = np.cumsum([0, *map(len, ids)])
            flat = names.take(pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
            offsets = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)[ends]
            data = flat.buffers()[2].to_pybytes() if len(flat) else b""
            for i, want in enumerate(wanted):
                good[i] &= data[offsets[i] : offsets[i + 1]] == want
        return [_listed([i if ok else i[:0] for i, ok in zip(ids, good)]) for ids in found]


def _listed(ids: list) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32())
    )


def _ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[pa.Table, pa.Array]:
    """(document-end key, place) of each token; tokens; keys are document << 32 | end."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    total = pc.cumulative_sum(sizes.take(flat).cast(pa.int64()))
    # the sum of the documents before is taken off: the sum starts anew in each document
    offsets = np.asarray(ids.offsets)
    before = np.append(0, total.to_numpy())[offsets[:-1]]
    end = pc.subtract(total, pa.array(before, pa.int64()).take(parent))
    key = pc.bit_wise_or(pc.shift_left(parent, 32), end)
    return pa.table({"key": key, "at": pa.array(np.arange(len(flat)), pa.int64())}), flat


def _groups(tables: list[pa.Table]) -> tuple[list[np.ndarray], np.ndarray]:
    """Group number of each token on both sides, and the document of each group."""
    shared = tables[0].join(
        tables[1].rename_columns(["key", "other"]), "key", join_type="inner", use_threads=False
    ).sort_by("at")
    out = []
    for table, name in zip(tables, ("at", "other")):
        cut = np.zeros(table.num_rows + 1, np.int64)
        cut[np.asarray(shared[name]) + 1] = 1
        out.append(np.cumsum(cut)[:-1])
    return out, np.asarray(shared["key"]) >> 32


def _condensed(group: np.ndarray, ids: np.ndarray, wide: np.ndarray, name: str) -> pa.Table:
    """(group, id, weight): tokens as they are, those of wide groups counted by id."""
    own = wide[group]
    table = pa.table({"group": group[~own], name: ids[~own], f"w_{name}": np.ones(int((~own).sum()), np.int64)})
    if own.any():
        counted = pa.table({"group": group[own], name: ids[own]}).group_by(["group", name]).aggregate(
            [([], "count_all")]
        )
        table = pa.concat_tables([table, counted.rename_columns(["group", name, f"w_{name}"])]).sort_by("group")
    return table


def _links(groups: list[np.ndarray], ids: list[np.ndarray], doc: np.ndarray) -> pa.Table:
    """(doc, pair, n): how often each pair of ids is linked in a document; pair is a << 32 | b."""
    sizes = [np.bincount(g, minlength=len(doc)) for g in groups]
    wide = sizes[0] * sizes[1] > WIDE
    left, right = (_condensed(g, i, wide, n) for g, i, n in zip(groups, ids, "ab"))
    of_left, of_right = np.asarray(left["group"]), np.asarray(right["group"])
    first = np.searchsorted(of_right, np.arange(len(doc) + 1))
    made = np.cumsum(np.diff(first)[of_left])
    parts, at = [], 0
    while at < len(of_left):
        to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + LINKS, "right")))
        low, high = first[of_left[at]], first[of_left[to - 1] + 1]
        joined = left.slice(at, to - at).join(
            right.slice(low, high - low), "group", join_type="inner", use_threads=False
        )
        pair = pc.bit_wise_or(pc.shift_left(joined["a"].cast(pa.int64()), 32), joined["b"].cast(pa.int64()))
        parts.append(pa.table({
            "doc": pa.array(doc).take(joined["group"].combine_chunks()), "pair": pair,
            "n": pc.multiply(joined["w_a"], joined["w_b"]),
        }).group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]))
        at = to
    if not parts:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    whole = pa.concat_tables(parts).rename_columns(["doc", "pair", "n"])
    if len(parts) > 1:
        whole = whole.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
        whole = whole.rename_columns(["doc", "pair", "n"])
    return whole


def _digests(
    lines: pa.StringArray, widths: list[int], ids: list[np.ndarray], groups: list[np.ndarray], doc: np.ndarray,
    n_docs: int,
) -> list[str]:
    """sha256 of each document's groups, written as a1,a2|b1;a3|b2,b3.

    ``lines`` holds each id four times, as the strings "id," and "id|" of side A and "id," and "id;"
    of side B; the tokens are laid out group by group, and the strings they name stand in one buffer.
    """
    before = [np.searchsorted(g, np.arange(len(doc) + 1)) for g in groups]
    index = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side, (own, group, at, base) in enumerate(
        zip(ids, groups, (before[1][:-1], before[0][1:]), (0, 2 * widths[0]))
    ):
        last = np.zeros(len(own), np.int64)
        last[before[side][1:] - 1] = 1
        index[np.arange(len(own)) + at[group]] = base + last * widths[side] + own
    text = lines.take(pa.array(index))
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    data = memoryview(text.buffers()[2] or b"")
    cuts = offsets[(before[0] + before[1])[np.searchsorted(doc, np.arange(n_docs + 1))]]
    # the last separator does not count
    return [
        hashlib.sha256(data[low : high - 1]).hexdigest() if high > low else ""
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist())
    ]


_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string())]


def _aligned(sides: Sides, texts: list[str | None]) -> tuple[dict[str, pa.Array], pa.Table]:
    """Columns per document, and its links."""
    lists = sides.lists(texts)
    tables, flats = zip(*[_ends(ids, sizes) for ids, sizes in zip(lists, sides.sizes)])
    groups, doc = _groups(list(tables))
    flats = [np.asarray(f) for f in flats]
    links = _links(groups, flats, doc)
    digests = _digests(sides.lines, sides.widths, flats, groups, doc, len(texts))
    sizes = [np.bincount(g, minlength=len(doc)) for g in groups]
    made = np.zeros(len(texts), np.int64)
    np.add.at(made, doc, sizes[0] * sizes[1])
    return {
        "n_a": pc.list_value_length(lists[0]).cast(pa.int64()),
        "n_b": pc.list_value_length(lists[1]).cast(pa.int64()),
        "n_groups": pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()),
        "n_links": pa.array(made, pa.int64()), "groups_sha256": pa.array(digests, pa.string()),
    }, links


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: high bytes are nearly all zero."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 3)


def _unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _block_rows(models):
    """A row per block with its documents and links, and a row per block and pair with the number
    of documents that hold it."""
    def rows(block: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = {n: pa.concat_arrays([c[n] for _, c, _ in parts]) for n, _ in _DOC}
        ids = pa.concat_arrays([i for i, _, _ in parts])
        base = np.cumsum([0, *[len(i) for i, _, _ in parts]])
        links = pa.concat_tables([
            t.set_column(0, "doc", pc.add(t["doc"], int(b))) for (_, _, t), b in zip(parts, base)
        ])
        order = pc.sort_indices(links, [("doc", "ascending"), ("pair", "ascending")])
        doc, pair, n = (np.asarray(links[c].take(order)) for c in ("doc", "pair", "n"))
        held = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        number = np.searchsorted(np.asarray(held["pair"]), pair)
        # distances to the number before, from 0 on in each document
        step, new = np.diff(number, prepend=0), np.flatnonzero(np.diff(doc, prepend=-1))
        step[new] = number[new]
        per_doc = np.bincount(doc, minlength=len(ids))
        documents = pa.StructArray.from_arrays([ids, *columns.values()], names=["id", *columns])
        packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), documents)
        nothing = pa.nulls(1, pa.int64())
        yield pa.record_batch([
            pa.array([block]), packed, pa.array([_squeezed(per_doc)]), pa.array([_squeezed(step)]),
            pa.array([_squeezed(n)]), nothing, nothing, nothing,
        ], names=_BLOCK)
        k = held.num_rows
        for at in range(0, k, 100_000):
            part = held.slice(at, 100_000).combine_chunks()
            m = part.num_rows
            yield pa.record_batch([
                pa.array(np.full(m, block)), pa.nulls(m, packed.type), *[pa.nulls(m, pa.binary())] * 3,
                pa.array(np.arange(at, at + m)), part["pair"].combine_chunks(),
                part["count_all"].combine_chunks(),
            ], names=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, block = Sides(*models.value), TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in batches:
            for own, texts, letters in _chunks(batch):
                parts.append((own, *_aligned(sides, texts)))
                size += letters
                if size >= BLOCK:
                    yield from rows(block, parts)
                    block, parts, size = block + 1, [], 0
        if parts:
            yield from rows(block, parts)

    return run


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list, int]]:
    """(ids, texts, letters) of neighbouring rows; a longer text is a chunk of its own."""
    ids, at, texts, size = batch.column("id"), 0, [], 0
    for i, text in enumerate(batch.column("text")):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= CHUNK or i + 1 == batch.num_rows:
            yield ids.slice(at, i + 1 - at), texts, size
            at, texts, size = i + 1, [], 0


_BLOCK = ["block", "documents", "per_doc", "step", "times", "number", "pair", "docs"]


def _told(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with sums over their links, from the counts of the block's pairs."""
    out = []
    counts = np.zeros(right.num_rows, np.int64)
    best = np.zeros(right.num_rows, np.int64)
    counts[np.asarray(right["number"])] = np.asarray(right["total"])
    best[np.asarray(right["number"])] = np.asarray(right["best"]).astype(np.int64)
    for i in range(left.num_rows):
        documents = left["documents"][i].values
        per_doc, step, times = (
            _unsqueezed(left[c][i].as_py(), "<i8") for c in ("per_doc", "step", "times")
        )
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        total = np.cumsum(step)
        base = np.append(0, total)[np.cumsum(per_doc) - per_doc]
        number = total - base[doc]
        sums = [np.zeros(len(per_doc), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc, times * best[number])
        np.add.at(sums[1], doc, times * counts[number])
        out.append(pa.table({
            **{n: documents.field(k) for k, n in enumerate(["id", *[c for c, _ in _DOC]])},
            "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]),
        }))
    return pa.concat_tables(out)


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabularies: tuple[str, str] = VOCABULARIES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input
    row. Pairs: a, b, docs, best: every pair of ids that is linked anywhere, the number of documents
    that hold it linked, and whether no other pair of ``a`` is held by more.

    Side A is byte-level BPE of a blank and the text, side B pieces of the text, which begin with a
    blank themselves; special tokens are plain text. Places where tokens of both sides end cut the
    text into groups, and all tokens of a group are linked with each other. Texts that are null,
    empty, or that a side does not give back byte by byte have no tokens: zeros and ''. Each row is
    a document, whatever its id, which may be null or of any type. An empty table gives no rows.

    Vocabularies are local files read on the driver and broadcast (2 MB). A block holds some MB of
    text or one longer text; a group with many tokens is counted by id before it is paired, so a
    run that both sides cut out of step costs no more than its different ids.
    """
    with open(vocabularies[0], encoding="utf-8") as a, open(vocabularies[1], "rb") as b:
        models = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string"
    blocks = stored(rows.mapInArrow(
        _block_rows(models),
        f"block long, documents array<struct<{fields}>>, per_doc binary, step binary, times binary, "
        "number long, pair long, docs long",
    ), "alignment-blocks")
    own = blocks.where("pair is not null").select("block", "number", "pair", "docs")
    counts = stored(own.groupBy("pair").agg(F.sum("docs").alias("total")), "alignment-pairs")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("of")).agg(F.max("total").alias("most"))
    counts = counts.join(most, first == F.col("of")).select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best")
    )
    counts = stored(counts, "alignment-counts")
    named = own.join(counts, "pair").select(F.col("block").alias("of_block"), "number", "total", "best")
    whole = blocks.where("pair is null").select("block", "documents", "per_doc", "step", "times")
    told = whole.groupBy("block").cogroup(named.groupBy("of_block")).applyInArrow(
        _told, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long",
    ).withColumnRenamed("id", id_col)
    pairs = counts.select(
        first.cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"),
        F.col("total").alias("docs"), "best",
    )
    return told, pairs
