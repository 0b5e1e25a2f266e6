"""Bit model of text: hashed-context predictors, gated logistic mixing, adaptive refinement.

A text is its lower-cased words, each followed by a space, and one end mark (a line feed). The
model predicts it bit by bit. Contexts are the last bytes of the word, the word so far, and the
topic that the text before the word speaks for.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, stored, words
from .near import mixed

TOPICS, TOPIC_SLOTS, TOPIC_STARTS = 8, 1 << 13, 12
TOPIC_TEXTS = 1024  # topics start from so many texts
TOPIC_ROUNDS = 3  # then are fitted again on all learned texts
# Predictors: (bytes of context, whether the topic is part of it); None: the whole word so far.
CONTEXTS = ((2, True), (3, True), (4, True), (6, False), (None, False), (None, True))
SLOT_BITS = (18, 20, 21, 21, 21, 21)  # size of each predictor's table
GATES = 72  # sets of mixing weights
BINS = 24  # of the refinement, per node of a byte
TOP = 65_535  # counts in a slot are scaled to fit 16 bits
DEPTH = 3  # words that begin with the same bytes share a bucket
GROUP, STEP = 4096, 512  # keys whose contexts are counted together, keys per online step
BLOCK_BYTES = 8 << 20  # text of a block
BUCKET_BYTES = 4 << 20  # text per bucket of words
TABLE_BYTES = 128 << 20  # text per task that fills tables
_ODD = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 16, _ODD[40], np.uint64), dtype=np.uint64)
PREDICTORS = len(CONTEXTS)
WHOLE = np.array([n is None for n, _ in CONTEXTS])
OFFSETS = np.r_[0, np.cumsum([1 << b for b in SLOT_BITS])]
LOGS = np.log(np.arange(TOP + 2) + 0.4).astype(np.float32)
SURE = (np.minimum(np.log2(np.arange(TOP + 1) + 1.0), 11).astype(np.int64) // 2).astype(np.int16)


def fit_topics(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each word slot per topic, (slots + 1, topics); the last row is the
    topics' own. Hard assignment and re-estimation, from several seeded starts; the likeliest end
    stays."""
    n = len(counts)
    if not n:
        return np.zeros((TOPIC_SLOTS + 1, 1), np.float32)
    common = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * counts.shape[1])
    long = np.flatnonzero(counts.sum(1) >= np.median(counts.sum(1)))
    best, found = -np.inf, None
    for start in range(TOPIC_STARTS):
        centres = np.random.default_rng(start).permutation(long)[:TOPICS]
        mass = counts[centres] + 50 * common
        prior = np.zeros(len(centres))
        for _ in range(15):
            logs = np.log(mass / mass.sum(1, keepdims=True))
            values = counts @ logs.T + prior
            own = values.argmax(1)
            member = own[:, None] == np.arange(len(centres))[None, :]
            mass = member.T.astype(np.float32) @ counts + 50 * common
            prior = np.log((member.sum(0) + 1) / (n + len(centres)))
        if (total := values.max(1).sum()) > best:
            best, found = total, np.vstack([logs.T, prior[None, :]])
    return found.astype(np.float32)


def topics_before(slots: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The likeliest topic before each word and before the end, from what came earlier."""
    sums = np.cumsum(np.vstack([model[-1:], model[slots]]), axis=0, dtype=np.float64)
    return sums.argmax(1)


def topic_slot(word: bytes) -> int:
    return zlib.crc32(word) & (TOPIC_SLOTS - 1)


def topic_slots(some: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, some), np.int64, len(some)) & (TOPIC_SLOTS - 1)


def laid_out(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (topic byte and word; no word: the end) as topic, space, word, space, in a row; and
    the length of each."""
    parts = [k[:1] + b" " + k[1:] + (b" " if len(k) > 1 else b"\n") for k in keys]
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def grouped(keys: list[bytes], limit: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys of a bucket in groups of about ``limit``: their numbers and depths.

    Keys whose words share their first ``depth`` bytes are in one group, so a context of at least
    that many bytes of a word occurs in this group only. Where too many words begin alike, depth
    doubles. The groups depend on the keys alone: every step cuts a bucket in the same way. Within
    a group, keys keep the order they have in the bucket.
    """
    def cut(some, depth):
        by: dict[bytes, list[int]] = defaultdict(list)
        for i in some:
            by[keys[i][1 : depth + 1]].append(i)
        for head, part in by.items():
            if len(part) > limit and len(head) == depth:
                yield from cut(part, 2 * depth)
            else:
                yield part, depth

    def put(parts):
        numbers = np.concatenate([part for part, _ in parts])
        order = np.argsort(numbers)
        return numbers[order], np.repeat([d for _, d in parts], [len(part) for part, _ in parts])[order]

    parts, size = [], 0
    for part, depth in cut(range(len(keys)), DEPTH):
        if parts and size + len(part) > limit:
            yield put(parts)
            parts, size = [], 0
        parts.append((part, depth))
        size += len(part)
    if parts:
        yield put(parts)


def events(flat: np.ndarray, lens: np.ndarray, depths: np.ndarray | None = None):
    """Slots of every predicted bit: (slots [predictor, bit], bits, node, place, owner).

    Context, half of the byte and the bits already known choose the slot; one line of 16 slots
    serves half a byte. With the depth of each key, contexts of the whole word so far that are at
    least as long get slots of their own behind the tables, numbered within these keys.
    """
    begins = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(flat)) - begins[owner]
    wide = flat.astype(np.uint64) + np.uint64(1)
    term = np.where(place >= 2, wide * _POWERS[place % len(_POWERS)], np.uint64(0))
    before = np.cumsum(term, dtype=np.uint64) - term
    whole = before - before[begins][owner]
    seen = np.flatnonzero(place >= 2)
    topic = wide[begins][owner][seen] * _ODD[30]
    last = {0: np.zeros(len(seen), np.uint64)}
    for k in range(1, 7):
        byte = np.where(place[seen] > k, wide[np.maximum(seen - k, 0)], np.uint64(0))
        last[k] = last[k - 1] * np.uint64(257) + byte
    byte = flat[seen].astype(np.int64)
    n = len(seen)
    bits, node = np.empty((n, 8), np.int8), np.empty((n, 8), np.int16)
    for i in range(8):
        bits[:, i] = byte >> (7 - i) & 1
        node[:, i] = 1 << i | byte >> (8 - i)
    low = (np.arange(8) - 4).clip(0)
    inner = np.where(np.arange(8) < 4, node, node & ((1 << low) - 1) | 1 << low)
    slots = np.empty((PREDICTORS, n, 8), np.int32)
    deep = None if depths is None else place[seen] - 2 >= depths[owner[seen]]
    end = OFFSETS[-1]
    for p, ((size, by_topic), width) in enumerate(zip(CONTEXTS, SLOT_BITS)):
        h = (whole[seen] if size is None else last[size]) * _ODD[p]
        h = mixed((h ^ topic if by_topic else h) + np.uint64(p + 1))
        shift = np.uint64(64 - (width - 4))
        two = mixed(h + ((byte >> 4).astype(np.uint64) + np.uint64(1)) * _ODD[20])
        slots[p, :, :4] = ((h >> shift).astype(np.int64) << 4)[:, None] + inner[:, :4] + OFFSETS[p]
        slots[p, :, 4:] = ((two >> shift).astype(np.int64) << 4)[:, None] + inner[:, 4:] + OFFSETS[p]
        if size is None and deep is not None and deep.any():
            lines, where = np.unique(np.stack([h[deep], two[deep]], axis=1), return_inverse=True)
            own = (where.reshape(-1, 2) << 4).repeat(4, axis=1) | inner[deep]
            used = np.zeros(16 * len(lines), bool)
            used[own] = True
            slots[p, deep] = (np.cumsum(used, dtype=np.int32) - 1)[own] + end
            end += np.count_nonzero(used)
    return (slots.reshape(PREDICTORS, -1), bits.ravel(), node.ravel(),
            np.repeat(place[seen], 8), np.repeat(owner[seen], 8))


def _fitting(total: np.ndarray) -> np.ndarray:
    """Counts of slots scaled to 16 bits; none that was there becomes 0."""
    total = total.astype(np.int64).reshape(-1, 2)
    big = np.maximum(total[:, 0], total[:, 1])
    fit, over = total.astype(np.uint16), np.flatnonzero(big > TOP)
    fit[over] = np.ceil(total[over] * (TOP / big[over])[:, None]).astype(np.uint16)
    return fit


def own_counts(slots: np.ndarray, bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Counts of the slots behind the tables, which only these events have."""
    size = max(0, int(slots.max(initial=0)) + 1 - OFFSETS[-1])
    total = np.zeros(2 * size)
    for p in np.flatnonzero(WHOLE):
        own = slots[p] >= OFFSETS[-1]
        total += np.bincount((slots[p][own] - OFFSETS[-1]) * 2 + bits[own], k[own], 2 * size)
    return _fitting(total)


class ContextMixer:
    """Mixes the predictors of a table of counts, (slots, 2) in 16 bits."""

    def __init__(self, counts: np.ndarray, weights=None, refined=None):
        self.pairs = np.ascontiguousarray(counts).reshape(-1).view("<u4")
        if weights is None:
            weights = np.tile(np.where(WHOLE, 0.35, 0.12).astype(np.float32), (GATES, 1))
        self.weights, self.refined = weights, refined
        # A mixer that only prices looks its stretched predictions up.
        self.stretched = None if refined is None else LOGS[self.pairs >> 16] - LOGS[self.pairs & TOP]
        self.slope = np.tile(np.eye(PREDICTORS) * 20.0, (GATES, 1, 1))
        self.cells = np.zeros((256 * BINS, 2))

    def _append(self, counts: np.ndarray) -> None:
        """Put the counts of a group's own slots behind the tables."""
        more = np.ascontiguousarray(counts).reshape(-1).view("<u4")
        end = OFFSETS[-1] + len(more)
        if end > len(self.pairs):
            room = end + len(more) // 4
            self.pairs = np.r_[self.pairs[: OFFSETS[-1]], np.zeros(room - OFFSETS[-1], "<u4")]
            if self.stretched is not None:
                self.stretched = np.r_[
                    self.stretched[: OFFSETS[-1]], np.zeros(room - OFFSETS[-1], np.float32)]
        self.pairs[OFFSETS[-1] : end] = more
        if self.stretched is not None:
            self.stretched[OFFSETS[-1] : end] = LOGS[more >> 16] - LOGS[more & TOP]

    def _mix(self, slots, bits, node, place, less=0):
        """Stretched predictions, weight set, probability and refinement cell of each bit.
        ``less`` takes so many occurrences of the word itself out of the counts."""
        x = np.empty(slots.shape, np.float32)
        for p in range(PREDICTORS):
            if not less and self.stretched is not None:
                x[p] = self.stretched[slots[p]]
                continue
            both = self.pairs[slots[p]]
            n0, n1 = (both & TOP).astype(np.int32), (both >> 16).astype(np.int32)
            if less:
                n0 = np.maximum(n0 - less * (1 - bits), 0)
                n1 = np.maximum(n1 - less * bits, 0)
            x[p] = LOGS[n1] - LOGS[n0]
        if not less:
            both = self.pairs[slots[-1]]
            n0, n1 = both & TOP, both >> 16
        gate = SURE[np.minimum(n0 + n1, TOP)] * 12 + np.minimum(place - 2, 5) * 2 + (node >= 16)
        z = np.zeros(len(bits), np.float32)
        for p in range(PREDICTORS):
            z += x[p] * self.weights[:, p][gate]
        z = z.clip(-14, 14)
        cell = node.astype(np.int64) * BINS + ((z + 12) * (BINS / 24)).astype(np.int64).clip(0, BINS - 1)
        return x, gate, 1 / (1 + np.exp(-z)), cell

    def learn(self, keys: list[bytes], counts: np.ndarray, depths: np.ndarray) -> None:
        """Learn online from a group's keys: predict, then move each set of weights against its
        error by the inverse of the curvature seen so far."""
        slots, bits, node, place, owner = events(*laid_out(keys), depths)
        k = counts[owner].astype(np.float64)
        self._append(own_counts(slots, bits, k))
        edges = np.searchsorted(owner, np.arange(0, len(keys) + STEP, STEP))
        for at, to in zip(edges, edges[1:]):
            some = slice(at, to)
            self._step(slots[:, some], bits[some], node[some], place[some], k[some])

    def _step(self, slots, bits, node, place, k) -> None:
        x, gate, p, cell = self._mix(slots, bits, node, place, less=1)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        error, slope = (k * (bits - p))[order], (k * np.maximum(p * (1 - p), 1e-4))[order]
        x, edges = x[:, order].astype(np.float64), np.searchsorted(gate[order], np.arange(GATES + 1))
        up = np.zeros((GATES, PREDICTORS))
        for g, (at, to) in enumerate(zip(edges, edges[1:])):
            if to > at:
                part = x[:, at:to]
                up[g] = part @ error[at:to]
                self.slope[g] += (part * slope[at:to]) @ part.T
        step = np.linalg.solve(self.slope, up[:, :, None])[:, :, 0]
        self.weights = (self.weights + step.clip(-0.2, 0.2)).astype(np.float32)
        seen = np.bincount(cell * 2 + bits, k, self.cells.size)
        self.cells += seen.reshape(-1, 2)

    def cost(self, keys: list[bytes], counts: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Bits of information of each key of a group; ``counts`` says how often each was learned."""
        slots, bits, node, place, owner = events(*laid_out(keys), depths)
        self._append(own_counts(slots, bits, counts[owner]))
        _, _, p, cell = self._mix(slots, bits, node, place)
        p = (p + self.refined[cell]) / 2
        p = np.where(bits == 1, p, 1 - p).clip(1e-7, 1)
        return np.bincount(owner, -np.log2(p), len(keys))


def refinement(cells: np.ndarray) -> np.ndarray:
    """Probability per node and predicted range, learned from what came; unseen: the range."""
    centre = 1 / (1 + np.exp(-((np.arange(len(cells)) % BINS + 0.5) * (24 / BINS) - 12)))
    return (cells[:, 1] + 32 * centre) / (cells.sum(1) + 32)


def _blob(keys: list[bytes]) -> bytes:
    return b" ".join(keys)  # neither topic bytes nor words hold a space


def _pressed(keys: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_blob(keys))


def _keys(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b" ")


def _thin(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: most are small, so rows stay light in the JVM."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _wide(data: bytes, kind) -> np.ndarray:
    raw, size = zstandard.ZstdDecompressor().decompress(data), np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _numbered() -> defaultdict:
    """Gives each new key the next number."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    return index


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for place, text in zip(batch["place"], batch["text"]):
            slots = topic_slots(words(text))
            counts = np.bincount(slots, minlength=TOPIC_SLOTS).astype(np.float32)
            yield pd.DataFrame({"place": [place], "counts": [counts.tobytes()]})


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({
            "slots": [topic_slots(words(text)).astype(np.uint16).tobytes() for text in batch["text"]]
        })


def _assign(shared):
    """Words per slot, and texts, of each topic over the texts of a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value.astype(np.float64)
        mass = np.zeros((model.shape[1], TOPIC_SLOTS + 1), np.int64)
        for batch in batches:
            for blob in batch["slots"]:
                slots = np.frombuffer(blob, np.uint16)
                if len(slots) > TOPIC_SLOTS:
                    counts = np.bincount(slots, minlength=TOPIC_SLOTS)
                    own = (counts @ model[:-1] + model[-1]).argmax()
                    mass[own, :-1] += counts
                else:
                    own = (model[slots].sum(0) + model[-1]).argmax()
                    np.add.at(mass[own], slots, 1)
                mass[own, -1] += 1
        yield pd.DataFrame({"topic": np.arange(len(mass)), "counts": [_thin(m) for m in mass]})

    return run


def _add_topic(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(_wide(blob, np.int64) for blob in rows["counts"])
    return pd.DataFrame({"topic": [rows["topic"].iloc[0]], "counts": [_thin(total)]})


def topic_model(source: DataFrame) -> np.ndarray:
    """Topics of all learned texts.

    The first ``TOPIC_TEXTS`` in hash order choose the start; every round then gives each text to
    its likeliest topic and estimates the topics from the sums over all texts. Texts are cut into
    words once: the rounds read the numbers of their slots, two bytes a word.
    """
    learned = source.filter("not held_out and text is not null")
    got = learned.select(
        F.xxhash64("doc_id", F.lit("topics")).alias("place"), "text"
    ).orderBy("place").limit(TOPIC_TEXTS).mapInPandas(_sampled, "place long, counts binary").toPandas()
    got = got.sort_values(["place", "counts"])
    rows = [np.frombuffer(c, np.float32) for c in got["counts"]]
    model = fit_topics(np.array(rows) if rows else np.zeros((0, TOPIC_SLOTS), np.float32))
    scratch = Scratch(source.sparkSession, "topics")
    if rows:
        slots = scratch.keep(learned.select("text").mapInPandas(_slots, "slots binary"), "slots")
    for _ in range(TOPIC_ROUNDS if rows else 0):
        shared = source.sparkSession.sparkContext.broadcast(model)
        sums = slots.mapInPandas(_assign(shared), "topic int, counts binary").groupBy(
            "topic").applyInPandas(_add_topic, "topic int, counts binary").toPandas().sort_values("topic")
        mass = np.array([_wide(c, np.int64) for c in sums["counts"]], np.float64)
        common = mass[:, :-1].sum(0) + 0.1
        mass, texts = mass[:, :-1] + 50 * common / common.sum(), mass[:, -1]
        prior = np.log((texts + 1) / (texts.sum() + len(texts)))
        model = np.vstack([np.log(mass / mass.sum(1, keepdims=True)).T, prior]).astype(np.float32)
    scratch.drop("slots")
    return model


def _code(buckets: int, topics):
    """Words as numbers, per block of documents; the block's keys, dealt into buckets."""
    def flush(number, docs, index):
        model = topics.value
        n = model.shape[1]
        tokens = list(index)
        slots = topic_slots(tokens)
        end = index[b""]
        slots = slots if end < len(tokens) else np.r_[slots, 0]
        tokens = tokens if end < len(tokens) else [*tokens, b""]
        coded = [
            (np.r_[ids, end] * n + topics_before(slots[ids], model)).astype(np.int32)
            for _, _, _, ids in docs
        ]
        used = np.bincount(np.concatenate(coded), minlength=len(tokens) * n)
        learned = [c for c, (_, held, _, _) in zip(coded, docs) if not held]
        counts = np.bincount(np.concatenate(learned), minlength=len(used)) if learned else used * 0
        kept = np.flatnonzero(used)
        place = np.zeros(len(used), np.int32)
        place[kept] = np.arange(len(kept))
        keys = [bytes((65 + k % n,)) + tokens[k // n] for k in kept.tolist()]
        heads = [t[:DEPTH] for t in tokens]
        own = np.fromiter(map(zlib.crc32, heads), np.int64, len(heads)) % buckets
        bucket = own[kept // n]
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
        rows = [(0, number, None, d, h, size, _thin(place[c]), None, None, len(keys))
                for c, (d, h, size, _) in zip(coded, docs)]
        for at, to in zip(edges, [*edges[1:], len(order)]):
            some = order[at:to]
            rows.append((1, number, int(bucket[some[0]]), None, None, None,
                         _thin(some.astype(np.int32)), _pressed([keys[i] for i in some]),
                         _thin(counts[kept[some]].astype(np.int64)), len(some)))
        return pd.DataFrame(rows, columns=[
            "kind", "block", "bucket", "doc_id", "held_out", "n_bytes", "ids", "data",
            "counts", "size",
        ]).astype({"bucket": "Int64", "held_out": "boolean", "n_bytes": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        docs, total, index = [], 0, _numbered()
        for batch in batches:
            for doc_id, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
                parts = words(text)
                size = sum(map(len, parts)) + len(parts) + 1
                docs.append((doc_id, bool(held), size,
                             np.fromiter(map(index.__getitem__, parts), np.int32, len(parts))))
                total += size
                if total >= BLOCK_BYTES:
                    yield flush(number, docs, index)
                    docs, total, index, number = [], 0, _numbered(), number + 1
        if docs:
            yield flush(number, docs, index)

    return run


CODED = ("kind int, block long, bucket long, doc_id string, held_out boolean, n_bytes long, "
         "ids binary, data binary, counts binary, size int")


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """All keys of a bucket once, with training counts of the key and of its word, and where each
    block's keys are."""
    index, places, counts = _numbered(), [], []
    for data, numbers in zip(rows["data"], rows["counts"]):
        keys = _keys(data)
        places.append(np.fromiter(map(index.__getitem__, keys), np.int32, len(keys)))
        counts.append(_wide(numbers, np.int64))
    total = np.bincount(np.concatenate(places), np.concatenate(counts), len(index)).astype(np.int64)
    tokens = _numbered()
    own = np.fromiter((tokens[k[1:]] for k in index), np.int64, len(index))
    by_word = np.bincount(own, total, len(tokens)).astype(np.int64)
    order = np.argsort(np.fromiter(map(zlib.crc32, index), np.uint32, len(index)), kind="stable")  # mixes common and rare words
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order))
    keys = list(index)
    return pd.DataFrame([{
        "bucket": rows["bucket"].iloc[0], "words": _pressed([keys[i] for i in order]),
        "counts": _thin(total[order]), "word_counts": _thin(by_word[own][order]),
        "n_tokens": int(total.sum()), "n_types": int((by_word > 0).sum()),
        "blocks": rows["block"].tolist(), "ids": rows["ids"].tolist(),
        "places": [_thin(back[p]) for p in places],
    }])


COUNTED = ("bucket long, words binary, counts binary, word_counts binary, n_tokens long, "
           "n_types long, blocks array<long>, ids array<binary>, places array<binary>")
PIECE = 1 << 16  # numbers per row of a table


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the slots over the keys of a task, in pieces."""
    table = None
    for batch in batches:
        for blob, numbers in zip(batch["words"], batch["counts"]):
            if table is None:
                table = np.zeros(OFFSETS[-1] * 2, np.int64)
            keys, counts = _keys(blob), _wide(numbers, np.int64)
            for some, depths in grouped(keys):
                known = counts[some] > 0
                some, depths = some[known], depths[known]
                slots, bits, _, _, owner = events(*laid_out([keys[i] for i in some]), depths)
                k = counts[some][owner]
                for p in range(PREDICTORS):
                    shared = slots[p] < OFFSETS[-1]
                    np.add.at(table, slots[p][shared] * np.int64(2) + bits[shared], k[shared])
    if table is not None:
        for i in range(0, len(table), PIECE):
            piece = table[i : i + PIECE]
            if piece.any():
                yield pd.DataFrame({"piece": [i], "counts": [_thin(piece)]})


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PIECE, np.int64)
    for blob in rows["counts"]:
        some = _wide(blob, np.int64)
        total[: len(some)] += some
    return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "counts": [_thin(_fitting(total).ravel())]})


def _learn(shared):
    """Online learning over the keys of a task; curvatures and curvature times weights, which add
    up over the tasks to the weights that suit all of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            for blob, numbers in zip(batch["words"], batch["counts"]):
                model = model or ContextMixer(shared.value)
                keys, counts = _keys(blob), _wide(numbers, np.int64)
                for some, depths in grouped(keys):
                    known = counts[some] > 0
                    some = some[known]
                    if len(some):
                        model.learn([keys[i] for i in some], counts[some], depths[known])
        if model is not None:
            pull = np.einsum("gij,gj->gi", model.slope, model.weights.astype(float))
            values = np.r_[model.slope.ravel(), pull.ravel(), model.cells.ravel()]
            yield pd.DataFrame({"place": np.arange(len(values)), "value": values})

    return run


def _mixer_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement from the sums of all tasks."""
    n = GATES * PREDICTORS
    slope = values[: n * PREDICTORS].reshape(GATES, PREDICTORS, PREDICTORS)
    pull = values[n * PREDICTORS :][:n].reshape(GATES, PREDICTORS, 1)
    weights = np.linalg.solve(slope + np.eye(PREDICTORS) * 1e-6, pull)[:, :, 0].astype(np.float32)
    return weights, refinement(values[n * (PREDICTORS + 1) :].reshape(-1, 2))


def _price(shared, final):
    """Count and cost of every key of every block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            for blob, learned, numbers, blocks, ids, places in zip(
                batch["words"], batch["counts"], batch["word_counts"], batch["blocks"], batch["ids"],
                batch["places"],
            ):
                model = model or ContextMixer(shared.value, *final.value)
                keys, counts = _keys(blob), _wide(numbers, np.int64)
                learned, cost = _wide(learned, np.int64), np.zeros(len(keys), np.float32)
                for some, depths in grouped(keys):
                    cost[some] = model.cost([keys[i] for i in some], learned[some], depths)
                out = [(block, own, _thin(counts[p]), _thin(cost[p])) for block, own, p in zip(
                    blocks, ids, (_wide(x, np.int32) for x in places))]
                yield pd.DataFrame(out, columns=["block", "ids", "counts", "cost"])

    return run


def _score(n_tokens: int, n_types: int):
    def run(key, docs: pd.DataFrame, priced: pd.DataFrame) -> pd.DataFrame:
        size = int(docs["size"].iloc[0]) if len(docs) else 0
        counts, cost = np.zeros(size, np.int64), np.zeros(size, np.float64)
        for own, c, b in zip(priced["ids"], priced["counts"], priced["cost"]):
            at = _wide(own, np.int32)
            counts[at], cost[at] = _wide(c, np.int64), _wide(b, np.float32)
        share = np.log10((counts + 1) / (n_tokens + n_types + 1))
        ids = [_wide(blob, np.int32) for blob in docs["ids"]]
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"],
            "n_tokens": [len(i) for i in ids], "n_known": [int((counts[i] > 0).sum()) for i in ids],
            "train_tokens": n_tokens, "base_score": [float(share[i].sum()) for i in ids],
            "bits": [float(cost[i].sum()) for i in ids], "n_bytes": docs["n_bytes"],
        })

    return run


def score_texts(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, bits, n_bytes, bits_per_byte.

    ``held_out`` is a boolean column; all other rows are learned from. ``base_score`` is the log10
    probability under single words with one added to each count, ``bits`` the cost under the mixed
    model; both count the end as a token. A null or blank text is its end mark alone; repeated
    rows count as often as they occur; a null id is passed on. An empty table gives no rows.

    1. Documents become numbers in blocks of text; a block's keys (topic and word) are listed
       once, with counts, and dealt into buckets by the first bytes of the word, a hot word being
       one entry per block.
    2. A bucket adds up its keys over all blocks: the vocabulary, which grows with the corpus.
    3. Its keys fill the hashed tables, then train the mixer online, each task on its keys
       (without the word itself in the counts); the tasks' weights are joined by curvature.
       Contexts of the whole word so far occur in one bucket only, beyond its first bytes: they
       are counted there, each on its own, and grow with the vocabulary.
    4. A bucket prices its keys; a block gets the counts and costs of its own back and adds them
       up per document. Tables of short contexts, weights and topics have a fixed size; nothing
       else is broadcast.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(
        id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // BUCKET_BYTES))
    topics = context.broadcast(topic_model(source))
    coded = stored(source.mapInPandas(_code(buckets, topics), CODED), "coded")
    counted = stored(
        coded.filter("kind = 1").select("bucket", "block", "ids", "data", "counts")
        .groupBy("bucket").applyInPandas(_count, COUNTED), "word-counts",
    )
    totals = counted.agg(F.sum("n_tokens"), F.sum("n_types")).first()

    table = np.zeros((OFFSETS[-1], 2), np.uint16)
    pieces = counted.select("words", "counts").repartition(max(1, -(-size // TABLE_BYTES))).mapInPandas(
        _fill, "piece long, counts binary"
    ).groupBy("piece").applyInPandas(_add, "piece long, counts binary").toPandas()
    flat = table.reshape(-1)
    for at, blob in zip(pieces["piece"], pieces["counts"]):
        flat[at : at + PIECE] = _wide(blob, np.uint16)[: len(flat) - at]
    shared = context.broadcast(table)

    sums = counted.select("words", "counts").mapInPandas(
        _learn(shared), "place int, value double"
    ).groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(GATES * PREDICTORS * (PREDICTORS + 1) + 256 * BINS * 2)
    values[sums["place"]] = sums["value"]
    final = context.broadcast(_mixer_of(values))

    priced = counted.select("words", "counts", "word_counts", "blocks", "ids", "places").mapInPandas(
        _price(shared, final), "block long, ids binary, counts binary, cost binary"
    )
    scored = coded.filter("kind = 0").select(
        "block", "doc_id", "held_out", "n_bytes", "ids", "size"
    ).groupBy("block").cogroup(priced.groupBy("block")).applyInPandas(
        _score(int(totals[0] or 0), int(totals[1] or 0)),
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, bits double, n_bytes long",
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.withColumn("bits_per_byte", F.col("bits") / F.col("n_bytes"))
