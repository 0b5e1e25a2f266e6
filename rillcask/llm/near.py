"""Near duplicates: one-permutation MinHash, bands, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, words
from .graph import components

MISSED = 2.5e-9  # how often a pair at the threshold may miss every band
MOST_ROWS, MANY_BANDS = 6, 128
FILTER_BITS = 1 << 24  # of the filter that names candidate documents, 2 MB
BUCKET_BITS = 1 << 15  # of it in a bitmap of Spark's bitmap functions
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_FACTORS = mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(parts: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle."""
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(h) - width + 1)
    total = np.full(n, len(parts) if len(parts) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys, one row per non-empty set.

    One permutation: sorted hashes fall into equal ranges, the first of a range is its minimum.
    An empty range borrows from the first non-empty one of its own fixed probe sequence (optimal
    densification), which makes even tiny sets agree range by range with their similarity.
    """
    k = bands * rows
    sig = np.zeros((len(sets), k), np.uint64)
    full = np.zeros((len(sets), k), bool)
    for i, h in enumerate(sets):
        where = ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        first = np.r_[True, where[1:] != where[:-1]]
        sig[i, where[first]] = h[first]
        full[i, where[first]] = True
    row, col = np.nonzero(~full)
    step = 0
    while len(row):
        step += 1
        probe = mixed(col.astype(np.uint64) * _FACTORS[7] + np.array([step], np.uint64) * _FACTORS[9])
        probe = ((probe >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        hit = full[row, probe]
        sig[row[hit], col[hit]] = sig[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys += sig.reshape(len(sets), bands, rows)[:, :, r] * _FACTORS[r]
    return mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[rows]).view(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band for a threshold: as many rows as still need few bands."""
    if percent >= 100:
        return 1, MOST_ROWS
    for rows in range(MOST_ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-((max(percent, 1) / 100) ** rows)))
        if bands <= MANY_BANDS:
            break
    return bands, rows


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, sets = [], []
            for text in batch["text"]:
                parts = words(text)
                digests.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest())
                sets.append(shingle_hashes(parts, width))
            keys: list = [None] * len(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            for i, line in zip(some, signatures([sets[i] for i in some], bands, rows)):
                keys[i] = line
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "raw": batch["raw"], "digest": digests,
                "n_shingles": [len(s) for s in sets], "bands": keys,
            })

    return run


FOLDS = 4  # 64-bit words that hold a fold of a difference
FOLDED = "+".join(f"bit_count(x.fold[{i}] & y.fold[{i}])" for i in range(FOLDS))


def _fold(items: np.ndarray) -> tuple[list[int], int]:
    """Bits of a set of hashes, and how many of its items share a bit with another one."""
    bits = np.unique(items >> np.uint64(64 - 8))
    out = np.zeros(FOLDS, np.uint64)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out.view(np.int64).tolist(), len(items) - len(bits)


def _shingles(text: str, width: int) -> set:
    parts = words(text)
    if len(parts) < width:
        return {tuple(parts)}
    return set(zip(*[parts[i:] for i in range(width)]))


def _similar(left: set, right: set, percent: int) -> bool:
    common = len(left & right)
    return 100 * common >= percent * (len(left) + len(right) - common)


def _compare(width: int, percent: int):
    """Whether hub and node are linked, by their whole sets; and what sets the node apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left, left_hashes = None, set(), None
        for batch in batches:
            rows = []
            for hub, node, low, hub_text, text in zip(
                batch["hub"], batch["node"], batch["low"], batch["hub_text"], batch["text"]
            ):
                if hub_text != last:
                    last, left = hub_text, _shingles(hub_text, width)
                    left_hashes = shingle_hashes(words(hub_text), width)
                right = shingle_hashes(words(text), width)
                more = np.setdiff1d(right, left_hashes, assume_unique=True)
                less = np.setdiff1d(left_hashes, right, assume_unique=True)
                fold, lost = _fold(more)
                linked = _similar(left, _shingles(text, width), percent)
                rows.append((hub, node, low, linked, len(left_hashes), len(right), lost, fold,
                             more.view(np.int64), less.view(np.int64)))
            yield pd.DataFrame(rows, columns=[
                "hub", "node", "low", "linked", "n_hub", "n", "lost", "fold", "more", "less"])

    return run


COMPARED = ("hub long, node long, low boolean, linked boolean, n_hub long, n long, lost long, "
            "fold array<long>, more array<long>, less array<long>")


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_similar(_shingles(a, width), _shingles(b, width), percent)
                    for a, b in zip(batch["text_a"], batch["text_b"])]
            yield batch.loc[good, ["a", "b"]]

    return run


def _may_link(percent: int):
    """Whether two nodes x and y of one hub h are linked, from their differences to it:
    the shared part is h - less_x - less_y + (less_x and less_y) + (more_x and more_y).
    Bounds that need no sets come first."""
    need = F.expr(f"{percent} * (x.n + y.n)")
    total = 100 + percent
    in_hub = F.expr("least(x.n_hub - size(x.less), y.n_hub - size(y.less))")
    return (
        F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        & (total * (in_hub + F.expr("least(size(x.more), size(y.more))")) >= need)
        & (total * (in_hub + F.expr(f"{FOLDED} + least(x.lost, y.lost)")) >= need)
        & (total * F.expr(
            "x.n_hub - size(x.less) - size(y.less) + size(array_intersect(x.less, y.less))"
            " + size(array_intersect(x.more, y.more))") >= need)
    )


def _possible(ids: DataFrame):
    """Filter for ids: a bitmap of fixed size, so it can be broadcast. False hits are possible
    and removed by the join behind it."""
    # Spark's functions number bits from 1 and make one bitmap of 4 KB per bucket, first bit lowest
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)) + 1
    lines = ids.groupBy((F.bitmap_bucket_number(bit) - 1).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    ).collect()
    bitmap = np.zeros((FILTER_BITS // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for at, bits in lines:
        bitmap[at] = np.frombuffer(bits, np.uint8)
    bitmap = bitmap.ravel()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return lambda column: hit(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)))


def _shared_rarities(spokes: DataFrame, percent: int) -> DataFrame:
    """hub, item, node and sizes: spokes of a hub that may be linked share one of these rows' items.

    With D(x) for what x and its hub do not share, x and y differ in exactly what D(x) and D(y) do
    not share. So a link needs an overlap: 2 t |D(x) & D(y)| >= G(x) + G(y), where t = 100 + percent
    and G(x) = t |D(x)| - (100 - percent) n(x). It is at least 1 where one of them is not linked
    with the hub. Two sets with an overlap of c share an item of their first |D| - c + 1, in any
    common order; here the rarest of the hub's items come first. The least G of the possible
    partners gives a c that holds for all of them. ``rest`` counts the items from this one on that
    another spoke has too: two sets whose first common item it is share no more.
    """
    total = 100 + percent
    sized = spokes.select(
        "hub", "node", "linked", "n", "n_hub", "fold", "lost", F.size("more").alias("n_more"),
        F.size("less").alias("n_less"), F.concat("more", "less").alias("items"),
    ).withColumn("gap", F.expr(f"{total}L * (n_more + n_less) - {100 - percent} * n"))
    least = sized.groupBy("hub").agg(
        F.min("gap").alias("any_gap"), F.min(F.expr("if(linked, null, gap)")).alias("open_gap")
    ).filter("open_gap is not null")
    sized = sized.join(least, "hub").withColumn("need", F.expr(
        f"greatest(1, ceil((gap + if(linked, open_gap, any_gap)) / {2 * total}))"
    )).withColumn("first", F.expr("n_more + n_less - need + 1")).filter("first > 0")
    items = sized.select("hub", "node", F.explode("items").alias("item"))
    often = items.groupBy("hub", "item").count().filter("count > 1")
    chosen = items.join(often, ["hub", "item"]).groupBy("hub", "node").agg(
        F.array_sort(F.collect_list(F.struct("count", "item"))).alias("order")
    )
    # Items that no other spoke has come first of all; they fill the first places, but join nothing.
    return (
        sized.drop("items").join(chosen, ["hub", "node"])
        .withColumn("places", F.expr("cast(first - (n_more + n_less - size(order)) as int)"))
        .filter("places > 0")
        .select("hub", "node", "linked", "n", "n_hub", "n_more", "n_less", "gap", "fold", "lost",
                F.size("order").alias("shared"),
                F.posexplode(F.slice("order", F.lit(1), F.col("places"))).alias("at", "o"))
        .withColumn("item", F.col("o.item")).withColumn("rest", F.expr("shared - at"))
        .drop("o", "at", "shared")
    )


def _pairs(rare: DataFrame, labels: DataFrame, percent: int, star: bool) -> DataFrame:
    """hub, x, y: pairs with an item in common whose labels differ and whose numbers allow a link.

    As a star, each item's nodes meet the smallest of them only. Else, nodes of another label than
    the smallest meet all nodes: of two labels in an item one is not the smallest's.
    """
    rows = rare.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_item = rows.groupBy("hub", "item").agg(
        F.min("node").alias("centre"), F.min_by("label", "node").alias("main"),
        F.min("label").alias("lowest"), F.max("label").alias("highest"),
    ).filter("lowest < highest").drop("lowest", "highest")
    rows = rows.join(by_item, ["hub", "item"])
    x, y = rows.filter("label <> main").alias("x"), rows.alias("y")
    if star:
        y = rows.filter("node = centre").alias("y")
        once = F.lit(True)
    else:
        once = F.expr("y.label = y.main or x.node < y.node")
    fits = (
        F.expr("not (x.linked and y.linked)")
        & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        & F.expr(f"{100 + percent} * (least(x.n_hub - x.n_less, y.n_hub - y.n_less)"
                 f" + least(x.n_more, y.n_more)) >= {percent} * (x.n + y.n)")
        & F.expr(f"{2 * (100 + percent)}L * least(x.rest, y.rest) >= x.gap + y.gap")
        & F.expr(f"{100 + percent} * (least(x.n_hub - x.n_less, y.n_hub - y.n_less)"
                 f" + {FOLDED} + least(x.lost, y.lost)) >= {percent} * (x.n + y.n)")
    )
    return x.join(
        y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.item") == F.col("y.item"))
        & (F.col("x.label") != F.col("y.label")) & once & fits
    ).select("x.hub", F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()


def _new_links(pairs, spokes, texts, width, percent) -> DataFrame:
    """a, b of the pairs that are linked: by their differences to the hub, then by their texts."""
    sides = spokes.select("hub", "node", "n_hub", "n", "lost", "fold", "more", "less")
    x, y, p = sides.alias("x"), sides.alias("y"), pairs.alias("p")
    likely = (
        p.join(x, (F.col("p.hub") == F.col("x.hub")) & (F.col("p.x") == F.col("x.node")))
        .join(y, (F.col("p.hub") == F.col("y.hub")) & (F.col("p.y") == F.col("y.node")))
        .filter(_may_link(percent))
        .select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).distinct()
    )
    return (
        likely.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInPandas(_confirm(width, percent), "a long, b long")
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    percent: int = 80, bands: int | None = None, rows: int | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links documents whose sets of ``width``-word shingles share at least ``percent`` of their
    union. ``component_id`` is the smallest id reachable over links, null where no linked row has
    one. A null or blank text has no shingles and no links. Rows with the same id are the same
    document; a row without id is linked by its text like any other, and is kept where its group
    has no id. ``bands`` and ``rows`` follow from ``percent`` (``banding``). No cap on buckets or
    pairs.

    Documents with the same words are one node. In each bucket the smallest and the largest node
    are hubs; every other node is compared with both, so a bucket makes two pairs per row. Nodes
    linked with one hub are in one group, whatever the pairs among them. Nodes that their smallest
    hub does not explain are compared with its other nodes where they share rare differences from
    it: first in stars, then, where labels still differ, pair by pair. So each pair of a bucket is
    linked, refuted or joined through others. Links are confirmed on the whole sets of words.
    """
    scratch = Scratch(docs.sparkSession, "near")
    return _members(docs, id_col, text_col, width, percent, scratch, bands, rows).drop("raw", "group")


def _members(docs, id_col, text_col, width, percent, scratch, bands=None, rows=None) -> DataFrame:
    """``near_groups``, the hash of each row's text, and a number of its group that is never null
    where the text has words. It reads the tables "signatures" and "word-classes" of ``scratch``;
    all others there are gone."""
    if bands is None or rows is None:
        bands, rows = banding(percent)
    # Stands for the id of a row without one.
    own = F.coalesce(F.col("doc_id"), F.xxhash64("raw"))
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.unhex(F.md5(F.col(text_col))).alias("raw"),
    )
    signed = scratch.keep(source.withColumn("doc_id", id_text("doc_id")).mapInPandas(
        _sign(width, bands, rows),
        "doc_id string, raw binary, digest binary, n_shingles long, bands array<long>",
    ).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("own", own), "signatures")
    some = signed.filter("n_shingles > 0")
    classes = scratch.keep(
        some.groupBy("digest").agg(
            F.coalesce(F.min("doc_id"), F.min("own")).alias("node"),
            F.min("doc_id").isNotNull().alias("named"),
        ), "word-classes",
    )
    nodes = scratch.keep(some.join(
        classes.select("digest", F.col("node").alias("own")), ["digest", "own"]
    ).dropDuplicates(["own", "digest"]).select(F.col("own").alias("node"), "raw", "bands"), "nodes")
    labels = _linked(source.withColumn("node", own), nodes, width, percent, scratch)
    labels = labels.withColumn("first", F.col("label"))
    if not classes.filter("not named").isEmpty():
        names = labels.join(classes.filter("named").select("node").distinct(), "node").groupBy(
            "label").agg(F.min("node").alias("first"))
        labels = labels.drop("first").join(names, "label", "left")
    members = signed.join(classes, "digest", "left").select(
        "doc_id", "n_shingles", "raw", "named",
        F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node"),
    )
    alone = F.expr("if(coalesce(named, true), node, null)")
    return members.join(labels, "node", "left").select(
        "doc_id", "n_shingles", "raw", F.coalesce("label", "node").alias("group"),
        F.when(F.col("label").isNull(), alone).otherwise(F.col("first")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(
    source: DataFrame, nodes: DataFrame, width: int, percent: int, scratch: Scratch
) -> DataFrame:
    """node, label for every node with a link. Removes ``nodes`` from ``scratch``."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    hubs = scratch.keep(
        buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter("low < high"), "hubs",
    )
    rows = buckets.join(hubs, "key").select("node", F.explode(F.array(
        F.struct(F.col("low").alias("hub"), F.lit(True).alias("low")),
        F.struct(F.col("high").alias("hub"), F.lit(False).alias("low")),
    )).alias("h")).select("node", "h.*").filter("node <> hub")
    spokes = scratch.keep(rows.groupBy("hub", "node").agg(F.max("low").alias("low")), "spokes")
    scratch.drop("hubs")
    some = spokes.select("node").unionByName(spokes.select(F.col("hub").alias("node"))).distinct()
    possible = _possible(some)
    wanted = nodes.select("node", "raw").join(some, "node", "left_semi")
    texts = scratch.keep(
        source.filter(possible(F.col("node"))).join(wanted, ["node", "raw"], "left_semi")
        .dropDuplicates(["node", "raw"]).select("node", "text"), "candidate-texts",
    )
    scratch.drop("nodes")
    spokes = scratch.keep(
        spokes.join(texts, "node")
        .join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
        .select("hub", "node", "low", "hub_text", "text")
        .mapInPandas(_compare(width, percent), COMPARED), "compared",
    )
    scratch.drop("spokes")
    edges = spokes.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = components(edges)
    spokes = spokes.filter("low").drop("low")
    spokes = spokes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rare = scratch.keep(_shared_rarities(spokes, percent), "rarities")
    for star in () if rare.isEmpty() else (True, False):
        pairs = _pairs(rare, labels, percent, star)
        more = scratch.keep(
            _new_links(pairs, spokes, texts, width, percent), "links-star" if star else "links-pairs"
        )
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges)
    scratch.drop("candidate-texts", "compared", "rarities", "links-star", "links-pairs")
    return labels


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document per group.

    Of a group without any id one row stays. Most documents stay, so it is the ids that go which
    are looked up: rows that a filter of them (``_possible``) lets through are not shuffled, only
    those it names are joined with the ids.
    """
    scratch = Scratch(docs.sparkSession, "drop-near")
    bare = F.col("doc_id").isNull()
    members = scratch.keep(
        _members(docs, id_col, text_col, width, percent, scratch)
        .select("doc_id", "kept", *[F.when(bare, F.col(c)).alias(c) for c in ("raw", "group")]), "members",
    )
    scratch.drop("signatures", "word-classes")
    gone = scratch.keep(
        members.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("kept").alias("kept")).filter("not kept").select("id"), "gone",
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.col(text_col))).alias("raw"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    maybe = _possible(gone.select(F.col("id").alias("node")))(F.col("id"))
    named = rows.filter("id is not null")
    nameless = members.filter("doc_id is null and kept")
    texts = nameless.filter("group is not null").groupBy("group").agg(F.min("raw").alias("raw")).select(
        "raw").unionByName(nameless.filter("group is null").select("raw").distinct())
    others = rows.filter("id is null")
    others = others.join(texts, others["raw"].eqNullSafe(texts["raw"]), "left_semi")
    return named.filter(~maybe).select("row.*").unionByName(
        named.filter(maybe).join(gone, "id", "left_anti").select("row.*")
    ).unionByName(others.dropDuplicates(["raw"]).select("row.*"))
