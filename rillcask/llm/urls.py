"""URL filters: rules and listed URLs behind a blocked Bloom filter and an exact join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

BLOCKS = 1 << 18  # of 8 words of 32 bits: 8 MB, whatever the length of the list
WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased. Path: then up to
    ? or #. Both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _slots(key: Column) -> list[Column]:
    """Block of a key and its bit in each of the block's words."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int").alias("block"), *[
        F.pmod(F.shiftright(bits, 5 * i), F.lit(32)).cast("int").alias(f"bit{i}") for i in range(WORDS)
    ]]


def bloom(keys: DataFrame):
    """Test of membership for ``keys.key``: never misses, sometimes hits in vain.

    The filter has a fixed size, so it can be broadcast for a list of any length; a longer list
    only raises the share of vain hits, which the exact join removes.
    """
    lines = keys.select(*_slots(F.col("key"))).groupBy("block").agg(*[
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"bit{i}"))).alias(f"w{i}")
        for i in range(WORDS)
    ]).toPandas()
    blocks = np.zeros((BLOCKS, WORDS), np.uint32)
    for i in range(WORDS):
        blocks[lines["block"], i] = lines[f"w{i}"].to_numpy().astype(np.uint32)
    shared = keys.sparkSession.sparkContext.broadcast(blocks)

    @F.pandas_udf("boolean")
    def hit(*columns: pd.Series) -> pd.Series:
        at, *bits = [c.to_numpy() for c in columns]
        lines = shared.value[at]
        ok = np.ones(len(at), bool)
        for i, b in enumerate(bits):
            ok &= (lines[:, i] >> b.astype(np.uint32)) & 1 == 1
        return pd.Series(ok)

    return lambda key: hit(*_slots(key))


def _key(kind: str, host: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), host, F.lit(" "), path)


def url_verdicts(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains where the path starts
    with the rule's; the longest wins, among equals "block", then the smaller host. ``listed``
    (host, path): canonical URLs that are blocked where no rule fits; all others are allowed. A
    null url, or one without ``://``, has empty host and path; the empty host fits no rule.

    Every different (host, path) asks for the suffixes and prefixes that some rule has the shape
    of, and for itself. The filter stops nearly all of these keys; those it lets pass are joined
    with the exact keys. The verdicts per (host, path) are then joined back to the pages.
    """
    host, path = host_and_path(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").distinct()
    shapes = sorted({(r["labels"], r["size"]) for r in rules.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size")
    ).distinct().collect()})
    entries = stored(rules.select(
        _key("rule", F.col("host"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict",
    ).unionByName(listed.filter("host <> ''").distinct().select(
        _key("page", F.col("host"), F.col("path")).alias("key"),
        F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"),
    )), "url-entries")
    labels = F.size(F.split("host", r"\."))
    asked = [F.when(F.col("host") != "", _key("page", F.col("host"), F.col("path")))]
    for n, size in shapes:
        fits = (F.col("host") != "") & (labels >= n) & (F.length("path") >= size)
        asked.append(F.when(fits, _key(
            "rule", F.substring_index("host", ".", -n), F.substring("path", 1, size)
        )))
    hit = bloom(entries)
    tries = pages.select("host", "path").distinct().select(
        "host", "path", F.explode(F.array_compact(F.array(*asked))).alias("key")
    ).filter(hit(F.col("key")))
    rank = F.struct(
        F.col("rule").isNotNull().alias("a"), F.coalesce(F.length("rule"), F.lit(0)).alias("b"),
        (F.col("verdict") == "block").alias("c"),
    )
    found = tries.join(entries, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), rank).alias("best")
    )
    found = stored(found.select(
        F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict"
    ), "url-verdicts")
    return pages.join(
        found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left"
    ).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def repeated(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs (host, path) that more than one page carries: already crawled."""
    host, path = host_and_path(F.col(url_col))
    return pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").count().filter(
        "count > 1"
    ).select("host", "path")
