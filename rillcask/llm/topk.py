"""Exact top-k by integer inner product with MaxScore bounds, shard by shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES = 2048, 1024  # vectors and queries held by one task
PROBE = 8  # terms probed between two cuts of the candidates
LONG = np.iinfo(np.int64)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Integer rows, short vectors padded with 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def maxscore(ids: np.ndarray, docs: np.ndarray, query: np.ndarray, own: int, k: int):
    """Rows and scores of the k best documents of a shard (ties to the smaller id).

    Terms are dimensions. A term's impact is shifted by its least contribution in the shard, so
    it lies between 0 and a bound. Terms are ranked by bound; those whose bounds together cannot
    lift a document to the k-th best score are non-essential. Essential terms are traversed for
    all documents; then the others are probed, only for documents that can still compete.
    ``docs`` is (terms, documents) and sorted by id.
    """
    low, high = docs.min(1), docs.max(1)
    ends = np.stack([query * low, query * high])
    least, most = ends.min(0), ends.max(0)
    order = np.argsort(least - most, kind="stable")
    zero = most[:1] * 0
    absent = np.r_[zero, np.cumsum(least[order])]  # a document in none of the first lists
    rest = np.r_[np.cumsum(most[order][::-1])[::-1], zero]  # the best all later lists can add
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return alive, alive
    first = order[:PROBE]
    part = query[first] @ docs[first]
    best = alive[np.argsort(-part[alive], kind="stable")[:k]]
    bar = min(query @ docs[:, best]) if len(best) == k else None
    weak = absent + rest < bar if bar is not None else np.zeros(len(rest), bool)
    essential = int(np.argmax(weak)) if weak.any() else len(order)
    done = max(min(PROBE, len(order)), essential)
    more = order[PROBE:done]
    part = (part + query[more] @ docs[more] if len(more) else part)[alive]
    while done < len(order):
        if bar is not None:
            keep = part + rest[done] >= bar
            alive, part = alive[keep], part[keep]
        more = order[done : done + PROBE]
        part = part + query[more] @ docs[np.ix_(more, alive)]
        done += len(more)
    top = np.lexsort((ids[alive], -part))[:k]
    return alive[top], part[top]


def _search(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            width = max(1, *(len(v) for v in left["ints"]), *(len(v) for v in right["ints"]))
            docs = _matrix(list(left["ints"]), width)
            queries = _matrix(list(right["ints"]), width)
            # Sums below 2^53 are exact in doubles; larger ones use whole numbers of any size.
            top = float(np.abs(docs.astype(float)).max()) * float(np.abs(queries.astype(float)).max())
            kind = np.float64 if top * width * 4 < 2.0**53 else object
            docs, queries = np.ascontiguousarray(docs.T).astype(kind), queries.astype(kind)
            ids = left["vec_id"].to_numpy()
            for own, query in zip(right["query_id"], queries):
                rows, scores = maxscore(ids, docs, query, own, k)
                out["query_id"] += [own] * len(rows)
                out["vec_id"] += ids[rows].tolist()
                out["score"] += [int(min(max(s, LONG.min), LONG.max)) for s in scores]
        return pd.DataFrame({n: pd.Series(v, dtype="int64") for n, v in out.items()})

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
    vector_col: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query, its own id left out.

    Score: inner product of floor(scale * x), held in the range of a long. Rows without id, and
    vectors that are null or hold a null or non-finite component, take no part; a shorter vector
    counts as padded with 0, an empty one scores 0. Ties go to the smaller id; rows that repeat
    an id are separate candidates; a query id given twice counts once, with its smallest vector.
    Fewer than k candidates give fewer rows.

    Vectors are dealt into shards and queries into blocks; a task holds one shard and one block.
    Shard results are merged by rank, of which Spark keeps k rows per task before the shuffle.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col(id_col).cast("long").alias(name), scaled(F.col(vector_col), scale).alias("ints")
        ).filter(f"{name} is not null and ints is not null")

    docs, asked = numbered(vectors, "vec_id"), numbered(queries, "query_id")
    asked = asked.groupBy("query_id").agg(F.min("ints").alias("ints"))
    n_docs = vectors.select(F.count(id_col)).first()[0]
    n_queries = queries.select(F.count(id_col)).first()[0]
    shards = max(1, -(-n_docs // shard_rows))
    blocks = max(1, -(-n_queries // block_queries))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    docs = docs.withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(shards)).cast("int")
    ).withColumn("block", every(blocks))
    asked = asked.withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    ).withColumn("shard", every(shards))
    found = docs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
