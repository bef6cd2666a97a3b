"""Exact top-k inner products with MaxScore over shards of integer vectors.

A component with its sign is a term: a vector stands in the posting list of (d, +) or
(d, -), and a query's term is the one whose contributions are positive. Within a shard,
terms whose score bounds together stay below the query's k-th best score are not essential:
a vector in no essential list cannot compete. Essential lists are traversed, the other
terms are probed in the order of their bounds while a vector is still competitive. Each
task keeps the best k of its shards, and the tasks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the tasks at once: at 1,000 components 32 MB.
QUERY_BLOCK = 4096
#: Vectors of a shard; terms that are probed in one step.
SHARD_ROWS = 4096
PROBE = 8


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a null vector and for one with
    a null, infinite or undefined component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Best:
    """The best k (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, shard: np.ndarray, names: np.ndarray) -> None:
        top = np.maximum(shard.max(axis=0, initial=0), 0)
        low = np.maximum((-shard).max(axis=0, initial=0), 0)
        for i, q in enumerate(self.queries):
            bound = np.where(q > 0, q * top, -q * low)
            self.found[i] = self._search(shard, names, q, bound, self.found[i], int(self.ids[i]))

    def _search(self, shard, names, q, bound, best, own) -> list[tuple[int, int]]:
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # of the terms from here on
        least = -best[-1][0] if len(best) == self.k else None
        if least is not None and rest[0] < least:
            return best  # no vector of this shard reaches the k-th score
        essential = len(order) if least is None or least <= 0 else int(np.searchsorted(-rest, -least, side="right"))
        if essential < len(order) and least is not None:
            terms = order[:essential]
            rows = np.flatnonzero(((shard[:, terms] * q[terms]) > 0).any(axis=1))
        else:
            rows = np.arange(len(shard))
        score = np.zeros(len(rows), shard.dtype)
        for at in range(0, len(order), PROBE):
            terms = order[at : at + PROBE]
            score = score + shard[np.ix_(rows, terms)] @ q[terms]
            if least is not None and at + PROBE < len(order):
                open_ = score + rest[at + PROBE] >= least
                if not open_.all():
                    rows, score = rows[open_], score[open_]
                    if not len(rows):
                        return best
        open_ = names[rows] != own
        rows, score = rows[open_], score[open_]
        if least is not None:
            open_ = score >= least
            rows, score = rows[open_], score[open_]
        pick = np.lexsort((names[rows], -score))[: self.k]
        return sorted([*best, *((-int(score[j]), int(names[rows[j]])) for j in pick)])[: self.k]


def _matrix(vectors: list) -> np.ndarray:
    """Doubles, which add whole numbers exactly up to 2**53, or else Python integers."""
    m = np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), -1)
    most = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    return m.astype(np.float64) if most * most * max(1, m.shape[1]) < 2**52 else m.astype(object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Both tables have vec_id (long) and vec (array of long). A candidate with the query's
    own vec_id is left out; ties go to the smaller vec_id. Only vectors of the query's
    length are its candidates. Rows with null vec_id or vec take no part; a query without
    candidates has no rows. The queries are taken in blocks of ``QUERY_BLOCK``, one pass
    over all vectors each, so what is sent to a task does not grow with their number.
    """
    vectors = vectors.where("vec_id IS NOT NULL AND vec IS NOT NULL").select("vec_id", "vec", F.size("vec").alias("dim"))
    queries = queries.where("vec_id IS NOT NULL AND vec IS NOT NULL").select("vec_id", "vec", F.size("vec").alias("dim")).distinct()
    result = None
    for dim, n in sorted((r["dim"], r["count"]) for r in queries.groupBy("dim").count().collect()):
        blocks = -(-n // QUERY_BLOCK)
        own = queries.where(F.col("dim") == dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        for block in range(blocks):
            part = own.where(F.col("block") == block).select("vec_id", "vec").toPandas()
            if len(part):
                found = _local_best(vectors.where(F.col("dim") == dim), part, k)
                result = found if result is None else result.unionByName(found)
    schema = "query_id long, vec_id long, score long"
    if result is None:
        result = vectors.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _local_best(vectors: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in queries["vec"]])))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        best = {float: Best(_matrix(list(q)).astype(np.float64), ids, k), object: Best(q.astype(object), ids, k)}
        for part in parts:
            for i in range(0, len(part), SHARD_ROWS):
                some = part.iloc[i : i + SHARD_ROWS]
                shard = _matrix(list(some["vec"]))
                exact = shard.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(1, q.shape[1]) < 2**52
                best[float if exact else object].add(shard if exact else shard.astype(object), some["vec_id"].to_numpy(np.int64))
        rows = [(int(own), name, -score) for b in best.values() for own, found in zip(ids, b.found, strict=True) for score, name in found]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return vectors.select("vec_id", "vec").mapInPandas(search, "query_id long, vec_id long, score long")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top-k of the rows whose vec_id is divisible by ``every`` against all rows."""
    vectors = embeddings.select("vec_id", quantised(F.col("embedding")).alias("vec"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
