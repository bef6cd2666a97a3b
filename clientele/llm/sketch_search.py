"""Ranked lexical search with hashed max-sketches.

A term adds weight * impact to a document's score; the impact depends on the document
alone. Every document folds the impacts of all its terms into ``WIDTH`` coordinates, by a
hash of the term, and each coordinate keeps the largest. A query looks up the coordinates
of its terms: the weighted sum is an upper bound of the document's score. For a piece of
documents the bounds of all queries are one matrix product. Each query then scores the
documents of the piece exactly, in the order of falling bounds, until the bound is below
its worst result; ties go on, since a smaller doc_id may still win.

Each task keeps the best of its documents for each query and passes only those on, so
texts are never shuffled. The queries are sent in blocks of bounded size, and each block
reads the documents twice (counts of the corpus, then the search).
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, saved, small_batches, whole_text

#: Coordinates of a sketch.
WIDTH = 1024
#: Documents whose sketches are held at once.
PIECE = 128
#: Characters of query texts, and queries, that are sent to the tasks at once.
BLOCK_CHARS = 1 << 24
BLOCK_QUERIES = 8192

_JOINS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters a-z, digits and characters from U+0080 on, after A-Z become a-z."""
    return text.encode("utf-8", "surrogatepass").translate(_JOINS).split()


def length_unit(n: int, rows: int, total: int) -> int:
    """The document's m: its length relative to the mean one."""
    return 10 + (90 * n * rows) // total


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, rows: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, their terms with repeats, and for each term of ``vocabulary``
    the documents that hold it. Each task counts on its own first."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, total, held = 0, 0, Counter()
        for part in parts:
            for text in part["text"]:
                found = terms(text)
                rows += bool(found)
                total += len(found)
                held.update(sent.value.intersection(found))
        yield pd.DataFrame({"kind": ["rows", "total", *["term"] * len(held)], "term": [b"", b"", *held], "n": [rows, total, *held.values()]})

    # one row for each term of the block at most
    found = docs.select("text").mapInPandas(count, "kind string, term binary, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()
    numbers = {r["kind"]: r["n"] for r in found if r["kind"] != "term"}
    return numbers.get("rows", 0), numbers.get("total", 0), {bytes(r["term"]): r["n"] for r in found if r["kind"] == "term"}


class Sketches:
    """Sketches and term counts of a piece of documents."""

    def __init__(self, texts: list[str], rows: int, total: int, width: int = WIDTH):
        h = xxhash.xxh3_64_intdigest
        self.counts: list[dict[bytes, int]] = []
        self.unit: list[int] = []
        table = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            held = Counter(terms(text))
            n = held.total()
            m = length_unit(n, rows, total) if n else 0
            self.counts.append(held)
            self.unit.append(m)
            if n:
                tf = np.fromiter(held.values(), np.int64, len(held))
                spot = np.fromiter(map(h, held), np.uint64, len(held)) % np.uint64(width)
                np.maximum.at(table[i], spot.astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 8 * m))
        self.table = table


class Searcher:
    """Results of a task: for each query the best (-score, doc) so far."""

    def __init__(self, queries: list[dict[bytes, int]], k: int, width: int = WIDTH):
        self.queries, self.k = queries, k
        h = xxhash.xxh3_64_intdigest
        self.lookup = np.zeros((len(queries), width))
        for i, q in enumerate(queries):
            for t, w in q.items():
                self.lookup[i, h(t) % width] += w
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.scored = 0

    def add(self, sketches: Sketches, names: list) -> None:
        """``names``: (doc_id is null, doc_id) of the documents, which decide ties."""
        # whole numbers below 2**53: the sums are exact in doubles
        bounds = self.lookup @ sketches.table.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        for i, q in enumerate(self.queries):
            best, row = self.best[i], bounds[i]
            for j in order[i]:
                if row[j] <= 0 or (len(best) == self.k and row[j] < -best[-1][0]):
                    break
                held, m = sketches.counts[j], sketches.unit[j]
                self.scored += 1
                score = 0
                for t in held.keys() & q.keys() if len(held) < len(q) else [t for t in q if t in held]:
                    score += q[t] * impact(held[t], m)
                if score > 0:
                    bisect.insort(best, (-score, names[j]))
                    del best[self.k :]


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (item_id, text), bounded by their characters and their number. Rows of one
    item_id follow each other and are in one block."""
    held, size, last = [], 0, object()
    for r in items.select("item_id", whole_text().alias("text")).orderBy("item_id", "text").toLocalIterator():
        if r["item_id"] != last and (size > BLOCK_CHARS or len(held) >= BLOCK_QUERIES):
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        last = r["item_id"]
    if held:
        yield held


def _search_block(docs: DataFrame, asked: dict, k: int, width: int) -> DataFrame:
    spark = docs.sparkSession
    rows, total, df = corpus_counts(docs, set().union(*asked.values()))
    ids = list(asked)
    queries = [{t: weight(df[t], rows) for t in asked[i] if t in df} for i in ids]
    sent = spark.sparkContext.broadcast(queries)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(sent.value, k, width)
        for part in parts:
            for piece in pieces(iter([part])):
                for at in range(0, len(piece), PIECE):
                    some = piece.iloc[at : at + PIECE]
                    names = [(True, 0) if null else (False, name) for name, null in zip(some["doc_id"], some["none"], strict=True)]
                    searcher.add(Sketches(list(some["text"]), rows, total, width), names)
        found = [(q, None if null else int(name), -s) for q, best in enumerate(searcher.best) for s, (null, name) in best]
        out = pd.DataFrame(found, columns=["query", "doc_id", "score"])
        yield out.astype({"query": "int32", "doc_id": "Int64", "score": "int64"})

    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    local = text.mapInPandas(search, "query int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(ids)), "query int, item_id long")
    return saved(local, "sketch-best").join(F.broadcast(names), "query").drop("query")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item with a
    score above 0, equal scores by ascending doc_id (nulls last).

    An item's terms are the distinct terms of all rows with its item_id (nulls together);
    an item without terms, or none that a document holds, has no rows. Every row of ``docs``
    is a document of its own: repeated rows are ranked side by side. Null texts have no
    terms and no rank; whole texts count, very long ones too. Empty tables give an empty
    result, and extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", whole_text().alias("text"))
    result = None
    for block in _blocks(items):
        asked: dict = {}
        for item, text in block:
            asked.setdefault(item, set()).update(terms(text))
        found = _search_block(docs, asked, k, width)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
