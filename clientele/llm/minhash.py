"""Near-duplicate groups with circulant MinHash.

Two permutations make all coordinates of a signature: the first spreads the shingles over
Z(2**32), the second ranks them, and coordinate k ranks them after a circular shift by k.
Bands of coordinates propose links; every link is confirmed by the exact Jaccard similarity
of the full shingle sets. Documents with equal sets are one node, so a group of copies
costs one row. Within a band's bucket each node is first compared with one hub only, the
node that meets most others. What this leaves apart in a bucket is then compared in blocks:
each node outside the bucket's largest component against every member of another
component, so no link between components is lost, whatever the size of a bucket.

A pair with the similarity s shares no band with the probability (1 - s**ROWS)**BANDS:
7e-9 at 0.85, 3e-6 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, frames, mix64, row_of, saved, shingle_set, whole_text
from .components import components

BANDS = 32
ROWS = 5
#: Shingles that are ranked at once, for all coordinates.
PIECE = 1024
#: Nodes of a bucket that one group compares (outside the largest component), with so many others.
BLOCK = 256
CHUNK = 2048


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS coordinates for each set of 64-bit shingles."""
    out = np.full((len(sets), BANDS * ROWS), 2**32 - 1, np.uint32)
    shifts = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        if not parts:
            return
        starts = np.cumsum([0, *map(len, parts[:-1])])
        x = np.concatenate(parts)[None, :] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum.at(out, rows, np.minimum.reduceat(x, starts, axis=1).T)
        rows.clear()
        parts.clear()

    held = 0
    for i, s in enumerate(sets):
        spread = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(spread), PIECE):
            rows.append(i)
            parts.append(spread[at : at + PIECE])
            held += len(parts[-1])
            if held >= PIECE:
                flush()
                held = 0
    flush()
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    c = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), c.shape[:2])
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sign(docs: DataFrame, k: int) -> DataFrame:
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames(parts):
            sets = [shingle_set(t, k) for t in part["text"]]
            keys = band_keys(signatures(sets))
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array, "text_key": part["text_key"].array,
                "n_shingles": np.fromiter(map(len, sets), np.int64, len(sets)),
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [x if len(s) else None for x, s in zip(keys, sets, strict=True)]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("text_key", text_key(F.col("text")))
    return rows.mapInPandas(sign, f"doc_id {id_type}, text_key binary, n_shingles long, set_key binary, bands array<long>")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """No set can be more similar than the smaller size is to the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid and text of the nodes in ``wanted``. Copies meet before the shuffle."""
    need = saved(wanted.distinct().join(nodes.select("nid", "text_key"), "nid"), "near-need")
    texts = docs.select(text_key(whole_text()).alias("text_key"), whole_text().alias("text"))
    texts = texts.groupBy("text_key").agg(F.min("text").alias("text"))
    return saved(texts.join(need, "text_key").select("nid", "text"), "near-texts")


def _confirm(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of nodes a, b whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b")

    def similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, np.ndarray] = {}  # one text is often the partner of many
        for part in frames(parts):
            keep = []
            for a, ta, tb in zip(part["a"], part["text_a"], part["text_b"], strict=True):
                if a not in last:
                    if len(last) >= 64:
                        last.clear()
                    last[a] = shingle_set(ta, k)
                x, y = last[a], shingle_set(tb, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.loc[np.array(keep, bool), ["a", "b"]]

    return saved(both.mapInPandas(similar, "a long, b long"), "near-links")


def _overlaps(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of ``others`` the sizes of its intersections with all ``queries``."""
    shingles = np.concatenate(queries)
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    for other in others:
        first = np.searchsorted(shingles, other, "left")
        n = np.searchsorted(shingles, other, "right") - first
        hits = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield np.bincount(owner[hits], minlength=len(queries))


def _compare_blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the queries and the other rows of each group (bucket, block, chunk)
    whose roots differ."""

    def links(group: list) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(r.text, k) for r in group]
        asking = [i for i, r in enumerate(group) if r.asks]
        size = np.array([len(sets[i]) for i in asking])
        root = np.array([group[i].root for i in asking])
        answering = [i for i, r in enumerate(group) if r.answers]
        for i, both in zip(answering, _overlaps([sets[i] for i in asking], [sets[i] for i in answering]), strict=True):
            near = (100 * both >= percent * (size + len(sets[i]) - both)) & (root != group[i].root)
            for j in np.flatnonzero(near):
                a, b = group[asking[j]].nid, group[i].nid
                yield max(a, b), min(a, b)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (row for part in frames(parts) for row in part.itertuples(index=False))
        for _, group in groupby(stream, lambda r: (r.bucket, r.block, r.chunk)):
            group = list(group)
            if any(r.asks for r in group) and (found := list(links(group))):
                yield pd.DataFrame(found, columns=["a", "b"])

    rows = rows.repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk")
    return saved(rows.mapInPandas(compare, "a long, b long").distinct(), "near-links", small=True)


def _rest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, block, chunk, nid, root, asks, answers): in buckets with more than one
    component, the nodes outside the largest ask all members, in blocks of ``BLOCK`` that
    ask and chunks of ``CHUNK`` that answer."""
    named = members.where("c > 2").join(roots, F.col("nid") == F.col("node"), "left").select(
        "bucket", "nid", F.coalesce("root", "nid").alias("root"))
    named = saved(named, "near-named")
    shares = named.groupBy("bucket", "root").agg(F.count("*").alias("share"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("share", "root")).alias("most"), F.sum("share").alias("all")).where("all > most.share")
    mixed = saved(mixed.select("bucket", F.col("most.root").alias("main"),
                               F.ceil((F.col("all") - F.col("most.share")) / BLOCK).cast("int").alias("blocks"),
                               F.ceil(F.col("all") / CHUNK).cast("int").alias("chunks")), "near-mixed", small=True)
    rows = named.join(mixed, "bucket").withColumns({
        "own": F.col("root") != F.col("main"),
        "own_block": F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"),
        "own_chunk": F.pmod(F.xxhash64("nid", F.lit("chunk")), F.col("chunks")).cast("int")})

    def place(block: Column, chunk: Column, asks: Column, answers: Column) -> Column:
        return F.struct(block.alias("block"), chunk.alias("chunk"), asks.alias("asks"), answers.alias("answers"))

    answers = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: place(
        b, F.col("own_chunk"), F.col("own") & (b == F.col("own_block")), F.lit(True)))
    asks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: place(
        F.col("own_block"), c, F.lit(True), F.lit(False)))
    asks = F.filter(asks, lambda p: F.col("own") & (p["chunk"] != F.col("own_chunk")))
    return rows.select("bucket", "nid", "root", F.explode(F.concat(answers, asks)).alias("p")).select("bucket", "nid", "root", "p.*")


def _nodes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_key, n_shingles, set_key), and set_key with the first
    (none, doc_id, text_key) of the set's component."""
    base = saved(_sign(docs, k), "near-sets")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = saved(base.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(one).alias("first"), F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"),
    ).withColumn("nid", F.monotonically_increasing_id()), "near-nodes")

    rows = nodes.select("nid", "n", F.explode("bands").alias("bucket"))
    full = saved(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "near-buckets")
    members = saved(rows.join(full, "bucket"), "near-members")
    met = saved(members.groupBy("nid").agg(F.sum("c").alias("met")), "near-met")
    ranked = members.join(met, "nid")
    hubs = saved(ranked.groupBy("bucket").agg(F.max(F.struct("met", "nid", "n")).alias("hub")), "near-hubs")
    pairs = members.join(hubs, "bucket").where((F.col("nid") != F.col("hub.nid")) & _sizes_fit("n", "hub.n", percent))
    pairs = saved(pairs.select(F.greatest("nid", "hub.nid").alias("a"), F.least("nid", "hub.nid").alias("b")).distinct(), "near-pairs", small=True)
    # every node of a bucket may be needed again when what is left is compared
    texts = _texts(docs, nodes, members.select("nid"))
    links = _confirm(texts, pairs, k, percent)
    roots = components(links)
    more = _compare_blocks(_rest(members, roots).join(texts, "nid"), k, percent)
    if more.take(1):
        roots = components(links.unionByName(more))

    named = nodes.select("nid", "set_key", "first").join(roots, F.col("nid") == F.col("node"), "left").select(
        "set_key", "first", F.coalesce("root", "nid").alias("root"))
    first = saved(named.groupBy("root").agg(F.min("first").alias("chosen")), "near-first", small=True)
    return base.drop("bands"), saved(named.join(first, "root").select("set_key", "chosen"), "near-classes", small=True)


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A document's set holds its distinct ``k``-word shingles after A-Z become a-z; with fewer
    words its whole word sequence, without words (null, empty or blank texts) nothing, and
    such a row is a component of its own. Rows are linked when 100 * intersection >=
    percent * union. component_id is the smallest doc_id reachable (null only if all are
    null), kept tells whether the row has it; rows that repeat a doc_id share that answer.
    An empty table gives an empty result. Extra columns are ignored.
    """
    base, classes = _nodes(docs.select("doc_id", "text"), k, percent)
    found = base.join(classes, "set_key", "left")
    chosen = F.when(F.col("n_shingles") > 0, F.col("chosen.doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", chosen.alias("component_id"), F.col("doc_id").eqNullSafe(chosen).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component (the
    smallest doc_id, nulls last, then the smallest digest of the text; of wholly repeated
    rows one), and all rows without words."""
    base, classes = _nodes(docs.select("doc_id", "text"), k, percent)

    def key(doc_id: Column, text: Column) -> Column:
        return F.concat(F.hex(text), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))

    stay = classes.select(key(F.col("chosen.doc_id"), F.col("chosen.text_key")).alias("k")).distinct()
    rows = docs.select(row_of(docs).alias("row"), key(F.col("doc_id"), text_key(whole_text())).alias("k"))
    worded = whole_text("row.text").rlike(f"[^{SPACE_CLASS}]")
    hit = rows.where(worded).join(stay, "k", "left_semi")
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("k"))).where("n = 1")
    return hit.select("row.*").unionByName(rows.where(~worded).select("row.*"))
