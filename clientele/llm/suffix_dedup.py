"""Repeated passages with a sparse suffix array.

Suffixes are kept at minimiser positions only: in every ``WINDOW`` consecutive ``GRAM``-word
grams the one with the smallest hash. The choice depends on nothing but these words, so two
documents that share a passage of ``WINDOW + GRAM - 1`` words keep the same suffixes of it.
Suffixes whose first gram occurs in one document only are dropped. The others are of two
kinds, and a match of ``MIN_WORDS`` words or more is reported for both:

* A first gram of ``NEIGHBOURS + 1`` suffixes or fewer: these are sorted over the cluster by
  range, by their next ``RIGHT`` words and then by the ``LEFT`` words before them, read
  backwards. All suffixes of one gram lie in one range, each is compared with all others of
  its gram, and each match is extended to the right and to the left.
* A gram of more suffixes: any of thousands of rows may share more on the left, so they are
  met by equal keys in place of an order. A match of ``MIN_WORDS`` words around a suffix has
  a split into ``r`` words from it on and ``MIN_WORDS - r`` words before it, for some ``r``
  from ``GRAM`` on; documents with an equal split are found with a group per split. Bands of
  splits that no two documents can share are dropped first, by the words that all splits of
  the band have in common.

Longer passages are covered by the matches of the suffixes inside them, which overlap and
are merged.

Documents with equal texts share one set of suffixes: the whole text of each is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, saved, whole_text

MIN_WORDS = 50
GRAM = 8
WINDOW = 40
#: Words of a suffix that are sorted and compared, and words before it. A passage of 50
#: words has its first suffix at most 39 words behind its start, and its last one reaches
#: back 42 words if it has only 8 left.
RIGHT = 56
LEFT = 44
#: Bytes of a word's hash in a sort key (all zero: no word there).
BYTES = 3
#: Suffixes of one sorted range.
RANGE_ROWS = 20_000
#: Suffixes of one gram, besides its own, with which a suffix is compared one by one.
NEIGHBOURS = 8
#: Words before a suffix that its splits use, and how many splits one band has.
BEFORE = MIN_WORDS - GRAM
BAND = 7


def words_of(text: str) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").split()
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in found), np.uint64, len(found))


def suffix_starts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes and the hashes of their first grams. Documents under
    MIN_WORDS words have none."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words) - GRAM + 1
    gram = np.zeros(n, np.uint64)
    for i in range(GRAM):
        gram = mix64(gram * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    views = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)
    here = np.arange(len(views))
    at = np.unique(here + views.argmin(axis=1))
    if len(np.unique(gram)) < n:
        at = _thinned(gram, here + WINDOW - 1 - views[:, ::-1].argmin(axis=1))
    return at, gram[at]


def _thinned(gram: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimisers where a gram repeats: a choice is kept as long as it is in the window and
    no gram there is smaller, so that repeated words don't make every position a choice.
    ``last`` has the last smallest gram of each window."""
    least, at, i = gram[last], [], 0
    while i < len(last):
        at.append(int(last[i]))
        ahead = least[i + 1 : at[-1] + 1]
        smaller = np.flatnonzero(ahead < gram[at[-1]])
        i += 1 + (int(smaller[0]) if len(smaller) else len(ahead))
    return np.array(at, np.int64)


def sort_keys(words: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The words from each position on and the words before it, backwards."""
    short = np.zeros((len(words) + LEFT + RIGHT, BYTES), np.uint8)
    own = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :BYTES].copy()
    own[~own.any(axis=1), 0] = 1
    short[LEFT : LEFT + len(words)] = own
    order = np.concatenate([np.arange(RIGHT), -1 - np.arange(LEFT)])
    keys = short[at[:, None] + LEFT + order]
    return [k.tobytes() for k in keys]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words in which rows of (n, words, BYTES) agree."""
    differ = (a != b).any(axis=2) | ~a.any(axis=2)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def neighbour_matches(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    """Matches of sorted suffixes with the nearest ones of the same gram on each side."""
    words = key.reshape(len(key), RIGHT + LEFT, BYTES)
    gram = np.concatenate([[0], np.cumsum((words[1:, :GRAM] != words[:-1, :GRAM]).any(axis=(1, 2)))])
    out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("nid", "first", "last", "other")})]
    for step in range(1, NEIGHBOURS + 1):
        pairs = np.flatnonzero((gram[step:] == gram[:-step]) & (doc[step:] != doc[:-step]))
        for at in range(0, len(pairs), 4096):
            i = pairs[at : at + 4096]
            right = _common(words[i, :RIGHT], words[i + step, :RIGHT])
            left = _common(words[i, RIGHT:], words[i + step, RIGHT:])
            long = right + left >= MIN_WORDS
            for own, other in ((i, i + step), (i + step, i)):
                out.append(pd.DataFrame({"nid": doc[own][long], "first": (pos[own] - left)[long],
                                         "last": (pos[own] + right)[long], "other": doc[other][long]}))
    return merged(pd.concat(out))


def merged(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans of a document that touch or overlap become one; one partner is enough for it."""
    spans = spans.sort_values(["nid", "first"], ignore_index=True)
    if not len(spans):
        return spans
    nid, first, last = (spans[c].to_numpy(np.int64) for c in ("nid", "first", "last"))
    new = np.concatenate([[True], nid[1:] != nid[:-1]])
    lift = np.cumsum(new) * (last.max() + 1)  # documents don't reach into each other
    reach = np.maximum.accumulate(last + lift)
    opens = np.flatnonzero(np.concatenate([[True], (first + lift)[1:] > reach[:-1]]))
    ends = np.concatenate([opens[1:], [len(spans)]]) - 1
    return pd.DataFrame({"nid": nid[opens], "first": first[opens], "last": (reach - lift)[ends], "other": spans["other"].to_numpy(np.int64)[opens]})


_MATCH = "nid long, first long, last long, other long"


def _match_range(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches inside one sorted range."""
    rows = pd.concat(list(parts) or [pd.DataFrame({"nid": [], "pos": [], "key": []})], ignore_index=True)
    if len(rows):
        key = np.frombuffer(b"".join(rows["key"]), np.uint8).reshape(len(rows), -1)
        yield neighbour_matches(rows["nid"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64), key)


def _split_key(right: str, left: str) -> Column:
    """The first ``right`` words from a suffix on and ``left`` words before it."""
    words = F.concat(F.expr(f"substring(around, 1, ({right}) * {BYTES})"),
                     F.expr(f"substring(around, {MIN_WORDS * BYTES + 1}, ({left}) * {BYTES})"))
    return F.unhex(F.md5(words))


def _met(keyed: DataFrame, tag: str) -> DataFrame:
    """The rows of ``keyed`` (place, r, split, lo, hi) whose split is in two documents, with
    the least and the greatest of these documents."""
    groups = keyed.groupBy("r", "split").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return keyed.drop("lo", "hi").join(saved(groups, tag), ["r", "split"])


def split_matches(rows: DataFrame) -> DataFrame:
    """nid, first, last, other: matches of suffixes (nid, pos, key, n_left, n_right) with any
    number of others of the same gram. Equal surroundings are one place, found once."""
    around = F.concat(F.expr(f"substring(key, 1, {MIN_WORDS * BYTES})"), F.expr(f"substring(key, {RIGHT * BYTES + 1}, {BEFORE * BYTES})"))
    rows = rows.withColumn("around", around).withColumn("place", F.unhex(F.md5("around")))
    places = saved(rows.groupBy("place").agg(
        F.min("nid").alias("lo"), F.max("nid").alias("hi"), F.first("around").alias("around"),
        F.least(F.first("n_left"), F.lit(BEFORE)).alias("n_left"), F.least(F.first("n_right"), F.lit(MIN_WORDS)).alias("n_right"),
    ).where(f"n_left + n_right >= {MIN_WORDS}"), "suffix-places")
    bands = [(r, min(r + BAND - 1, MIN_WORDS)) for r in range(GRAM, MIN_WORDS + 1, BAND)]
    band = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(top).alias("top")) for r, top in bands]))
    wide = places.select("*", band.alias("b")).select("*", "b.r", "b.top").where(f"r <= n_right AND {MIN_WORDS} - top <= n_left")
    wide = wide.select("place", "r", "top", _split_key("r", f"{MIN_WORDS} - top").alias("split"), "lo", "hi")
    kept = _met(wide, "suffix-bands").groupBy("place").agg(F.collect_list(F.struct("r", "top")).alias("bands"))
    one = places.join(saved(kept, "suffix-kept"), "place").withColumn("b", F.explode("bands"))
    one = one.withColumn("r", F.explode(F.sequence("b.r", "b.top"))).where(f"r <= n_right AND {MIN_WORDS} - r <= n_left")
    one = saved(one.select("place", "r", _split_key("r", f"{MIN_WORDS} - r").alias("split"), "lo", "hi"), "suffix-splits")
    reach = _met(one, "suffix-met").groupBy("place").agg(
        (MIN_WORDS - F.min("r")).alias("left"), F.max("r").alias("right"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = rows.select("nid", "pos", "place").join(saved(reach, "suffix-reach"), "place")
    return found.select("nid", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"),
                        F.when(F.col("lo") != F.col("nid"), F.col("lo")).otherwise(F.col("hi")).alias("other"))


def _documents(docs: DataFrame) -> DataFrame:
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            words = [words_of(t) for t in part["text"]]
            found = [suffix_starts(w) for w in words]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "text_key": part["text_key"].array, "n_words": [len(w) for w in words],
                                "pos": [p for p, _ in found], "gram": [g.view(np.int64) for _, g in found]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.unhex(F.md5(whole_text())).alias("text_key"), whole_text().alias("text"))
    return saved(rows.mapInPandas(read, f"doc_id {id_type}, text_key binary, n_words long, pos array<long>, gram array<long>"), "suffix-docs")


def _matches(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nid, first, last, other: matches of two different texts."""
    starts = nodes.select("nid", F.explode(F.arrays_zip("pos", "gram")).alias("s")).select("nid", "s.pos", "s.gram")
    shared = starts.groupBy("gram").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"), (F.count("*") > NEIGHBOURS + 1).alias("often"))
    shared = saved(shared.where("lo < hi").select("gram", "often"), "suffix-grams")
    hits = saved(starts.join(shared, "gram").select("nid", "pos", "often"), "suffix-hits")
    want = hits.groupBy("nid").agg(F.collect_list(F.struct("pos", "often")).alias("hits"))  # of one document
    want = want.select("nid", F.col("hits.pos").alias("pos"), F.col("hits.often").alias("often"))
    want = saved(want.join(nodes.select("nid", "text_key"), "nid"), "suffix-wanted")
    texts = docs.select(F.unhex(F.md5(whole_text())).alias("text_key"), whole_text().alias("text"))
    texts = texts.groupBy("text_key").agg(F.min("text").alias("text"))  # copies meet before the shuffle

    def suffixes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for nid, at, often, text in zip(part["nid"], part["pos"], part["often"], part["text"], strict=True):
                at, words = np.asarray(at, np.int64), words_of(text)
                yield pd.DataFrame({"nid": nid, "pos": at, "often": np.asarray(often, bool), "key": sort_keys(words, at),
                                    "n_left": np.minimum(at, LEFT), "n_right": np.minimum(len(words) - at, RIGHT)})

    rows = texts.join(want, "text_key").select("nid", "pos", "often", "text")
    rows = saved(rows.mapInPandas(suffixes, "nid long, pos long, often boolean, key binary, n_left int, n_right int"), "suffix-keys")
    ranges = max(1, -(-hits.where("NOT often").count() // RANGE_ROWS))
    few = rows.where("NOT often").select("nid", "pos", "key").withColumn("gram", F.expr(f"substring(key, 1, {GRAM * BYTES})"))
    few = few.repartitionByRange(ranges, "gram").sortWithinPartitions("key", "nid", "pos").drop("gram")
    found = few.mapInPandas(_match_range, _MATCH).unionByName(split_matches(rows.where("often")))
    return saved(found, "suffix-matches")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, last_word (exclusive), n_words, partner_id: the maximal runs of
    words of each document that are repeated in others.

    Words are runs of bytes other than space and 9 to 13, compared exactly. Whole texts are
    read. partner_id is a document in which part of the run occurs too. Documents with
    fewer than MIN_WORDS words (null and empty texts among them) and documents without a
    repeated passage have no rows; a passage that repeats inside one document only doesn't
    count. Rows repeated whole are copies of each other. A null doc_id takes part like any
    other. An empty table gives an empty result. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = _documents(docs)
    nodes = saved(rows.groupBy("text_key").agg(
        F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"), F.count("*").alias("copies"),
        F.first("n_words").alias("n_words"), F.first("pos").alias("pos"), F.first("gram").alias("gram"),
    ).withColumn("nid", F.monotonically_increasing_id()), "suffix-nodes")
    matches = _matches(docs, nodes)
    others = nodes.select(F.col("nid").alias("other"), F.col("least_id").alias("partner"))
    spans = matches.join(others, "other").select("nid", "first", "last", "partner")
    whole = nodes.where(f"copies > 1 AND n_words >= {MIN_WORDS}").select(
        "nid", F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last"), F.lit(None).cast(nodes.schema["least_id"].dataType).alias("partner"))
    spans = spans.unionByName(whole)
    # runs that touch or overlap become one; all spans of a document are bounded by its text
    order = Window.partitionBy("nid").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("nid", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.min("partner").alias("partner"))
    runs = saved(runs.join(nodes.select("nid", "text_key", "least_id", "most_id", "copies"), "nid"), "suffix-runs", small=True)
    twin = F.when(F.col("copies") > 1, F.when(F.col("doc_id") == F.col("least_id"), F.col("most_id")).otherwise(F.col("least_id")))
    return rows.select("doc_id", "text_key").join(runs, "text_key").select(
        "doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("n_words"),
        F.coalesce(twin, "partner").alias("partner_id"))
