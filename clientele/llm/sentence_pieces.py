"""SentencePiece encoding and decoding with a relational lattice.

A text is cut where no piece of the vocabulary can lie across: in front of the marks that
stand for spaces, and between letters and other characters. What lies between two cuts is a
word of the lattice, and the best segmentation of a text is that of its words. Each word of
the corpus is segmented once: its substrings
up to the longest piece's length are exploded and equi-joined to the piece table (the table
of a tokenizer: small, its size is checked), the matches are the edges of the word's
lattice, grouped by word, and a fold with ``aggregate`` finds the path with the largest sum
of scores (Viterbi). Characters without a piece become byte pieces.

Texts are split once, into frames: a list of the frame's different words, and the texts as
numbers of that list, frequent words first, compressed. The lists are dealt out by a hash of
their words (the bucket), so that equal words meet, are segmented and answer all the lists
that hold them, without another shuffle. Frames are saved in buckets of their keys, and the
answers of a frame are brought to it, so that the numbers of the texts are never shuffled;
there the numbers are replaced by the pieces.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frames, pieces, saved_in_buckets, small_batches, whole_text

#: The visible mark that stands for a space.
MARK = "▁"
#: Different words, and words in all, of a frame; it ends with the text that brings more.
FREQUENT = 1 << 19
FRAME_WORDS = 1 << 23
#: Pieces that a table may have to be broadcast.
MOST_PIECES = 1 << 20
#: Most buckets of words.
BUCKETS = 4096
#: Most buckets of frames.
MOST_FILES = 1 << 16
#: Characters of a word in one fold; a longer word is folded in such blocks.
FOLD = 256


@dataclass
class Pieces:
    """A SentencePiece vocabulary: text pieces with id and score, and the ids of byte pieces."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown_id: int

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - 10.0

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]


def load(path: str) -> Pieces:
    """Read a model file. Its normalizer must be the identity with a space in front."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces are too many to broadcast")
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in range(n) if not skip(i)]
    found = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    return Pieces(pieces, [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else [], model.unk_id())


def word_pattern(vocabulary: Pieces) -> str:
    """The finest pattern of words that leaves every piece whole.

    Words are marks followed by letters or by other characters. Letters that some piece has
    beside another character (such as a raised 2) count as other characters. A vocabulary
    whose pieces this cuts is split at marks only, or not at all.
    """
    many = [p for p, _, _ in vocabulary.pieces if len(p) > 1]
    letter = re.compile(r"[^\W\d_]")
    odd = {c for p in many for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b)
           and bool(letter.match(a)) != bool(letter.match(b)) for c in (a, b) if letter.match(c)}
    own = re.escape("".join(sorted(odd)))
    for pattern in (rf"{MARK}*(?:[^\W\d_{own}]+|(?:[^\w{MARK}]|[\d_{own}])+)|{MARK}+", rf"{MARK}*[^{MARK}]+|{MARK}+"):
        if all(re.fullmatch(pattern, p) and len(re.findall(pattern, p)) == 1 for p in many):
            return pattern
    return r"(?s).+"


def splitter(vocabulary: Pieces) -> Callable[[str], list[str]]:
    """A function that cuts a text into words. An empty text has none; any other begins with
    the mark of a space."""
    pattern = re.compile(word_pattern(vocabulary))
    return lambda text: pattern.findall(MARK + text.replace(" ", MARK)) if text else []


def edges(words: DataFrame, vocabulary: Pieces) -> DataFrame:
    """The lattice: for each word (word, length) its substrings that are pieces, and for
    each character that is no piece itself an edge.

    Rows are wid (a number of the word), the columns of ``words``, begin, end, score and code (the
    piece's id; -1 - begin for a character); those of a word arise by end and begin. A word
    is cut into overlapping blocks first, of which its substrings are taken."""
    spark = words.sparkSession
    table = spark.createDataFrame(vocabulary.pieces, "piece string, id int, score double")
    ahead = vocabulary.longest - 1
    span = words.withColumn("wid", F.monotonically_increasing_id())
    span = span.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(FOLD))))
    span = span.withColumn("skipped", F.greatest(F.col("from") - ahead, F.lit(0)))
    span = span.withColumn("block", F.substring("word", F.col("skipped") + 1, F.lit(FOLD + ahead)))
    span = span.withColumn("end", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + FOLD, F.col("length")))))
    span = span.withColumn("begin", F.explode(F.sequence(F.greatest(F.col("end") - vocabulary.longest, F.lit(0)), F.col("end") - 1)))
    span = span.withColumn("piece", F.substring("block", F.col("begin") - F.col("skipped") + 1, F.col("end") - F.col("begin")))
    hit = span.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR end = begin + 1")
    return hit.select("wid", *words.columns, "begin", "end", F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"),
                      F.coalesce("id", -1 - F.col("begin")).alias("code"))


_STATES = "array<struct<score: double, begin: int, code: int>>"


def _entry(score: Column, begin: Column, code: Column) -> Column:
    return F.struct(score.alias("score"), begin.alias("begin"), code.alias("code"))


def _start() -> Column:
    return F.array(_entry(F.lit(0.0), F.lit(-1), F.lit(None).cast("int"))).cast(_STATES)


def _reached(acc: Column, e: Column, skipped: Column | int, reach: Column, new: Column) -> Column:
    """The states of the positions from ``skipped`` on after an edge that may give ``new``."""
    return F.when(F.size(acc) + skipped == e["end"], F.array_append(acc, new)).when(
        reach > F.element_at(acc, -1)["score"], F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), new)).otherwise(acc)


def _step(acc: Column, e: Column, skipped: Column | int) -> Column:
    """The state (best score and last edge of each position from ``skipped`` on) after an edge."""
    reach = F.element_at(acc, e["begin"] - skipped + 1)["score"] + e["score"]
    return _reached(acc, e, skipped, reach, _entry(reach, e["begin"], e["code"]))


def _back(acc: Column, s: Column) -> Column:
    """One position of the way back: the edge that ends there is taken if the path is there."""
    taken = F.array_append(acc["taken"], s["code"])
    return F.when(acc["at"] == s["at"], F.struct(s["begin"].alias("at"), taken.alias("taken"))).otherwise(acc)


def _placed(states: Column, offset: Column | int) -> Column:
    return F.reverse(F.transform(states, lambda s, i: F.struct(
        (i + 1 + offset).cast("int").alias("at"), s["begin"].alias("begin"), s["code"].alias("code"))))


def best_path(edge_list: Column) -> Column:
    """Codes of the edges of the path with the largest sum of scores; of equal sums the
    one whose last piece begins first. ``edge_list`` is ordered by end and begin."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))

    def step(acc: Column, e: Column) -> Column:
        """A short word's states hold the whole path to a position, which saves the way back."""
        near = F.element_at(acc, e["begin"] + 1)
        reach = near["score"] + e["score"]
        return _reached(acc, e, 0, reach, F.struct(reach.alias("score"), F.array_append(near["path"], e["code"]).alias("path")))

    return F.element_at(F.aggregate(edge_list, start.cast("array<struct<score: double, path: array<int>>>"), step), -1)["path"]


def best_path_in_blocks(blocks: Column, length: Column, longest: int) -> Column:
    """As :func:`best_path` for edges in blocks of ``FOLD`` positions (by their ends, in
    order). A block carries on no more than the ``longest`` positions in front of it."""
    begun = F.struct(F.lit(0).alias("at"), _start().alias("near"), F.array().cast(f"array<{_STATES}>").alias("done"))

    def block(acc: Column, edge_list: Column) -> Column:
        skipped = acc["at"] + 1 - F.size(acc["near"])
        after = F.aggregate(edge_list, acc["near"], lambda a, e: _step(a, e, skipped))
        own = F.slice(after, F.size(acc["near"]) + 1, F.lit(FOLD))
        return F.struct((acc["at"] + FOLD).alias("at"), F.slice(after, F.greatest(F.size(after) - longest + 1, F.lit(1)), F.lit(longest)).alias("near"),
                        F.concat(acc["done"], F.array(own)).alias("done"))

    done = F.aggregate(blocks, begun, block)["done"]
    numbered = F.reverse(F.transform(done, lambda own, i: F.struct(own.alias("own"), (i * FOLD).cast("int").alias("offset"))))
    back = F.struct(length.cast("int").alias("at"), F.array().cast("array<array<int>>").alias("taken"))

    def block_back(acc: Column, b: Column) -> Column:
        inner = F.aggregate(_placed(b["own"], b["offset"]), F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("taken")), _back)
        return F.struct(inner["at"].alias("at"), F.concat(acc["taken"], F.array(inner["taken"])).alias("taken"))

    return F.reverse(F.flatten(F.aggregate(numbered, back, block_back)["taken"]))


def _ids(path: Column, word: Column, vocabulary: Pieces) -> Column:
    """The ids of a path (codes): those of its pieces, and the byte pieces of its other characters."""
    if vocabulary.byte_ids:
        code = F.array(*[F.lit(i) for i in vocabulary.byte_ids])

        def spelled(c: Column) -> Column:
            hexed = F.hex(F.substring(word, -c, F.lit(1)).cast("binary"))
            return F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda i: F.element_at(
                code, F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int") + 1))
    else:
        def spelled(c: Column) -> Column:
            return F.array(F.lit(vocabulary.unknown_id))

    return _bound(path, lambda codes: F.when(F.array_min(codes) >= 0, codes).otherwise(
        F.flatten(F.transform(codes, lambda c: F.when(c >= 0, F.array(c)).otherwise(spelled(c))))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for all its uses in a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def encode_words(words: DataFrame, vocabulary: Pieces) -> DataFrame:
    """The columns of ``words`` (word, length and others) without length, and ids.

    Words that are partitioned by some of their columns stay so, and the edges of a word are grouped where they arise, in
    the order in which they arise (which spares the sort most of its work). Words of more than ``FOLD`` characters are folded in
    blocks: an edge ends at every position, which tells where the edges of a block begin."""
    edge = F.struct("end", "begin", "score", "code")
    own = [c for c in words.columns if c != "length"]
    grouped = edges(words, vocabulary).groupBy("wid", *own).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    grouped = grouped.withColumn("length", F.length("word"))
    blocks = _bound(F.col("edges.end"), lambda ends: F.transform(
        F.sequence(F.lit(1), F.col("length"), F.lit(FOLD)), lambda p: F.array_position(ends, p).cast("int")))
    blocks = _bound(blocks, lambda cuts: F.transform(cuts, lambda at, i: F.slice(
        F.col("edges"), at, F.coalesce(F.get(cuts, i + 1), F.size("edges") + 1) - at)))
    path = F.when(F.col("length") <= FOLD, best_path(F.col("edges"))).otherwise(
        best_path_in_blocks(blocks, F.col("length"), vocabulary.longest))
    return grouped.select(*own, _ids(path, F.col("word"), vocabulary).alias("ids"))


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[i] : first[i] + size[i]] for each i, joined, and where each begins."""
    begin = np.cumsum(size) - size
    return values[np.repeat(first - begin, size) + np.arange(int(size.sum()))], begin


def decoder(vocabulary: Pieces) -> Callable[[list[int]], str]:
    """The text of a sequence of ids: pieces as they are, byte pieces as UTF-8 (invalid
    bytes become the replacement character), marks as spaces, without the space in front."""
    said: dict[int, str] = {i: p.replace(MARK, " ") for p, i, _ in vocabulary.pieces}
    said |= {i: chr(b) for b, i in enumerate(vocabulary.byte_ids) if b < 128}
    if not vocabulary.byte_ids:
        said[vocabulary.unknown_id] = " ⁇ "
    high = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids) if b >= 128}

    def decode(ids: list[int]) -> str:
        try:
            text = "".join(map(said.__getitem__, ids))
        except KeyError:  # bytes of longer characters, or ids without a text
            data = b"".join([high[i] if i in high else said.get(i, "").encode("utf-8", "surrogatepass") for i in ids])
            try:
                text = data.decode("utf-8", "surrogatepass")
            except UnicodeDecodeError:
                text = data.decode("utf-8", "replace")
        return text.removeprefix(" ")

    return decode


def piece_bytes(vocabulary: Pieces) -> list[bytes]:
    """What each id stands for, by id."""
    said: dict[int, bytes] = {i: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, i, _ in vocabulary.pieces}
    said |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    if not vocabulary.byte_ids:
        said[vocabulary.unknown_id] = " ⁇ ".encode()
    return [said.get(i, b"") for i in range(max(said, default=-1) + 1)]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^24, compressed byte by byte."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, -1)
    out = planes[2].astype(np.int32)
    for p in (planes[1], planes[0]):
        out <<= 8
        out |= p
    return out


def _short(word: str) -> str:
    """A word without its only mark in front; another word gets one more mark."""
    return word[1:] if word[0] == MARK and MARK not in word[1:] else MARK + word


def _frames(rows: DataFrame, vocabulary: Pieces, buckets: int) -> DataFrame:
    """Frames of texts as numbers of their words.

    key, doc_ids, n_words, whole (whether a text's words, with spaces for marks, are the
    text), numbers (of all words, packed, some texts at a time), n_texts (in each of these),
    order (where each number's word stands among the words in order of their buckets,
    packed) and words: for each bucket the key and the frame's words, with spaces between (a
    word has none; the mark that most of them begin with is left out), or null without words."""

    split = splitter(vocabulary)

    def frame(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, total, names, n_words, whole, numbers, n_texts = defaultdict(count().__next__), 0, [], [], [], [], []

        def ended() -> pd.DataFrame:
            found = list(number)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in found), np.int64, len(found))
            by_bucket = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            listed = [_short(found[i]) for i in by_bucket.tolist()]
            key = uuid.uuid4().hex
            words = [f"{key} {' '.join(listed[a:b])}" if a < b else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            by_rank = np.argsort(-sum((np.bincount(c, minlength=len(found)) for c in numbers), np.zeros(len(found), np.int64)), kind="stable")
            rank, place = np.empty(len(found), np.int32), np.empty(len(found), np.int32)
            rank[by_rank], place[by_bucket] = np.arange(len(found)), np.arange(len(found))
            return pd.DataFrame({"key": [key], "doc_ids": [names], "n_words": [n_words], "whole": [whole],
                                 "numbers": [[_packed(rank[c]) for c in numbers]], "n_texts": [n_texts], "order": [_packed(place[by_rank])], "words": [words]})

        for part in pieces(frames(parts)):
            words = [split(t) for t in part["text"]]
            flat = list(chain.from_iterable(words))
            numbers.append(np.fromiter(map(number.__getitem__, flat), np.int32, len(flat)))
            total += len(flat)
            n_texts.append(len(words))
            n_words += map(len, words)
            names += [None if pd.isna(n) else n for n in part["doc_id"]]
            whole += ["".join(w).replace(MARK, " ") == (" " + t if t else "") for w, t in zip(words, part["text"], strict=True)]
            if len(number) >= FREQUENT or total >= FRAME_WORDS:
                yield ended()
                number, total, names, n_words, whole, numbers, n_texts = defaultdict(count().__next__), 0, [], [], [], [], []
        if names:
            yield ended()

    # ids travel as text: a frame with a null among whole numbers would make them doubles
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(frame, "key string, doc_ids array<string>, n_words array<long>, whole array<boolean>, numbers array<binary>, n_texts array<int>, order binary, words array<string>")


def _answers(framed: DataFrame, vocabulary: Pieces, parts: int) -> DataFrame:
    """key, bucket and, for the words of a frame in a bucket in their order, the packed
    numbers of their pieces, whether these decode to the word, and the pieces' ids."""
    # explode_outer adds no filter below the shuffle, so that both readers share it
    asked = framed.select(F.posexplode("words").alias("bucket", "listed")).where("listed IS NOT NULL").repartition(parts, "bucket")
    words = asked.select("bucket", F.split("listed", " ").alias("listed"))
    words = words.select("bucket", F.explode_outer(F.slice("listed", F.lit(2), F.size("listed") - 1)).alias("word")).distinct()
    words = words.withColumn("word", F.when(F.col("word").startswith(MARK), F.expr("substring(word, 2)")).otherwise(F.concat(F.lit(MARK), "word")))
    words = encode_words(words.select(F.col("bucket").alias("own"), "word", F.length("word").alias("length")), vocabulary)

    said = piece_bytes(vocabulary)
    length = np.fromiter(map(len, said), np.int64, len(said))

    def answer(lists: pa.Table, found: pa.Table) -> pa.Table:
        word = found["word"].combine_chunks()
        size = pc.list_value_length(found["ids"]).to_numpy().astype(np.int64)
        ids, end = pc.list_flatten(found["ids"]).to_numpy().astype(np.int32), np.cumsum(size)
        first = end - size
        # where the pieces of each word end, in bytes, and what they stand for, all in a row
        until, text = np.append(0, np.cumsum(length[ids]))[end], b"".join(map(said.__getitem__, ids.tolist()))
        spoken = pc.replace_substring(word.cast(pa.binary()), MARK.encode(), b" ")
        wanted = np.cumsum(pc.binary_length(spoken).to_numpy(), dtype=np.int64)
        spoken = spoken.to_pylist()
        if np.array_equal(until, wanted) and text == b"".join(spoken):
            same = np.ones(len(word), np.int64)
        else:
            since = np.append(0, until)
            same = np.fromiter((text[a:b] == w for a, b, w in zip(since[:-1].tolist(), until.tolist(), spoken, strict=True)), np.int64, len(word))
        at = {_short(w): i for i, w in enumerate(word.to_pylist())}
        out = []
        for bucket, listed in zip(lists["bucket"].to_pylist(), lists["listed"].to_pylist(), strict=True):
            key, *own = listed.split(" ")
            pick = np.fromiter(map(at.__getitem__, own), np.int64, len(own))
            out.append((key, bucket, _packed(size[pick]), _packed(same[pick]), _packed(_gathered(ids, first[pick], size[pick])[0])))
        types = {"key": pa.string(), "bucket": pa.int32(), "size": pa.binary(), "same": pa.binary(), "ids": pa.binary()}
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(types.items())})

    return asked.groupBy("bucket").cogroup(words.groupBy("own")).applyInArrow(answer, "key string, bucket int, size binary, same binary, ids binary")


def encode(docs: DataFrame, vocabulary: Pieces) -> DataFrame:
    """doc_id, n_words, n_pieces, ids, round_trip for every row of ``docs``.

    Whole texts are encoded, very long ones and unbroken words of any length too (a word's
    edges meet in one task). round_trip tells whether the decoded ids are the text; it is
    false only for texts that hold the mark of a space themselves (it decodes to a space).
    A null or empty text has no pieces. Repeated rows get equal ids, a null doc_id stays
    null, an empty table gives an empty result, and extra columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", whole_text().alias("text"))
    kept = min(MOST_FILES, parts // 4)
    framed = saved_in_buckets(_frames(rows, vocabulary, min(BUCKETS, 4 * parts)), "piece-frames", "key", kept, codec="zstd")
    answers = _answers(framed, vocabulary, parts).repartition(kept, "key").groupBy("key").agg(F.collect_list(F.struct("bucket", "size", "same", "ids")).alias("answers"))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                r = {c: part.column(c)[i] for c in part.schema.names}
                got = sorted(r["answers"].as_py() or [], key=lambda a: a["bucket"])
                size, same, ids = (np.concatenate([np.zeros(0, np.int32), *(_unpacked(a[c]) for a in got)]) for c in ("size", "same", "ids"))
                order, a = _unpacked(r["order"].as_py()), 0
                n_words, whole = (r[c].values.to_numpy(zero_copy_only=False) for c in ("n_words", "whole"))
                first = (np.cumsum(size, dtype=np.int64) - size)[order]
                size, same, ids = size[order].astype(np.int64), same[order], ids.astype(np.int32)
                for packed, n_texts in zip(r["numbers"].as_py(), r["n_texts"].as_py(), strict=True):
                    own, b = _unpacked(packed), a + n_texts
                    taken, at = _gathered(ids, first[own], size[own])
                    # where each text begins and ends among the pieces, and how many of its words differ
                    end = np.append(0, np.cumsum(n_words[a:b]))
                    cut, wrong = np.append(at, len(taken))[end], np.append(0, np.cumsum(same[own] == 0))[end]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": r["doc_ids"].values[a:b], "n_words": n_words[a:b], "n_pieces": np.diff(cut),
                        "ids": pa.ListArray.from_arrays(cut.astype(np.int32), taken), "round_trip": whole[a:b].astype(bool) & (np.diff(wrong) == 0)})
                    a = b

    whole = framed.drop("words").join(answers, "key", "left")
    found = whole.mapInArrow(finish, "doc_id string, n_words long, n_pieces long, ids array<int>, round_trip boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(encoded: DataFrame, vocabulary: Pieces) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its column ``ids``."""

    @F.pandas_udf("string")
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = decoder(vocabulary)
        for ids in parts:
            yield pd.Series([of(list(i)) if i is not None else None for i in ids], dtype=object)

    return encoded.withColumn("decoded", said("ids"))
