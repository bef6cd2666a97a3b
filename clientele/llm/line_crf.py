"""Quality rules: a linear-chain conditional random field labels the lines of a text.

Each line that holds a word is content or boilerplate. Its features are shares of byte
classes, lengths and repeats; weights of the features and of the steps between two labels
are learned from labelled documents (the lines of a good document are content, those of a
poor one boilerplate), and Viterbi decoding gives the best labelling of all lines of a text.
A document stays when its content lines hold enough of its words and no fixed rule rejects it.

Rows are independent: a task reads its rows in pieces of bounded size, nothing is
shuffled, and only the learned weights (a few hundred bytes) are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, small_batches, whole_text
from .quality import held_out

#: Bound of the training sample: labelled documents of each class, read whole.
ROWS_PER_CLASS = 400
#: Lines of one training sequence; a longer document is several sequences.
SEQUENCE = 64
STEPS = 150
RATE = 0.1
PENALTY = 1e-3
SEED = 11
#: Rules that reject a document whatever its lines are.
LEAST_WORDS = 50
MOST_REPEATED = 50

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 5, np.int64)  # 5: other signs
for _i, _set in enumerate((SPACES, SYMBOLS, b"0123456789", bytes(range(65, 91)), bytes([*range(97, 123), *range(192, 256)]))):
    _CLASS[list(_set)] = _i
_CLASS[128:192] = 6  # bytes that continue a character
N_FEATURES = 13


@dataclass
class Lines:
    """Counts of the documents of a piece (arrays by document) and features of their lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray  # of each line with a word
    start: np.ndarray  # its place among the characters of the text
    end: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(texts: list[str]) -> Lines:
    """Words, lines and repeats of whole texts (see :func:`report` for the counts)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_docs = len(data)
    whole = b"\n".join([*data, b""])
    raw = np.frombuffer(whole, np.uint8)
    kind = _CLASS[raw]
    first = kind != 6
    size = np.array([len(d) for d in data], np.int64) + 1
    doc_end = np.cumsum(size)
    breaks = np.flatnonzero(raw == 10)
    line_of = np.cumsum(raw == 10) - (raw == 10)  # a line's break is its last byte
    n_lines = len(breaks)
    line_doc = np.searchsorted(doc_end, breaks, side="right")
    counts = np.bincount(line_of * 8 + kind, minlength=n_lines * 8).reshape(-1, 8)

    solid = kind != 0
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    word_line = line_of[starts]
    word_doc = line_doc[word_line]
    h = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(h, whole.split()), np.uint64, len(starts))
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        key = mix64(mix64(mix64(hashes[:-2] + np.uint64(1)) * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
        key = mix64(key * np.uint64(7) + word_doc[:-2].astype(np.uint64))
        inside = np.flatnonzero(word_doc[:-2] == word_doc[2:])
        _, which, often = np.unique(key[inside], return_inverse=True, return_counts=True)
        at = inside[often[which] > 1]
        for i in range(3):
            repeated[at + i] = True
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])

    words = np.bincount(word_line, minlength=n_lines)
    seen: set = set()
    last = -1
    copies = np.zeros(n_lines, bool)
    for i, (d, line) in enumerate(zip(line_doc.tolist(), whole.split(b"\n"), strict=False)):
        if d != last:
            seen, last = set(), d
        if line in seen:
            copies[i] = True
        else:
            seen.add(line)
    copies &= words > 0

    chars = np.bincount(line_of, first, n_lines)
    solid_chars = np.bincount(line_of, first & solid, n_lines)
    size_of = np.maximum(1, chars - 1)
    share = lambda c: counts[:, c] / size_of
    per_word = lambda x: np.bincount(word_line, x, n_lines) / np.maximum(1, words)
    # the last byte in front of the break that is no space
    solid_at = np.flatnonzero(solid)
    tail = raw[solid_at[np.maximum(0, np.searchsorted(solid_at, breaks) - 1)]] if len(solid_at) else np.zeros(n_lines, np.uint8)
    features = np.column_stack([
        np.ones(n_lines), np.log1p(words) / 4, np.log1p(chars) / 6, share(0), share(1) * 4, share(2) * 2, share(3) * 2, share(4),
        share(5) * 2, np.isin(tail, list(b".!?")), copies, per_word(again), per_word(repeated)]).astype(np.float64)
    char_at = np.cumsum(chars) - chars
    doc_chars = np.bincount(line_doc, chars, n_docs)
    begin = char_at - (np.cumsum(doc_chars) - doc_chars)[line_doc]
    keep = words > 0
    by_doc = lambda x: np.bincount(line_doc, x, n_docs).astype(np.int64)
    return Lines(
        by_doc(words), by_doc(solid_chars), by_doc(counts[:, 1]), by_doc(copies),
        np.bincount(word_doc, repeated, n_docs).astype(np.int64), line_doc[keep],
        begin[keep].astype(np.int64), (begin + chars - 1)[keep].astype(np.int64), words[keep], features[keep])


@dataclass
class Model:
    """Weights: features to the score of content over boilerplate, ``step[a, b]`` from the
    label a to b (0 boilerplate, 1 content), and the score of a first line that is content."""

    weight: np.ndarray
    step: np.ndarray
    first: float


def _by_step(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of consecutive equal owners, longest first: their begins and lengths."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([begin, [len(owner)]]))
    order = np.argsort(-length, kind="stable")
    alive = len(length) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), side="right")
    return begin[order], length[order], alive


def viterbi(model: Model, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The best labels (1 content) of the lines of each owner; ties go to content."""
    unary = features @ model.weight
    begin, length, alive = _by_step(owner)
    best = np.zeros((len(begin), 2))
    back = np.zeros((len(owner), 2), np.int8)
    label = np.zeros(len(owner), np.int8)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        if t:
            reach = best[:n, :, None] + model.step
            back[at] = reach[:, 1] >= reach[:, 0]
            best[:n] = reach.max(axis=1)
        else:
            best[:n, 1] = model.first
        best[:n, 1] += unary[at]
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        label[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return label


def _fit(features: np.ndarray, owner: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient ascent on the weighted log likelihood of the labels, by forward-backward."""
    w, step, first = np.zeros(features.shape[1]), np.zeros((2, 2)), np.zeros(1)
    begin, length, alive = _by_step(owner)
    truth = truth.astype(int)
    total = weight[begin].sum()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, step, first)]
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (truth[inside], truth[inside + 1]), weight[inside])
    seen_first = (weight[begin] * truth[begin]).sum()
    seen_w = features.T @ (weight * truth)
    for i in range(1, STEPS + 1):
        unary = features @ w
        ahead = np.zeros((len(owner), 2))
        behind = np.zeros((len(owner), 2))
        for t, n in enumerate(alive):
            at = begin[:n] + t
            ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + step, axis=1) if t else [0.0, first[0]]
            ahead[at, 1] += unary[at]
        for t in range(len(alive) - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            later = behind[at + 1] + np.column_stack([np.zeros(len(at)), unary[at + 1]])
            behind[at] = np.logaddexp.reduce(later[:, None, :] + step, axis=2)
        norm = np.logaddexp.reduce(ahead + behind, axis=1)
        p = np.exp(ahead[:, 1] + behind[:, 1] - norm)
        later = behind[inside + 1] + np.column_stack([np.zeros(len(inside)), unary[inside + 1]])
        pair = np.exp(ahead[inside][:, :, None] + step + later[:, None, :] - norm[inside][:, None, None])
        grads = [(seen_w - features.T @ (weight * p)) / total - PENALTY * w,
                 (seen_step - (pair * weight[inside][:, None, None]).sum(axis=0)) / total - PENALTY * step,
                 (seen_first - (weight[begin] * p[begin]).sum()).reshape(1) / total - PENALTY * first]
        for value, g, (m, v) in zip((w, step, first), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(w, step, float(first[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Model:
    """Fit the field on at most ``rows`` documents of each quality (the smallest hashes of
    their doc_ids), with all their lines. Where a class has no lines, all lines are content
    (no poor document) or boilerplate (no good one); without any they are content."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = [labels.where(F.col("quality") == q).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(rows) for q in (0, 1)]

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(parts):
            found = measure(list(part["text"]))
            cut = np.searchsorted(found.doc, np.arange(1, len(part)))
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "quality": part["quality"].array,
                                "features": [f.ravel() for f in np.split(found.features, cut)], "words": np.split(found.words, cut)})

    small_batches(docs.sparkSession)
    # at most 2 * rows ids: small by construction
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows_ = docs.select("doc_id", whole_text().alias("text")).join(sample, "doc_id")
    found = rows_.mapInPandas(lines, "doc_id long, quality int, features array<double>, words array<long>").toPandas()
    found = found[found["words"].map(len) > 0]
    classes = set(found["quality"])
    if classes != {0, 1}:
        return Model(np.concatenate([[-1.0 if classes == {0} else 1.0], np.zeros(N_FEATURES - 1)]), np.zeros((2, 2)), 0.0)
    found = found.assign(first=found["features"].map(lambda f: tuple(f[:N_FEATURES]))).sort_values(["doc_id", "first"], kind="stable", ignore_index=True)
    features = np.concatenate(list(found["features"])).reshape(-1, N_FEATURES)
    n = found["words"].map(len).to_numpy()
    truth = np.repeat(found["quality"].to_numpy(), n)
    place = np.arange(len(truth)) - np.repeat(np.cumsum(n) - n, n)
    owner = np.cumsum(place % SEQUENCE == 0)
    # each document counts alike within its class, and both classes count alike
    weight = np.repeat(1.0 / n / np.where(found["quality"] == 1, (found["quality"] == 1).sum(), (found["quality"] == 0).sum()), n)
    return _fit(features, owner, truth, weight * len(found) * n.mean())


def report(docs: DataFrame, model: Model, share: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars (code points in words),
    n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in windows of three words that the text holds twice
    or more), base_failed (fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` %
    of them repeated), kept (not base_failed, and content lines hold ``share`` of the words
    or more), content_words and n_content_lines.

    Words are runs of characters other than space and 9 to 13, lines end at ``\\n``. Whole
    texts are read, very long ones too: time and memory grow with their length. A null text
    is empty; a text without words has zeros, base_failed and is not kept. Repeated rows get
    equal answers, a null doc_id stays null, an empty table gives an empty result, and extra
    columns are ignored.
    """

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(parts):
            found = measure(list(part["text"]))
            label = viterbi(model, found.features, found.doc)
            content = np.bincount(found.doc, found.words * label, len(part)).astype(np.int64)
            failed = (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > MOST_REPEATED * found.n_words)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array, "n_words": found.n_words, "word_chars": found.word_chars, "n_symbols": found.n_symbols,
                "n_dup_lines": found.n_dup_lines, "n_repeat_words": found.n_repeat_words, "base_failed": failed,
                "kept": ~failed & (content >= share * found.n_words), "content_words": content,
                "n_content_lines": np.bincount(found.doc, label, len(part)).astype(np.int64)})

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(judge, (
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_words long, n_content_lines long"))


def line_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and lines, an array of (start, end, content) in code points, end exclusive and
    without the line's break, for each line that holds a word. Null and empty texts have an
    empty array; other cases as in :func:`report`."""

    def spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(parts):
            found = measure(list(part["text"]))
            label = viterbi(model, found.features, found.doc)
            cut = np.searchsorted(found.doc, np.arange(1, len(part)))
            rows = [[(int(a), int(b), bool(c)) for a, b, c in zip(*x, strict=True)] for x in zip(
                np.split(found.start, cut), np.split(found.end, cut), np.split(label, cut), strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "lines": rows})

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(
        spans, f"doc_id {id_type}, lines array<struct<start: long, end: long, content: boolean>>")


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """:func:`report` with a field trained on the labelled rows that are not held out."""
    return report(docs, train(docs, labels.where(~held_out())), share)
