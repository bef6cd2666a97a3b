"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector. Learned filters of ``WIDTH`` bytes run over every position
of the text; their maxima over overlapping chunks of ``2 * BLOCK`` positions (each block of
positions belongs to two chunks) cover the whole document. A small head turns the maxima of
a chunk and its length into a logit, and the mean of the logits over all chunks gives one
probability. Training happens on the driver, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

VECTOR = 4
WIDTH = 8
FILTERS = 24
HIDDEN = 16
BLOCK = 256
#: Positions that are convolved at once; in training the blocks that are convolved at once
#: and the chunks that learn at once.
SLICE = 16384
STEP = 64
CHUNKS = 512

#: Bound of the training sample: labelled rows of each class, read whole.
ROWS_PER_CLASS = 1500
EPOCHS = 20
#: A small sample is read more often, up to so many steps.
LEAST_STEPS = 300
BATCH = 32
SEED = 7


@dataclass
class Model:
    """Weights of the network, or a constant score where there was nothing to learn."""

    weights: dict[str, np.ndarray] | None
    constant: float = 1.0


def _windows(x: np.ndarray) -> np.ndarray:
    """Rows of WIDTH consecutive byte vectors, from an array (..., positions, VECTOR)."""
    x = np.ascontiguousarray(x)
    shape = (*x.shape[:-2], x.shape[-2] - WIDTH + 1, WIDTH * VECTOR)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, shape, (*x.strides[:-1], x.itemsize)))


def _padded(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by WIDTH - 1 zeros, and their lengths (1 at least)."""
    gap = b"\0" * (WIDTH - 1)
    data = [d or b"\0" for d in data]
    return np.frombuffer(gap.join([*data, b""]), np.uint8), np.array([len(d) for d in data])


def _block_maxima(w: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each block of positions the maximum of each filter."""
    out = np.empty((len(starts), FILTERS), np.float32)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        lo, hi = starts[i], starts[j - 1] + sizes[j - 1]
        y = _windows(w["bytes"][data[lo : hi + WIDTH - 1]]) @ w["filters"]
        # a block ends where the next begins, or where the gap between two texts begins
        marks = np.column_stack([starts[i:j], starts[i:j] + sizes[i:j]]).ravel() - lo
        out[i:j] = np.maximum.reduceat(y, marks[:-1], axis=0)[::2]
        i = j
    return out


def _head(w: dict[str, np.ndarray], maxima: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features = np.column_stack([np.maximum(maxima + w["filter_bias"], 0), length]).astype(np.float32)
    hidden = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
    return features, hidden, hidden @ w["out"] + w["out_bias"]


@dataclass
class Layout:
    """Texts one behind the other, their blocks, and their chunks of two blocks."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    blocks: np.ndarray
    """How many blocks each text has."""
    first: np.ndarray
    second: np.ndarray
    """The blocks of each chunk; the only block of a text is both."""
    owner: np.ndarray
    """The text of each chunk."""
    length: np.ndarray
    """The share of a whole chunk that is text."""


def _layout(texts: list[bytes]) -> Layout:
    """An empty text is one zero byte."""
    data, sizes = _padded(texts)
    begin = np.concatenate([[0], np.cumsum(sizes + WIDTH - 1)[:-1]])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, sizes[owner] - place * BLOCK)
    # a chunk is a block and the one behind it; the last block is a chunk alone only if it is the first
    first = np.flatnonzero((place + 1 < blocks[owner]) | (blocks[owner] == 1))
    second = np.where(blocks[owner[first]] == 1, first, first + 1)
    length = np.where(second == first, size[first], size[first] + size[second])
    return Layout(data, begin[owner] + place * BLOCK, size, blocks, first, second, owner[first], length / (2 * BLOCK))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each whole text; an empty text is one zero byte."""
    if model.weights is None:
        return np.full(len(texts), model.constant)
    t = _layout([x.encode("utf-8", "surrogatepass") for x in texts])
    maxima = _block_maxima(model.weights, t.data, t.starts, t.sizes)
    _, _, logit = _head(model.weights, np.maximum(maxima[t.first], maxima[t.second]), t.length)
    total = np.bincount(t.owner, logit, len(texts)) / np.maximum(1, np.bincount(t.owner, minlength=len(texts)))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> pd.DataFrame:
    """Label and all bytes of at most ``rows`` labelled documents of each class, the ones
    with the smallest hashes."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = [labels.where(F.col("quality") == q).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(rows) for q in (0, 1)]
    small_batches(docs.sparkSession)
    # at most 2 * rows ids: small by construction
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", whole_text().alias("text")).join(sample, "doc_id").select(
        "doc_id", F.col("quality").cast("int").alias("label"), F.col("text").cast("binary").alias("data")).toPandas()


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Model:
    """Fit the network on a sample of ``rows`` labelled documents of each class.

    ``labels`` has doc_id and quality (0 or 1; other values are ignored). With no labelled
    document of class 0 the model scores 1.0 always, with none of class 1 it scores 0.0.
    """
    sample = _sample(docs, labels, rows).sort_values(["doc_id", "data"], ignore_index=True)
    classes = set(sample["label"])
    if classes != {0, 1}:
        return Model(None, 0.0 if classes == {0} else 1.0)
    truth = sample["label"].to_numpy(np.float32)
    weight = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())).astype(np.float32)
    t = _layout([bytes(d) for d in sample["data"]])
    # blocks with the bytes behind them that their last positions see
    data = np.concatenate([t.data, np.zeros(BLOCK, np.uint8)])[t.starts[:, None] + np.arange(BLOCK + WIDTH - 1)]
    head = np.cumsum(t.blocks) - t.blocks
    chunks = np.maximum(1, t.blocks - 1)
    chunk_head = np.cumsum(chunks) - chunks

    rng = np.random.default_rng(SEED)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {"bytes": normal(256, VECTOR, scale=0.5), "filters": normal(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5),
         "filter_bias": np.zeros(FILTERS, np.float32), "hidden": normal(FILTERS + 1, HIDDEN, scale=(FILTERS + 1) ** -0.5),
         "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=HIDDEN**-0.5), "out_bias": np.zeros((), np.float32)}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    batches = max(1, len(truth) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for batch in np.array_split(rng.permutation(len(truth)), batches):
            own = _ranges(head[batch], t.blocks[batch])
            chunk = _ranges(chunk_head[batch], chunks[batch])
            owner = np.repeat(np.arange(len(batch)), chunks[batch])
            # places of the blocks among those of this batch
            moved = (np.cumsum(t.blocks[batch]) - t.blocks[batch] - head[batch])[owner]
            pair = (t.first[chunk] + moved, t.second[chunk] + moved)
            grads = _gradients(w, data[own], t.sizes[own], pair, t.length[chunk], owner, truth[batch], weight[batch])
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] = (w[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(w)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n numbers each."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _forward(w, data, size):
    """For blocks of bytes the winning position of each filter and its value.

    Positions lie in the last axis, so that maxima run over neighbouring numbers."""
    cols = np.empty((len(data), WIDTH, VECTOR, BLOCK), np.float32)
    for v in range(VECTOR):
        value = np.ascontiguousarray(w["bytes"][:, v])[data]
        for k in range(WIDTH):
            cols[:, k, v] = value[:, k : k + BLOCK]
    # one small product for each block: larger ones would wake all the driver's cores
    y = np.ascontiguousarray(w["filters"].T) @ cols.reshape(len(data), WIDTH * VECTOR, BLOCK)
    for i in np.flatnonzero(size < BLOCK):  # positions behind the text
        y[i, :, size[i] :] = -np.inf
    at = y.argmax(axis=2)
    return at, np.take_along_axis(y, at[:, :, None], axis=2)[:, :, 0]


def _gradients(w, data, size, pair, length, owner, truth, weight) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of a batch of documents (blocks in ``data``, the
    two blocks of each chunk in ``pair``).

    Each block is convolved once, ``STEP`` blocks at a time, however many a document has;
    what stays of them is the winning positions and their values."""
    parts = [_forward(w, data[i : i + STEP], size[i : i + STEP]) for i in range(0, len(data), STEP)]
    at, maxima = (np.concatenate(p) for p in zip(*parts, strict=True))
    first, second = pair
    block = np.where(maxima[second] > maxima[first], second[:, None], first[:, None])
    each = np.arange(FILTERS)
    at = at[block, each]
    features, hidden, logit = _head(w, maxima[block, each], length)
    n = np.bincount(owner)
    p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, logit) / n, -30, 30)))
    slope = (((p - truth) * weight / len(truth) / n)[owner]).astype(np.float32)
    total: dict[str, np.ndarray] = {}
    for i in range(0, len(first), CHUNKS):
        piece = slice(i, i + CHUNKS)
        seen = data[block[piece, :, None], at[piece, :, None] + np.arange(WIDTH)]
        for k, g in _backward(w, seen, features[piece], hidden[piece], slope[piece]).items():
            total[k] = total[k] + g if k in total else g
    return total


def _backward(w, seen, features, hidden, d_logit) -> dict[str, np.ndarray]:
    """Only the winning window of a filter learns (``seen``: its bytes by chunk, filter)."""
    d_hidden = np.outer(d_logit, w["out"]) * (hidden > 0)
    d_features = (d_hidden @ w["hidden"].T)[:, :FILTERS] * (features[:, :FILTERS] > 0)
    won = w["bytes"][seen].reshape(len(seen), FILTERS, -1)
    d_window = np.einsum("cf,wf->cfw", d_features, w["filters"]).reshape(-1, VECTOR)
    d_bytes = np.column_stack([np.bincount(seen.ravel(), d_window[:, v], 256) for v in range(VECTOR)])
    return {"bytes": d_bytes.astype(np.float32), "filters": np.einsum("cf,cfw->wf", d_features, won), "filter_bias": d_features.sum(axis=0),
            "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0), "out": hidden.T @ d_logit, "out_bias": d_logit.sum()}


def held_out() -> Column:
    """Rows that never teach: crc32 of the doc_id as text leaves 2 by 4 (null: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [scores(model, list(texts.iloc[i : i + 64])) for i in range(0, len(texts), 64)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0), dtype="float64")

    return score(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``quality_score`` from 0 to 1 (higher: label 1 likelier).

    The whole text is read and nothing else; a null text is the empty text, which has a
    score like any other. Rows are independent, so repeated rows score alike.
    """
    return docs.withColumn("quality_score", score_column(model, whole_text()))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels.where(~held_out()))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all their columns."""
    model = train(docs, labels.where(~held_out()))
    return docs.where(score_column(model, whole_text()) >= threshold)
