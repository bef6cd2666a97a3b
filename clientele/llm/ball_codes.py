"""Vector code compression: product codes whose codebooks come from ball k-means.

Vectors of whole numbers are cut into equal parts, and each part position has its own
codebook. In the first round every part is compared with all entries. From then on a part
starts from the entry it had: the parts of an entry are its ball, and the distance of the
farthest one is the ball's radius. Only entries nearer than twice the radius are
neighbours. A part nearer than half the way to the nearest neighbour lies in the stable
core and keeps its entry without work; the rings around the core are bounded by half the
distances to the neighbours, and a part in a ring is compared only with the neighbours
whose half distance it reaches. All comparisons are between whole numbers, so the entries
found are the exact nearest ones.

A ball is bounded within each piece of a task, which makes its radius smaller than that of
all parts of the entry, and needs no pass of its own. The codebooks (entries x components)
are all that goes through the driver; sums and counts are added up by task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .maxscore import quantised

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows of a task's piece; parts that are compared with all entries at once.
PIECE = 2048
SLAB = 512
#: Labels whose sums are sent to every task; more of them are joined by label and salt.
BROADCAST_LABELS = 100_000
SALTS = 32
#: Components up to this size have distances that fit in 64 bits; larger ones are computed
#: as Python integers.
EXACT = 1 << 26
MOST = 2**63 - 1


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, w) to entries (k, w)."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, ties to the lower index."""
    best, far = np.empty(len(points), np.int64), np.empty(len(points), points.dtype)
    for i in range(0, len(points), SLAB):
        d = distances(points[i : i + SLAB], entries)
        best[i : i + SLAB] = d.argmin(axis=1)
        far[i : i + SLAB] = d[np.arange(len(d)), best[i : i + SLAB]]
    return best, far


class Balls:
    """The entries of one codebook with the distances between them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = distances(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")  # an entry itself is among the first
        self.rings = np.take_along_axis(between, self.order, axis=1)
        self.compared = 0

    def reassign(self, points: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`nearest`, from the entries ``old`` that the points had."""
        best, far = old.copy(), ((points - self.entries[old]) ** 2).sum(axis=1)
        if not len(old) or len(self.entries) == 1:
            return best, far
        reach = 4 * far  # the square of twice the distance
        radius = np.zeros(len(self.entries), reach.dtype)
        np.maximum.at(radius, old, reach)
        neighbours = int((self.rings <= radius[:, None]).sum(axis=1).max())
        rest = np.flatnonzero(reach >= self.rings[old, 1])  # outside the stable cores
        for i in range(0, len(rest), SLAB):
            some = rest[i : i + SLAB]
            # entries of the rings up to the point's own, the old one among them
            within = (self.rings[old[some], :neighbours] <= reach[some, None]).sum(axis=1)
            begin = np.cumsum(within) - within
            at = np.repeat(some, within)
            entry = self.order[old[at], np.arange(len(at)) - np.repeat(begin, within)]
            d = ((points[at] - self.entries[entry]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(d, begin)
            far[some] = least
            best[some] = np.minimum.reduceat(np.where(d == np.repeat(least, within), entry, len(self.entries)), begin)
            self.compared += len(at) - len(some)
        return best, far


def _points(part: pd.DataFrame, dim: int, exact: bool) -> np.ndarray:
    m = np.array([np.asarray(v, np.int64) for v in part["vec"]], np.int64).reshape(len(part), dim)
    return m if exact else m.astype(object)


def _books(rows: list, parts: int, dim: int) -> list[np.ndarray]:
    width = dim // parts
    m = np.array([list(map(int, r["vec"])) for r in rows], object).reshape(-1, dim)
    return [m[:, p * width : (p + 1) * width] for p in range(parts)]


def _typed(books: list[np.ndarray], exact: bool) -> list[np.ndarray]:
    return [b.astype(np.int64) if exact else b for b in books]


def _assign(rows: DataFrame, books: list[np.ndarray], exact: bool) -> DataFrame:
    """vec_id, label, vec, code (one byte for each part), error. Without a column ``code``
    all entries are compared."""
    parts, width = len(books), books[0].shape[1]
    first = "code" not in rows.columns
    typed = _typed(books, exact)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        balls = None if first else [Balls(b) for b in typed]
        for frame in frames:
            for at in range(0, len(frame), PIECE):
                piece = frame.iloc[at : at + PIECE]
                x = _points(piece, parts * width, exact)
                codes = np.empty((len(piece), parts), np.uint8)
                error = np.zeros(len(piece), object if not exact else np.int64)
                old = None if first else np.frombuffer(b"".join(piece["code"]), np.uint8).reshape(-1, parts).astype(np.int64)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    best, far = nearest(own, typed[p]) if first else balls[p].reassign(own, old[:, p])
                    codes[:, p] = best
                    error += far
                yield pd.DataFrame({"vec_id": piece["vec_id"].array, "label": piece["label"].array, "vec": piece["vec"].array,
                                    "code": [c.tobytes() for c in codes], "error": [min(MOST, int(e)) for e in error]})

    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return rows.mapInPandas(assign, f"vec_id {id_type}, label {label_type}, vec array<long>, code binary, error long")


def _updated(rows: DataFrame, books: list[np.ndarray], exact: bool) -> list[np.ndarray]:
    """Each entry becomes floor(sum / count) of its parts; an unused entry stays."""
    parts, (entries, width) = len(books), books[0].shape

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, entries, width), object)
        count = np.zeros((parts, entries), np.int64)
        for frame in frames:
            for at in range(0, len(frame), PIECE):
                piece = frame.iloc[at : at + PIECE]
                x = _points(piece, parts * width, exact)
                code = np.frombuffer(b"".join(piece["code"]), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    add = np.zeros((entries, width), x.dtype)
                    np.add.at(add, code[:, p], x[:, p * width : (p + 1) * width])
                    total[p] += add.astype(object)
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        if len(p):  # Arrow knows no type for a column of no lists
            yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "sums": [[str(v) for v in total[i, j]] for i, j in zip(p, e, strict=True)]})

    found = rows.select("vec", "code").mapInPandas(sums, "part int, entry int, n long, sums array<string>")
    one = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [b.copy() for b in books]
    # at most parts * entries rows
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *one).collect():
        out[r["part"]][r["entry"]] = [int(Decimal(r[f"s{i}"])) // r["n"] for i in range(width)]
    return out


def fit_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all ``rows`` (vec_id, label, vec: array of whole numbers) and the codebooks.

    The codebooks start as the parts of the ``entries`` rows with the smallest vec_ids
    (nulls last, then the smaller vector). Vectors of another length than the first of them
    take no part; that length must be a multiple of ``parts``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    dim = len(first[0]["vec"]) if first else 0
    if dim == 0 or dim % parts:
        if dim:
            raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
        return rows.where("false").withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")}), []
    rows = rows.where(F.size("vec") == dim)
    first = [r for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()]
    most = rows.agg(F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))), F.min(F.array_min("vec"))).first()
    exact = max(most[0], -most[1]) <= min(EXACT, int((2**62 / dim) ** 0.5) // 4)
    books = _books(first, parts, dim)
    for _ in range(rounds):
        rows = saved(_assign(rows, books, exact), "ball-codes")
        books = _updated(rows, books, exact)
    return saved(_assign(rows, books, exact), "ball-codes").drop("vec"), books


def spelled(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the sum of error over equal labels, nulls together. Sums
    are added up by task before the shuffle; the sums of many labels are joined by label and
    salt, so that one label's rows are spread."""
    codes = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = saved(codes.groupBy(F.col("label").alias("sum_label")).agg(F.sum("error").alias("label_error")), "ball-labels")
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), codes["label"].eqNullSafe(sums["sum_label"])).drop("sum_label", "salt")
    sums = sums.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return codes.join(sums, codes["label"].eqNullSafe(sums["sum_label"]) & (codes["salt"] == sums["sum_salt"])).drop("sum_label", "sum_salt", "salt")


def report(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each fit row of ``embeddings``.

    Components become floor(256 * x). Rows with a null vector, or with a null, infinite or
    undefined component, take no part; a null vec_id or label does. Empty vectors and
    vectors of another length than that of the smallest vec_id take no part either. code has
    two hex digits for each part, error is the sum of squared distances (at most 2**63 - 1),
    label_error its sum over equal labels. Repeated rows get equal codes; of equal distances
    the lower entry wins; fewer rows than ``entries`` make as many entries. An empty table
    gives an empty result, and extra columns are ignored.
    """
    vec = quantised(F.col("embedding"))
    rows = embeddings.select("vec_id", "label", vec.alias("vec")).where("vec IS NOT NULL AND size(vec) > 0")
    codes, books = fit_codes(rows, parts, entries, rounds)
    return with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                          F.lit(spelled(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with a column ``vec``: the entries that a row's code names, joined."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books])
    spots = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.element_at(
        F.element_at(table, p + 1), F.conv(F.hex(F.substring(F.col("code"), p + 1, F.lit(1))), 16, 10).cast("int") + 1))
    return codes.withColumn("vec", F.flatten(spots))
