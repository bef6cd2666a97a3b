"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.session import scratch_path

#: White space of the contracts: space and the ASCII controls 9 to 13.
SPACE_CLASS = " \\t-\\r"

#: Most rows of an Arrow batch: rows hold whole texts.
TEXT_ROWS = 512
#: Characters of text that a step of a task holds, or one text that is longer.
PIECE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have ``TEXT_ROWS`` rows at most, which bounds
    the memory of a Python worker."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, str(TEXT_ROWS))


def saved(df: DataFrame, tag: str, small: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, and later branches read only
    the columns they need. ``small`` rows (a few numbers, no texts) are written by as many
    tasks as the cluster has cores, which saves files and keeps all cores busy. ``codec``
    is the files' compression, if not the session's.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism))
    path = scratch_path(spark, tag)
    small_batches(spark)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def saved_in_buckets(df: DataFrame, tag: str, key: str, buckets: int, codec: str | None = None) -> DataFrame:
    """As :func:`saved`, with the rows dealt to ``buckets`` files a task by the hash of ``key``.

    Rows that a join by ``key`` brings in as many partitions meet them where they are read, so that
    rows of large values are not shuffled too. Spark reads buckets only through its catalog: the table
    is entered there for that moment and taken out again, the files stay in the checkpoint folder."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    small_batches(spark)
    name = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.write.bucketBy(buckets, key).format("parquet").options(path=path, **({"compression": codec} if codec else {})).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def whole_text(name: str = "text") -> Column:
    """The text column; a null text counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z (and no other letter) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word (run of bytes other than space and 9 to 13)."""
    words = data.split()
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text.

    A text with fewer than ``k`` words has its whole word sequence as one shingle; a text
    without words has the empty set.
    """
    h = word_hashes(ascii_lower(text))
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s)


def frames(parts: Iterable[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, which bounds what one step of a task holds."""
    for part in parts:
        for i in range(0, len(part), rows):
            yield part.iloc[i : i + rows]


def pieces(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``PIECE_CHARS`` characters of text, or of one longer text."""
    for part in parts:
        at = np.cumsum([len(t) for t in part["text"]]) // PIECE_CHARS if len(part) else np.zeros(0, int)
        for g in np.unique(at):
            yield part.iloc[np.searchsorted(at, g) : np.searchsorted(at, g, "right")]
