"""Weighted rendezvous sharding of stable record keys (DataFrame functions only).

For a record key and each shard a hash gives a uniform number u; the shard with the largest
-weight / ln(u) takes the record. A new shard can only win records for itself, so a change
of the shard count moves few records and none between old shards. A shard's share is
proportional to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_text

#: Rows that one window of the slot numbering sorts, on average.
SLOT_ROWS = 20_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ..) of a key; a null key hashes like any other value."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def entry(shard: int, weight: float) -> Column:
        h = F.xxhash64(key, F.lit(shard))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[entry(s, w) for s, w in enumerate(weights)]))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``slot`` numbers the rows of a shard without gaps from 0. Rows are dealt to blocks by
    hash, each block is numbered on its own, and the block counts are summed before it, so
    no task ever sorts a whole shard. A null doc_id is a key of its own; a null text has
    size 8 and the CRC of the empty text; repeated rows share a shard and get slots of
    their own. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select(
        "doc_id", (F.octet_length(whole_text()) + 8).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown_weights).alias("grown_shard"))
    blocks = max(1, -(-docs.count() // (SLOT_ROWS * len(weights))))
    # repeated ids may be many, so the block also depends on the text
    rows = saved(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(blocks))), "shards")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(counts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int"))
