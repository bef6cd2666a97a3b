"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when they are identical after deletion of white space (space, 9 to 13).
A Misra-Gries sketch finds digests that may be frequent: one sketch per task, merged in a
tree. Their true counts and winners are verified by an exact aggregate that combines on the
map side, and these few rows (at most ``HEAVY`` by construction) are broadcast, so that a
group of copies with a third of all rows never crosses the network. All other digests use
an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, row_of, saved, whole_text

#: Most digests that are broadcast; the sketch tracks four times as many (a power of two).
HEAVY = 256
#: Groups of tasks whose sketches merge first.
SKETCH_GROUPS = 64


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(text, f"[{SPACE_CLASS}]+", ""), 256)


def frequent_digests(rows: DataFrame) -> DataFrame:
    """At most ``HEAVY`` candidate digests; a guess that later steps verify."""
    tracked = 4 * HEAVY
    part = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # grouped by a constant: a task without rows must not send an empty sketch
    top = part.groupBy(F.lit(0).alias("g")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return (top.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {HEAVY})")).alias("x"))
            .where("x.item IS NOT NULL AND x.count > 1").select(F.col("x.item").alias("digest")))


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. The row with the most code
    points in its original text stays, then the smallest doc_id (a null doc_id last), then
    any one of rows that agree in both: of repeated rows exactly one is kept. A null text
    is the empty text, and empty texts form a group like any other. An empty table gives
    an empty result. Extra columns are ignored.
    """
    rows = saved(docs.select(
        "doc_id", F.length(whole_text()).cast("long").alias("chars"), digest(whole_text()).alias("digest"))
        .withColumn("uid", F.monotonically_increasing_id()), "exact-digests")
    heavy = F.broadcast(frequent_digests(rows))
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    winners = saved(rows.join(heavy, "digest").groupBy("digest").agg(
        F.min(order).alias("w"), F.count("*").alias("group_size")), "exact-winners", small=True)
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    light = light.select("*", F.min(order).over(group).alias("w"), F.count("*").over(group).alias("group_size"))
    found = light.unionByName(rows.join(F.broadcast(winners), "digest").select(light.columns))
    return found.select(
        "doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("w.uid")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The winners join back on digest and doc_id; of repeated rows that agree in both, the
    longest and then the smallest text is taken, so exactly one row per group of equal
    texts is returned.
    """
    def key(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(":"), F.coalesce(b.cast("string"), F.lit("null")))

    stay = decide(docs).where("kept").select(key(F.col("text_sha256"), F.col("keep_id")).alias("k"))
    rows = docs.select(row_of(docs).alias("row"), key(digest(whole_text()), F.col("doc_id")).alias("k"))
    one = Window.partitionBy("k").orderBy(F.length("row.text").desc(), "row.text")
    hit = rows.join(stay, "k", "left_semi").withColumn("n", F.row_number().over(one))
    return hit.where("n = 1").select("row.*")
