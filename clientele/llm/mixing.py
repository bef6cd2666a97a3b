"""Mixing sources to target weights (DataFrame functions only).

Each row gets a random key from a hash. Within a source the rows are ordered by that key
and taken until the source's budget is reached; a budget above the source's size repeats
whole epochs first. The order is cut into key ranges: word counts are summed per range,
the sums are added up to the range in which a source's budget ends, that range is cut
again, and only the rows of the last, small range are sorted. The cut is a key, so the
decision for a row needs its own key and its source's cut, and texts never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, row_of, saved, whole_text

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of the key that name a range, from coarse to fine: 256 ranges for each source,
#: then 256 parts of one of them. With 10^9 rows the last range holds about 15,000.
DIGITS = (2, 4)
#: White space as ltrim wants it.
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 9 to 13: each run, with the white
    space behind it, becomes one x."""
    run = f"[^{SPACE_CLASS}]+[{SPACE_CLASS}]*"
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACES)), run, "x")).cast("long")


def random_key(seed: str) -> Column:
    """A key that depends on doc_id and text only: reruns agree. The text counts so that
    rows without an id don't share one key."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(whole_text()), F.lit(seed)))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` for each row of ``sources`` (source, source_size).

    Weights repeat over the sources by code point (null last). All targets share
    ``share`` times the sum of sizes by weight; none exceeds ``most`` times its size, and
    what is above goes to the others by weight until none is above. That is the level L
    with sum(min(L * weight, most * size)) = total: sources reach their cap in the order of
    cap / weight, so one ordered sum over the small table of sources finds it.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wave = F.array(*[F.lit(float(w)) for w in weights])
    t = sources.withColumn("w", F.element_at(wave, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("capped")) / F.col("open_w"))
    # the first source that is not full at the level of all that are not full
    t = t.withColumn("last", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("last").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("last.level") * F.col("w"))).alias("target"))


def cuts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS,
         seed: str = "mix") -> DataFrame:
    """One row per source: source, source_size, target, epochs, and ``cut``, the last key
    that the final, partial epoch still takes (null: it takes no row)."""
    rows = saved(docs.select("source", random_key(seed).alias("key"), words(whole_text()).alias("size")), "mix-keys")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    goal = saved(goal.withColumn("epochs", epochs.cast("int")), "mix-targets", small=True)
    # per source: the range in which its budget ends, and the words before that range
    edge = goal.select(F.col("source").alias("e_source"), F.lit("").alias("range"), F.lit(0).cast("long").alias("first"),
                       (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    for digits in DIGITS:
        inside = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").startswith(F.col("range")))
        part = inside.groupBy("e_source", "first", "rest", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("n"))
        before = Window.partitionBy("e_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        edge = saved(part.where("first < rest AND first + n >= rest").drop("n"), "mix-edge", small=True)
    inside = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").startswith(F.col("range")))
    upto = Window.partitionBy("e_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("first") + F.sum("size").over(upto))
    # a row is taken when its middle lies before the budget's end: the nearest cut between rows
    taken = F.max(F.when(2 * F.col("end") - F.col("size") <= 2 * F.col("rest"), F.col("key")))
    cut = inside.groupBy("e_source").agg(F.coalesce(taken, F.min("range")).alias("cut"))
    out = goal.join(cut, F.col("source").eqNullSafe(F.col("e_source")), "left")
    return saved(out.select(F.col("source").alias("g_source"), F.col("source_size").alias("g_size"), "target", "epochs", "cut"), "mix-cuts", small=True)


def copies(docs: DataFrame, cut: DataFrame, seed: str = "mix") -> DataFrame:
    """Each row of ``docs`` as struct ``row`` with its size, its source's size and target,
    and ``copies``, how often the mix takes it."""
    rows = docs.select(row_of(docs).alias("row"), F.col("source").alias("r_source"), random_key(seed).alias("key"), words(whole_text()).alias("size"))
    mixed = rows.join(cut, F.col("r_source").eqNullSafe(F.col("g_source")))
    extra = F.coalesce((F.col("key") <= F.col("cut")).cast("int"), F.lit(0))
    return mixed.select("row", "size", F.col("g_size").alias("source_size"), "target", (F.col("epochs") + extra).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    ``taken`` is the words that the mix takes of the row, repeats counted: its size times
    the whole epochs, plus its size if its key is not after the cut. A source's taken words
    differ from its target by at most half the words of one document, where rows of equal
    doc_id and text count as one document; no row is taken more than ``most`` times. A null source is a source of its own, after all others; a null or
    empty text has size 0; a source without words has target 0 and its rows are taken once
    (0 words). Rows repeated whole share a key and are taken or left together. An empty
    table gives an empty result. Extra columns are ignored.
    """
    out = copies(docs.select("doc_id", "text", "source"), cuts(docs, **options))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    out = copies(docs, cuts(docs, **options)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
