"""Window operators, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele import config as C


def total_over_key(df: DataFrame, key: str, value: str = "count", name: str = "total") -> DataFrame:
    """Total of ``value`` per ``key`` next to each row (grouped total joined back)."""
    t = df.groupBy(key).agg(F.sum(value).alias(name))
    return df.join(t, key, "left")


def top_items(df: DataFrame, key: str, k: int = C.TOP_ITEMS) -> DataFrame:
    """``k`` most frequent values of ``key`` (ties by key ascending): ``key, count, rank``.

    Counting is a partial aggregate; the k-row result is bounded, so it can be broadcast.
    """
    c = df.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("count"))
    top = c.orderBy(F.desc("count"), F.asc_nulls_last(key)).limit(k)
    w = Window.orderBy(F.desc("count"), F.asc_nulls_last(key))
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def top_skus(buys: DataFrame, k: int = C.TOP_ITEMS) -> DataFrame:
    return top_items(buys, "sku", k)


def top_categories(buys: DataFrame, properties: DataFrame, k: int = C.TOP_ITEMS) -> DataFrame:
    enriched = buys.join(properties.select("sku", "category"), "sku", "left")
    return top_items(enriched, "category", k)


def weeks_desc(weekly: DataFrame) -> list[int]:
    """Distinct weeks, newest first (bounded: at most 53 per year) — pivot values."""
    return [r[0] for r in weekly.select("week").distinct().orderBy(F.desc("week")).collect()]


def weekly_pivot(weekly: DataFrame, weeks: list[int] | None = None) -> DataFrame:
    """One column per week (named by the week number, newest first), null → 0."""
    weeks = weeks if weeks is not None else weeks_desc(weekly)
    p = weekly.groupBy("client_id").pivot("week", weeks).agg(F.first("event_count"))
    cols = [str(w) for w in weeks]
    return p.fillna(0, subset=cols).select("client_id", *[F.col(c).cast("long") for c in cols])


def best_epoch(metrics: DataFrame, n_epochs: int | None = None, task_col: str = "task",
               epoch_col: str = "epoch", metric_col: str = "weighted_metric") -> DataFrame:
    """Per task: the epoch with the highest metric (first epoch on ties) and that value.

    With ``n_epochs`` the number of rows of every task must equal it (lazy check).
    """
    w = Window.partitionBy(task_col).orderBy(F.desc(metric_col), F.asc(epoch_col))
    ranked = metrics.withColumn("_r", F.row_number().over(w))
    if n_epochs is not None:
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(task_col)))
        guard = F.when(F.col("_n") != n_epochs, F.raise_error(F.concat(
            F.lit("Number of metrics should be equal to number of epochs: "),
            F.col(task_col).cast("string"))))
        ranked = ranked.where(F.coalesce(guard.cast("boolean"), F.lit(True)))
    return (ranked.where(F.col("_r") == 1)
            .select(task_col, F.col(epoch_col).alias("best_epoch"),
                    F.col(metric_col).alias("best_score")))


def score_topk(scores: DataFrame, k: int, group_col: str = "client_id", item_col: str = "item",
               score_col: str = "score") -> DataFrame:
    """The ``k`` highest scores per group (ties by item ascending), with ``rank``."""
    w = Window.partitionBy(group_col).orderBy(F.desc(score_col), F.asc(item_col))
    return (scores.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def sort_embeddings(emb: DataFrame) -> DataFrame:
    """Ordered by client id (range-partitioned global sort, used right before a write)."""
    return emb.orderBy("client_id")


# ---- set operations -------------------------------------------------------------------------

def union_products(buy: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    return (buy.withColumn("event_type", F.lit(C.PRODUCT_BUY))
            .unionByName(add.withColumn("event_type", F.lit(C.ADD_TO_CART)))
            .unionByName(remove.withColumn("event_type", F.lit(C.REMOVE_FROM_CART))))


def union_all_events(*frames: DataFrame) -> DataFrame:
    """Diagonal union: the union of the columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_queries(searches: DataFrame) -> DataFrame:
    """Unique query strings with ``query_id`` = position in text order (0-based).

    Distributed and JVM-only (``contiguous_index``: range partitions, checkpoint, partition
    offsets); no single-partition window.
    """
    from clientele.operators.joins import contiguous_index
    return contiguous_index(searches.select("query"), "query", "query_id")


def distinct_train_ids(buy: DataFrame, add: DataFrame, remove: DataFrame,
                       col: str) -> DataFrame:
    return (buy.select(col).unionByName(add.select(col)).unionByName(remove.select(col))
            .distinct())
