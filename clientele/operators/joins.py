"""Joins: dimension lookups, count/score/entropy attachment, alignment.

Physical strategy is left to Catalyst + AQE: aggregates joined back are planned as
sort-merge joins and AQE turns them into broadcast joins when the measured side is small;
only lists bounded by construction (top-k, one-row statistics) carry a broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators import counts as K
from clientele.operators.project import fill_numeric_nulls


def join_category(events: DataFrame, properties: DataFrame) -> DataFrame:
    return events.join(properties.select("sku", "category"), "sku", "left")


def check_unique_key(dim: DataFrame, key: str, what: str = "properties") -> None:
    """Eager many-to-one guard on the dimension side (an action over the small side)."""
    dup = dim.groupBy(key).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"{key} is not unique in {what}")


def join_properties_checked(events: DataFrame, properties: DataFrame,
                            check_unique: bool = True) -> DataFrame:
    """Many-to-one left join that fails on a duplicate sku or on any null in the result.

    The null check is lazy: a ``raise_error`` in the projection fails the job on the first
    offending row without an extra pass.
    """
    if check_unique:
        check_unique_key(properties, "sku")
    p = properties.withColumn("_hit", F.lit(True))
    j = events.join(p, "sku", "left")
    cols = [c for c in j.columns if c != "_hit"]
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    guard = F.when(F.col("_hit").isNull() | any_null,
                   F.raise_error(F.lit("Missing sku in properties_df"))).otherwise(F.lit(True))
    return j.where(guard).select(*cols)


def category_as_item(events: DataFrame, properties: DataFrame) -> DataFrame:
    """Replace sku by its category (left join; unknown sku → null item)."""
    return (events.join(properties.select("sku", "category"), "sku", "left")
            .drop("sku").withColumnRenamed("category", "sku"))


def attach_product_counts(events: DataFrame) -> DataFrame:
    """Attach the 15 per-type count columns; nulls (and null ids) become 0 afterwards.

    One pass aggregates the events per (sku, client) (category rides along, a function of
    sku); the sku, client, category and category+client tables are rolled up from that pair
    table and the events are joined back once (see ``product_stats``).
    """
    from clientele.operators.product_stats import attach_statistics
    return fill_numeric_nulls(attach_statistics(events))


def attach_cluster(df: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    return df.join(clusters.select(key, "cluster_id"), key, "left")


def attach_cluster_counts(events: DataFrame) -> DataFrame:
    return (events.join(K.cluster_counts(events), "cluster_id", "left")
            .join(K.cluster_client_counts(events), ["client_id", "cluster_id"], "left"))


def attach_query_scores(sessions: DataFrame, searches: DataFrame) -> DataFrame:
    """Left-join the five search score tables (counted on raw searches, all clients)."""
    return (sessions.join(K.query_score(searches), "query_id", "left")
            .join(K.query_user_score(searches), ["client_id", "query_id"], "left")
            .join(K.queries_by_user(searches), "client_id", "left")
            .join(K.cluster_by_user(searches), ["client_id", "cluster_id"], "left")
            .join(K.cluster_score(searches), "cluster_id", "left"))


def attach_visit_counts(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    return (sessions.join(K.url_counts(visits), "url", "left")
            .join(K.client_visit_totals(visits), "client_id", "left")
            .join(K.client_url_visits(visits), ["url", "client_id"], "left"))


def attach_url_score(visits: DataFrame) -> DataFrame:
    """Legacy: visits inner-joined with visits per url (``score``)."""
    scores = visits.groupBy("url").agg(F.count(F.lit(1)).cast("long").alias("score"))
    return visits.join(scores, "url")


def attach_norm_vector(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Left-join a scaled vector column ``norm`` on ``key``."""
    return df.join(vectors.select(key, "norm"), key, "left")


def attach_slope(df: DataFrame, weekly: DataFrame) -> DataFrame:
    return df.join(weekly, "client_id", "left")


def align_history_future(history: DataFrame, future: DataFrame, default_event: dict) -> DataFrame:
    """Per client of ``history``: its future events (long form ``client_id, pos, ...``), or
    one default event at ``pos`` 0 when the future is absent or empty; ``is_default`` marks
    the defaults. Long form keeps a client with a huge future spread over tasks.

    ``default_event``: column → literal value for the default row (other columns null)."""
    clients = history.select("client_id").distinct()
    fut = future.join(clients, "client_id", "left_semi").withColumn("is_default", F.lit(False))
    missing = clients.join(future.select("client_id").distinct(), "client_id", "left_anti")
    cols = [c for c in fut.columns if c not in ("client_id", "is_default")]
    defaults = missing.select("client_id", *[
        (F.lit(default_event[c]) if c in default_event else F.lit(None)).cast(fut.schema[c].dataType).alias(c)
        for c in cols], F.lit(True).alias("is_default"))
    return fut.unionByName(defaults)


def align_embeddings(a: DataFrame, b: DataFrame, name_a: str = "a",
                     name_b: str = "b") -> DataFrame:
    """Join two keyed embedding tables; fail if their client sets differ.

    One full outer join: a row missing on either side raises lazily, so the result equals
    the inner join and the check costs no extra pass.
    """
    x = a.select("client_id", F.col("embedding").alias(name_a))
    y = b.select("client_id", F.col("embedding").alias(name_b))
    j = x.join(y, "client_id", "full_outer")
    guard = F.when(F.col(name_a).isNull() | F.col(name_b).isNull(),
                   F.raise_error(F.lit("Client IDs of the embedding sets must match.")))
    return j.where(F.coalesce(guard.cast("boolean"), F.lit(True)))


def merge_event_features(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Per client, concatenate per-type feature vectors in the given order, zeros for a
    missing type. ``parts``: ``(DF(client_id, features), size)`` per type.

    One union + one grouping by client (each client has at most ``len(parts)`` rows),
    instead of a join per type.
    """
    tagged = None
    for i, (df, _) in enumerate(parts):
        t = df.select("client_id", F.lit(i).alias("_slot"),
                      F.col("features").cast("array<double>").alias("_f"))
        tagged = t if tagged is None else tagged.unionByName(t)
    g = tagged.groupBy("client_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_f"))).alias("_m"))
    pieces = [F.coalesce(F.col("_m")[i], F.array_repeat(F.lit(0.0), n))
              for i, (_, n) in enumerate(parts)]
    return g.select("client_id", F.concat(*pieces).alias("embedding"))


def contiguous_index(ids: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dense 0-based index of the distinct values of ``col`` in ascending order.

    Distributed, exact and JVM-only: the distinct values are range-partitioned (balanced by
    sampling) and sorted inside partitions, then checkpointed to the shared checkpoint
    folder so every later pass sees the same partitions. Partition sizes (one row per
    partition) give offsets; ``monotonically_increasing_id`` minus its partition base is the
    position inside a partition. No single-partition window, no per-row Python.
    """
    from clientele.session import scratch_dir
    scratch_dir(ids.sparkSession)                      # checkpoint folder (session setting)
    d = ids.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    n_parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = (d.repartitionByRange(n_parts, col).sortWithinPartitions(col)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    sizes = sorted((r["_pid"], r["n"]) for r in
                   d.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = [0] * (max((p for p, _ in sizes), default=-1) + 1)
    acc = 0
    for p, n in sizes:
        offsets[p] = acc
        acc += n
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_pid") + 1) \
        if offsets else F.lit(0).cast("long")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return d.select(F.col(col), (off + pos).cast("long").alias(name))


def index_ids(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contiguous index for clients and items seen in any product table."""
    return (contiguous_index(products, "client_id", "client_idx"),
            contiguous_index(products, "sku", "item_idx"))
