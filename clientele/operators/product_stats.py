"""All per-key statistics of product events from one pass.

Every statistic of the product pipeline — the 15 type counts, the 6 cluster counts and the
6 entropies — is a function of the finest grouping ``(sku, client_id)`` (category and
cluster are functions of the sku). So the event table is aggregated once to per-pair type
counts; every coarser table is rolled up from that (much smaller) pair table and attached
to it; and the event table is joined back once on ``(sku, client_id)``. The wide event
table is shuffled twice in total instead of once per statistic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C
from clientele.operators.entropy import entropy_from_counts
from clientele.session import materialize

_T = [(C.ADD_TO_CART, "add"), (C.PRODUCT_BUY, "buy"), (C.REMOVE_FROM_CART, "remove")]


def pair_counts(events: DataFrame, extra: list[str]) -> DataFrame:
    """One pass over the events: per (sku, client, *extra) the count of each type."""
    aggs = [F.count_if(F.col("event_type") == t).cast("long").alias(f"_{a}") for t, a in _T]
    return events.groupBy("sku", "client_id", *extra).agg(*aggs)


def _roll(base: DataFrame, by: list[str], pattern: str) -> DataFrame:
    return base.groupBy(*by).agg(*[F.sum(f"_{a}").cast("long").alias(pattern.format(a)) for _, a in _T])


def count_table(events: DataFrame, with_clusters: bool = False) -> DataFrame:
    """Per (sku, client) the 15 type counts (+ 6 cluster counts); nulls not yet filled."""
    extra = ["category"] + (["cluster_id"] if with_clusters else [])
    # computed once: every coarser table reads it, none aggregates the events again
    base = materialize(pair_counts(events, extra))
    # a pair with a null id gets no pair-level counts (an equi-join on null never matches)
    ok = F.col("sku").isNotNull() & F.col("client_id").isNotNull()
    wide = base.select("sku", "client_id", *extra,
                       *[F.when(ok, F.col(f"_{a}")).alias(f"count_user_{a}") for _, a in _T])
    wide = (wide.join(_roll(base, ["sku"], "count_{}"), "sku", "left")
            .join(_roll(base, ["client_id"], "tot_user_{}"), "client_id", "left")
            .join(_roll(base, ["category"], "count_cat_{}"), "category", "left")
            .join(_roll(base, ["category", "client_id"], "count_cat_user_{}"), ["category", "client_id"], "left"))
    if with_clusters:
        wide = (wide.join(_roll(base, ["cluster_id"], "cluster_{}_count"), "cluster_id", "left")
                .join(_roll(base, ["client_id", "cluster_id"], "cluster_{}_user_count"),
                      ["client_id", "cluster_id"], "left"))
    return wide, base


def entropy_table(base: DataFrame, wide: DataFrame, specs: list[tuple[str, str, bool]]) -> DataFrame:
    """Attach entropies to the pair table; keys with null are counted as 0 (the reference
    fills ids before its entropies)."""
    b = base.withColumn("_n", F.col("_add") + F.col("_buy") + F.col("_remove"))
    out = wide
    client_side = []
    pairs_of: dict[str, DataFrame] = {}
    for key, name, user in specs:
        if key not in pairs_of:
            pairs_of[key] = (b.groupBy(F.coalesce(F.col(key), F.lit(0)).alias(key), "client_id")
                             .agg(F.sum("_n").alias("n")))
        pairs = pairs_of[key]
        if user:
            client_side.append((name, entropy_from_counts(pairs, "client_id", name)))
        else:
            ent = entropy_from_counts(pairs, key, name).withColumnRenamed(key, "_k")
            out = (out.join(ent, F.coalesce(out[key], F.lit(0)) == ent["_k"], "left").drop("_k"))
    if client_side:
        names = [n for n, _ in client_side]
        tagged = None
        for n, t in client_side:
            t = t.select("client_id", *[(F.col(n) if m == n else F.lit(None).cast("double")).alias(m)
                                        for m in names])
            tagged = t if tagged is None else tagged.unionByName(t)
        out = out.join(tagged.groupBy("client_id").agg(*[F.max(n).alias(n) for n in names]),
                       "client_id", "left")
    return out


def attach_statistics(events: DataFrame, with_clusters: bool = False,
                      entropy_specs: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Events + all statistics, with one join back on (sku, client_id)."""
    wide, base = count_table(events, with_clusters)
    if entropy_specs:
        wide = entropy_table(base, wide, entropy_specs)
    keep = [c for c in wide.columns if c not in ("sku", "client_id", "category", "cluster_id")]
    w = wide.select(F.col("sku").alias("_ws"), F.col("client_id").alias("_wc"), *keep)
    # null-safe: an event with a null sku still receives its client-level statistics
    cond = events["sku"].eqNullSafe(w["_ws"]) & events["client_id"].eqNullSafe(w["_wc"])
    return events.join(w, cond, "left").drop("_ws", "_wc")
