"""Behavioural entropy of a key over clients, and of clients over a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C


def _pair_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key, "client_id").agg(F.count(F.lit(1)).cast("long").alias("n"))


def entropy_from_counts(pairs: DataFrame, group_key: str, name: str) -> DataFrame:
    """``Σ −p·log2(p + ε)`` per ``group_key`` with ``p = min(n / (total + ε), cap)``.

    ``pairs`` holds one row per (key, client) with its count ``n``. The per-group total is a
    separate grouped aggregate joined back on the group key (small: one row per group),
    so a hot group is never gathered into one window partition.
    """
    totals = (pairs.groupBy(group_key).agg(F.sum("n").alias("_total"))
              .withColumnRenamed(group_key, "_g"))
    p_raw = F.col("n") / (F.col("_total") + F.lit(C.ENTROPY_EPS))
    p = F.when(F.col("_total") > 0, F.least(p_raw, F.lit(C.ENTROPY_P_CAP))).otherwise(F.lit(0.0))
    contrib = -F.col("_p") * F.log2(F.col("_p") + F.lit(C.ENTROPY_EPS))
    # null-safe: a null key is its own group, as in a window over the key
    return (pairs.join(totals, pairs[group_key].eqNullSafe(totals["_g"])).drop("_g")
            .withColumn("_p", p)
            .groupBy(group_key).agg(F.sum(contrib).alias(name)))


def key_entropy(df: DataFrame, key: str, name: str) -> DataFrame:
    """Entropy of the client distribution of each key value: ``key, name``."""
    return entropy_from_counts(_pair_counts(df, key), key, name)


def client_entropy(df: DataFrame, key: str, name: str) -> DataFrame:
    """Entropy of the key distribution of each client: ``client_id, name``."""
    return entropy_from_counts(_pair_counts(df, key), "client_id", name)


def attach_entropies(df: DataFrame, specs: list[tuple[str, str, bool]]) -> DataFrame:
    """Left-join per-key (``user=False``) and per-client (``user=True``) entropies.

    ``specs``: ``(key, column name, user)``. The pair counts of one key are computed once
    and shared by its key- and client-side entropies.
    """
    out = df
    pairs_of: dict[str, DataFrame] = {}
    per_client = []
    for key, name, user in specs:
        pairs = pairs_of.setdefault(key, _pair_counts(df, key))
        if user:
            per_client.append((name, entropy_from_counts(pairs, "client_id", name)))
        else:
            out = out.join(entropy_from_counts(pairs, key, name), key, "left")
    if per_client:
        # all client-side entropies in one table (one row per client) → a single join of
        # the wide event table instead of one join per entropy
        names = [n for n, _ in per_client]
        tagged = None
        for n, t in per_client:
            t = t.select("client_id", *[(F.col(n) if m == n else F.lit(None).cast("double")).alias(m)
                                        for m in names])
            tagged = t if tagged is None else tagged.unionByName(t)
        combined = tagged.groupBy("client_id").agg(*[F.max(n).alias(n) for n in names])
        out = out.join(combined, "client_id", "left")
    return out
