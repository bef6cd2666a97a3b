"""Pairwise ranking factors (Bayesian personalised ranking) over blocks of clients and items.

Clients and items are dealt to ``P`` blocks each. The pairs of blocks form ``P`` strata of
``P`` pairs that share neither a client nor an item block, so the pairs of a stratum are
fitted at the same time without conflict. A task holds one client block, one item block and
their interactions, takes small stochastic steps over them with negatives sampled from its
item block, and returns both blocks. An epoch passes all strata, and its factors are written
once. A client has at most one interaction with an item, so no client or item can fill more
than its share of a block pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.scalars import signed_log1p
from clientele.session import materialize

#: Most clients and items of a block (at 64 factors about 130 MB).
BLOCK_ROWS = 250_000
#: Interactions of one step.
BATCH = 256


def _start(table: DataFrame, key: str, blocks: int, rank: int, seed: int, kind: int) -> DataFrame:
    """``kind, id, block, f``: small factors from a hash of the id, and a bias of 0."""
    unit = lambda i: (F.pmod(F.xxhash64("id", F.lit(kind), i, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / rank
    f = F.concat(F.transform(F.sequence(F.lit(1), F.lit(rank)), unit), F.array(F.lit(0.0 if kind else 1.0)))
    return (table.select(F.col(key).alias("id")).distinct()
            .select(F.lit(kind).alias("kind"), "id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), f.alias("f")))


def sgd(users: np.ndarray, items: np.ndarray, u: np.ndarray, i: np.ndarray, rng, rate: float, reg: float) -> None:
    """One pass over the interactions (u[n], i[n]) in random order, in place. The last
    column of ``items`` is the bias; that of ``users`` stays 1. A sampled negative that the
    client has an interaction with is skipped."""
    known = np.sort(u * len(items) + i)
    order = rng.permutation(len(u))
    for at in range(0, len(order), BATCH):
        us, pos = u[order[at : at + BATCH]], i[order[at : at + BATCH]]
        neg = rng.integers(0, len(items), len(us))
        key = us * len(items) + neg
        hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
        us, pos, neg = us[~hit], pos[~hit], neg[~hit]
        a, off = users[us], items[pos] - items[neg]
        z = 1 / (1 + np.exp(np.clip((a * off).sum(axis=1), -30, 30)))[:, None]
        step = rate * (z * off - reg * a)
        step[:, -1] = 0
        up, down = rate * (z * a - reg * items[pos]), rate * (-z * a - reg * items[neg])
        np.add.at(users, us, step)
        np.add.at(items, pos, up)
        np.add.at(items, neg, down)


def factorize_ranking(weights: DataFrame, rank: int = 16, epochs: int = 15, rate: float = 0.1, reg: float = 0.01,
                      seed: int = 42, use_log: bool = True, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Ranking factors from ``client_id, item, weight``: pairs with a weight above 0 are
    preferred to the client's other items.

    Returns ``(client_id, factors; item, factors)`` of ``rank + 1`` numbers: the last ones
    are 1 and the item's bias, so the product ranks a client's items. Clients and items
    without any interaction have no factors.
    """
    w = weights.where(F.col("client_id").isNotNull() & F.col("item").isNotNull())
    w = w.withColumn("weight", signed_log1p("weight") if use_log else F.col("weight").cast("double"))
    w = materialize(w.groupBy("client_id", "item").agg(F.sum("weight").alias("weight")))
    sizes = w.agg(F.approx_count_distinct("client_id"), F.approx_count_distinct("item")).first()
    blocks = max(1, -(-max(sizes) // block_rows))
    pairs = w.where("weight > 0").select(
        F.lit(2).alias("kind"), "client_id", "item", F.pmod(F.xxhash64("client_id"), F.lit(blocks)).cast("int").alias("cb"),
        F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("ib"))
    pairs = materialize(pairs.withColumn("stratum", F.pmod(F.col("ib") - F.col("cb"), F.lit(blocks))))
    state = materialize(_start(w, "client_id", blocks, rank, seed, 0).unionByName(_start(w, "item", blocks, rank, seed, 1)))
    schema = "kind int, id long, block int, f array<double>"

    def fit(stratum: int, epoch: int):
        def run(key, group):
            import pandas as pd
            sides = [group[group["kind"] == k].sort_values("id") for k in (0, 1)]
            seen = group[group["kind"] == 2].sort_values(["id", "item"])
            ids = [s["id"].to_numpy(np.int64) for s in sides]
            factors = [np.vstack(s["f"]) if len(s) else np.zeros((0, rank + 1)) for s in sides]
            if len(seen) and len(ids[1]) > 1:
                rng = np.random.default_rng([seed, epoch, stratum, int(key[0])])
                u = np.searchsorted(ids[0], seen["id"].to_numpy(np.int64))
                i = np.searchsorted(ids[1], seen["item"].to_numpy(np.int64))
                sgd(factors[0], factors[1], u, i, rng, rate, reg)
            out = pd.concat([s[["kind", "id", "block"]] for s in sides], ignore_index=True)
            return out.assign(f=[*factors[0], *factors[1]])
        return run

    none = F.lit(None).cast("array<double>")
    for epoch in range(epochs):
        for stratum in range(blocks):
            shifted = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks)))
            rows = state.select("kind", "id", "block", "f", F.lit(None).cast("long").alias("item"), shifted.cast("int").alias("g")).unionByName(
                pairs.where(F.col("stratum") == stratum).select(
                    "kind", F.col("client_id").alias("id"), F.col("cb").alias("block"), none.alias("f"), "item", F.col("cb").alias("g")))
            state = rows.groupBy("g").applyInPandas(fit(stratum, epoch), schema)
        state = materialize(state)
    return (state.where("kind = 0").select(F.col("id").alias("client_id"), F.col("f").alias("factors")),
            state.where("kind = 1").select(F.col("id").alias("item"), F.col("f").alias("factors")))
