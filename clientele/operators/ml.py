"""Distributed ML operators: k-means clusters, nearest centroid, implicit ALS
factors, propensity scores, embedding probes, blend and concat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.vectors import parse_vector_lenient
from clientele.functions.scalars import signed_log1p

# Bounded side tables embedded as literals (centroids) must stay small; larger ones are an
# error rather than a silent driver-memory risk.
MAX_LITERAL_ROWS = 100_000


def _vec(col: str):
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.col(col).cast("array<double>"))


#: Components are summed as whole numbers of this fraction, which no order of rows changes.
KMEANS_UNIT = 2.0 ** -20


def _nearest(x, centres):
    """Index of each row's nearest centre (ties → lowest), one row's sums at a time, so the
    answer does not depend on which rows share a batch."""
    import numpy as np
    best = np.empty(len(x), np.int64)
    for i in range(0, len(x), 1024):
        best[i : i + 1024] = ((x[i : i + 1024, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    return best


def lloyd_step(vectors: DataFrame, centres):
    """The centres (numpy, k × width) after one assignment of all vectors and one mean; a
    centre without vectors stays. Every task sums whole numbers per centre, and the sums are
    added up exactly, so the result does not depend on the order or partitions of rows."""
    import numpy as np
    k, width = centres.shape

    def sums(parts):
        import pandas as pd
        total, n = np.zeros((k, width), object), np.zeros(k, np.int64)
        for part in parts:
            if len(part):
                x = np.vstack(part["embedding"])
                best = _nearest(x, centres)
                units = np.rint(x / KMEANS_UNIT).astype(np.int64)
                add = np.zeros((k, width), np.int64)
                np.add.at(add, best, units)
                total += add
                n += np.bincount(best, minlength=k)
        at = np.flatnonzero(n)
        if len(at):  # Arrow knows no type for a column of no lists
            yield pd.DataFrame({"centre": at, "n": n[at], "sums": [[str(v) for v in total[i]] for i in at]})

    found = (vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
             .mapInPandas(sums, "centre int, n long, sums array<string>")
             .select("centre", "n", F.posexplode("sums").alias("i", "s"))
             .groupBy("centre", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out = centres.copy()
    for r in found.collect():  # k × width rows
        out[r["centre"], r["i"]] = float(int(r["s"]) / r["n"]) * KMEANS_UNIT
    return out


def kmeans_clusters(vectors: DataFrame, key: str, k: int = C.N_CLUSTERS,
                    seed: int = C.KMEANS_SEED, max_iter: int = 20) -> DataFrame:
    """k-means over ``key, embedding`` (array of numbers of one length); returns ``key,
    cluster_id, centroid``.

    The first centres are the ``k`` distinct vectors with the smallest hashes under ``seed``
    (fewer vectors: as many centres), then up to ``max_iter`` Lloyd steps. Neither the order
    nor the partitions of the rows change the result. Only the centres go to the driver."""
    import numpy as np
    from clientele.session import materialize
    data = materialize(vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
                       .where(F.size("embedding") > 0))
    first = data.select("embedding").distinct().orderBy(F.xxhash64("embedding", F.lit(seed)), "embedding").limit(k).collect()
    if not first:
        return data.select(key, F.lit(0).cast("long").alias("cluster_id"), F.col("embedding").alias("centroid"))
    centres = np.array([r["embedding"] for r in first], float)
    for _ in range(max_iter):
        moved = lloyd_step(data, centres)
        if (moved == centres).all():
            break
        centres = moved

    def assign(parts):
        for part in parts:
            if len(part):
                yield part[[key]].assign(cluster_id=_nearest(np.vstack(part["embedding"]), centres))

    key_type = data.schema[key].dataType.simpleString()
    cent = data.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster_id long, centroid array<double>")
    pred = data.mapInPandas(assign, f"`{key}` {key_type}, cluster_id long")
    return pred.join(F.broadcast(cent), "cluster_id").select(key, "cluster_id", "centroid")


def cluster_names(properties: DataFrame, k: int = C.N_CLUSTERS, seed: int = C.KMEANS_SEED) -> DataFrame:
    v = properties.select("sku", parse_vector_lenient("name").alias("embedding"))
    return kmeans_clusters(v.where(F.col("embedding").isNotNull()), "sku", k, seed)


def cluster_queries(queries: DataFrame, k: int = C.N_CLUSTERS, seed: int = C.KMEANS_SEED) -> DataFrame:
    """``queries``: ``query_id, query`` (distinct)."""
    v = queries.select("query_id", parse_vector_lenient("query").alias("embedding"))
    return kmeans_clusters(v.where(F.col("embedding").isNotNull()), "query_id", k, seed)


def collect_bounded(df: DataFrame, what: str, limit: int = MAX_LITERAL_ROWS) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; too large to embed")
    return rows


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Assign each vector to the nearest of the given centroids (ties → smallest id).

    Centroids (``cluster_id, centroid``; k rows) are embedded as one literal array and the
    argmin is an expression per row: no join, no pairs of rows."""
    rows = collect_bounded(centroids.select("cluster_id", "centroid"), "centroids")
    lit = F.array(*[F.struct(F.lit(int(r["cluster_id"])).cast("long").alias("id"),
                             F.array(*[F.lit(float(x)) for x in r["centroid"]]).alias("c"))
                    for r in sorted(rows, key=lambda r: r["cluster_id"])])
    v = F.col(vec_col).cast("array<double>")
    dists = F.transform(lit, lambda s: F.struct(
        F.aggregate(F.zip_with(v, s["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                    lambda acc, x: acc + x).alias("d"), s["id"].alias("id")))
    best = F.array_min(dists)
    return vectors.withColumn("cluster_id", best["id"]).withColumn("distance", best["d"])


def interaction_weights(buy: DataFrame, add: DataFrame, remove: DataFrame,
                        buy_weight: float, add_weight: float, remove_weight: float,
                        item_col: str = "sku") -> DataFrame:
    """Weight per type, summed per (client, item); rows with a null id dropped."""
    parts = [df.select("client_id", F.col(item_col).alias("item"), F.lit(float(w)).alias("w"))
             for df, w in ((buy, buy_weight), (add, add_weight), (remove, remove_weight))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (u.where(F.col("client_id").isNotNull() & F.col("item").isNotNull())
            .groupBy("client_id", "item").agg(F.sum("w").alias("weight")))


def factorize_interactions(weights: DataFrame, rank: int = 16, max_iter: int = 10,
                           reg: float = 0.01, alpha: float = 1.0, seed: int = 42,
                           use_log: bool = True) -> tuple[DataFrame, DataFrame]:
    """Implicit ALS factors from ``client_id, item, weight`` (signed log1p first).

    Returns ``(client factors: client_id, factors; item factors: item, factors)``. ALS needs
    int ids, so ids are replaced by their dense index (distributed) when they do not fit.
    """
    from pyspark.ml.recommendation import ALS
    from clientele.operators.joins import contiguous_index
    w = weights.withColumn("rating", signed_log1p("weight") if use_log else F.col("weight"))
    ci = contiguous_index(w, "client_id", "u")
    ii = contiguous_index(w, "item", "i")
    data = (w.join(ci, "client_id").join(ii, "item")
            .select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float")))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
              seed=seed, userCol="u", itemCol="i", ratingCol="rating", nonnegative=False,
              coldStartStrategy="nan")
    model = als.fit(data)
    uf = model.userFactors.select(F.col("id").cast("long").alias("u"), "features")
    itf = model.itemFactors.select(F.col("id").cast("long").alias("i"), "features")
    cf = uf.join(ci, "u").select("client_id", F.col("features").alias("factors"))
    itf = itf.join(ii, "i").select("item", F.col("features").alias("factors"))
    return cf, itf


#: Clients and items of one block of the score product.
SCORE_BLOCK = 1024


def mean_vector(vectors: DataFrame, keys: list[str], col: str = "factors") -> DataFrame:
    """Element-wise means of a vector column by ``keys`` (partial sums by position)."""
    m = (vectors.select(*keys, F.posexplode(col).alias("_i", "_x"))
         .groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x")))
    return (m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s["_x"]).alias(col)))


def aggregate_factors(item_factors: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Factors of groups of items: ``item`` (the group), ``factors`` (means of its items').

    ``members``: ``item, <group>``; items without factors or without a group do not count.
    """
    j = item_factors.join(members, "item").where(F.col(group).isNotNull())
    return mean_vector(j.select(F.col(group).alias("_g"), "factors"), ["_g"]).withColumnRenamed("_g", "item")


def _score_inputs(clients: DataFrame, client_factors: DataFrame, item_factors: DataFrame,
                  targets: DataFrame, known_only: bool) -> tuple[DataFrame, DataFrame]:
    """``client_id, c`` and ``item, f`` whose products are the scores.

    The mean of a client's known scores is the product with the mean of the known items'
    factors, so an item without factors takes that mean vector; a client without factors,
    and every item when none is known, takes none (score 0).
    """
    known = targets.select("item").distinct().join(item_factors, "item", "left")
    mean = mean_vector(known.where("factors IS NOT NULL").select(F.lit(0).alias("_k"), "factors"), ["_k"])
    items = (known.withColumn("_k", F.lit(0))
             .join(F.broadcast(mean.withColumnRenamed("factors", "_mean")), "_k", "left")  # one row
             .select("item", F.coalesce("factors", "_mean").alias("f")))
    own = clients.select("client_id").distinct().join(client_factors, "client_id", "inner" if known_only else "left")
    return own.select("client_id", F.col("factors").alias("c")), items


def propensity_scores(clients: DataFrame, client_factors: DataFrame, item_factors: DataFrame,
                      targets: DataFrame, known_only: bool = False, best: int | None = None) -> DataFrame:
    """Scores ``client_id, item, score`` for clients × target items (long form), or with
    ``best`` only each client's highest ``best`` scores (ties by item ascending).

    Known item: dot product. Item without factors: mean of the client's known scores.
    Client without factors: 0 everywhere (dropped with ``known_only``). No known item: 0.

    A blocked product: clients and items are dealt to blocks by hash, every client block
    meets every item block once (a co-grouping by both numbers), and a task holds one block
    of each side and their scores (``SCORE_BLOCK`` squared). With ``best`` a block passes on
    no more than ``best`` scores of a client. Neither side is collected or sent to all tasks.
    """
    c, it = _score_inputs(clients, client_factors, item_factors, targets, known_only)
    n_c, n_i = (max(1, -(-d.count() // SCORE_BLOCK)) for d in (clients.select("client_id").distinct(), targets.select("item").distinct()))
    c = c.withColumn("_cb", F.pmod(F.xxhash64("client_id"), F.lit(n_c)).cast("int"))
    c = c.withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
    it = it.withColumn("_ib", F.pmod(F.xxhash64("item"), F.lit(n_i)).cast("int"))
    it = it.withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def matrix(vectors, width):
        import numpy as np
        m = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            if v is not None:
                m[i] = v
        return m

    def product(left, right):
        import numpy as np
        import pandas as pd
        right = right.sort_values("item")
        width = max([len(v) for side in (left["c"], right["f"]) for v in side if v is not None], default=0)
        scores = matrix(left["c"], width) @ matrix(right["f"], width).T
        ids, items = left["client_id"].to_numpy(), right["item"].to_numpy()
        if best is not None and best < len(items):
            # a stable sort keeps equal scores by item
            pick = np.argsort(-scores, axis=1, kind="stable")[:, :best]
            return pd.DataFrame({"client_id": np.repeat(ids, best), "item": items[pick].ravel(),
                                 "score": np.take_along_axis(scores, pick, axis=1).ravel()})
        return pd.DataFrame({"client_id": np.repeat(ids, len(items)), "item": np.tile(items, len(ids)), "score": scores.ravel()})

    out = c.groupBy("_cb", "_ib").cogroup(it.groupBy("_cb", "_ib")).applyInPandas(
        product, "client_id long, item long, score double")
    if best is None:
        return out
    w = Window.partitionBy("client_id").orderBy(F.desc("score"), "item")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= best).drop("_r")


def embedding_probe(train: DataFrame, test: DataFrame, label_col: str = "label",
                    max_iter: int = C.MAX_EPOCH, reg: float = 0.0) -> DataFrame:
    """Fit a logistic regression on ``client_id, embedding, label`` (train) and score the
    test set: ``client_id, score`` (raw margin). Stands in for the fixed scoring network."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    tr = train.select(_vec("embedding").alias("features"), F.col(label_col).cast("double").alias("label"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg).fit(tr)
    te = test.select("client_id", _vec("embedding").alias("features"), F.col(label_col).alias("label"))
    out = model.transform(te)
    return out.select("client_id", F.col("label").cast("int").alias("label"),
                      vector_to_array("rawPrediction")[1].alias("score"))


def embedding_probe_multilabel(train: DataFrame, test: DataFrame, embeddings: DataFrame,
                               max_iter: int = C.MAX_EPOCH, ridge: float = 1e-3) -> DataFrame:
    """Fit one logistic regression per item on ``client_id, item, target`` (train) and score
    the test set: ``client_id, item, label, score`` (raw margin). All items are fitted
    together (:class:`clientele.operators.probe.LabelProbe`); rows may lack items."""
    from clientele.operators.probe import LabelProbe
    tr, te = (t.select(F.lit("item").alias("task"), "client_id", "item", F.col("target").alias("label")) for t in (train, test))
    probe = LabelProbe(tr, embeddings, ridge=ridge)
    probe.run(max_iter)
    return probe.score(te, embeddings).drop("task")


def blend_embeddings(new: DataFrame, old: DataFrame, alpha_old: float = C.BLEND_ALPHA_OLD) -> DataFrame:
    """``alpha_old · old + (1 - alpha_old) · new`` per client; widths must match (lazy check)."""
    j = new.select("client_id", F.col("embedding").alias("_n")).join(
        old.select("client_id", F.col("embedding").alias("_o")), "client_id", "full_outer")
    bad = (F.col("_n").isNull() | F.col("_o").isNull() | (F.size("_n") != F.size("_o")))
    j = j.where(F.when(bad, F.raise_error(F.lit(
        "Current and old embeddings must have the same shape."))).otherwise(F.lit(True)))
    return j.select("client_id", F.zip_with("_o", "_n", lambda o, n: F.lit(alpha_old) * o.cast("double")
                                            + F.lit(1 - alpha_old) * n.cast("double")).alias("embedding"))


def concat_embeddings(parts: list[DataFrame], expected_width: int | None = None) -> DataFrame:
    """Concatenate per-client parts in order; client sets must match and, if given, the
    total width must equal ``expected_width`` (lazy checks, one join per part)."""
    out = parts[0].select("client_id", F.col("embedding").cast("array<double>").alias("_e0"))
    for i, p in enumerate(parts[1:], start=1):
        out = out.join(p.select("client_id", F.col("embedding").cast("array<double>").alias(f"_e{i}")),
                       "client_id", "full_outer")
    cols = [f"_e{i}" for i in range(len(parts))]
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    emb = F.concat(*[F.col(c) for c in cols])
    guard = F.when(missing, F.raise_error(F.lit("Client IDs of all parts must match.")))
    if expected_width is not None:
        guard = guard.when(F.size(emb) != expected_width, F.raise_error(F.lit(
            f"Final embeddings should have {expected_width} features per client.")))
    return out.where(guard.otherwise(F.lit(True))).select("client_id", emb.alias("embedding"))
