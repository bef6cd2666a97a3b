"""Targets, metrics and model-selection helpers, all as grouped aggregates."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import sigmoid

#: Item ids of one block of the target grid.
TARGET_BLOCK = 4096

# ---- targets --------------------------------------------------------------------------------


def churn_target(clients: DataFrame, target_events: DataFrame) -> DataFrame:
    """``client_id, target``: 1 if the client has no row in the target window, else 0."""
    seen = target_events.select("client_id").distinct().withColumn("_seen", F.lit(1))
    return (clients.select("client_id").distinct().join(seen, "client_id", "left")
            .select("client_id", F.when(F.col("_seen").isNull(), 1).otherwise(0).cast("int").alias("target")))


def propensity_target(clients: DataFrame, target_events: DataFrame, items: DataFrame,
                      column: str = "sku") -> DataFrame:
    """Multi-hot in long form ``client_id, item, target`` over the target items.

    The items' ids are sent to the clients in blocks (8 bytes an item), joined by number."""
    it = items.select("item").distinct()
    bought = (target_events.select("client_id", F.col(column).alias("item"))
              .join(it, "item", "left_semi").distinct().withColumn("_b", F.lit(1)))
    n_blocks = max(1, -(-it.count() // TARGET_BLOCK))
    blocks = (it.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("_block"))
              .agg(F.collect_list("item").alias("_items")))
    grid = (clients.select("client_id").distinct()
            .select("client_id", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
            .join(F.broadcast(blocks), "_block").select("client_id", F.explode("_items").alias("item")))
    return (grid.join(bought, ["client_id", "item"], "left")
            .select("client_id", "item", F.coalesce("_b", F.lit(0)).cast("int").alias("target")))


# ---- AUROC ----------------------------------------------------------------------------------


def auroc(scored: DataFrame, group_cols: list[str] | None = None, score_col: str = "score",
          label_col: str = "label", n_buckets: int = 64) -> DataFrame:
    """Exact AUROC with ties (average ranks) per group: ``group..., auroc, n_pos, n_neg``.

    Rows are first reduced to a histogram ``(group, score) → (pos, neg)``; then
    ``Σ pos · (neg below + neg equal / 2) / (P · N)``. The running negative count uses a
    two-level scan over global score buckets (bounds from ``approx_percentile``, one tiny
    action), so neither one group nor the ungrouped case sorts in a single task. Groups
    with one class only get null.
    """
    g = list(group_cols or [])
    hist = (scored.groupBy(*g, F.col(score_col).cast("double").alias("_s"))
            .agg(F.sum(F.col(label_col).cast("long")).alias("_pos"),
                 F.sum(1 - F.col(label_col).cast("long")).alias("_neg")))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = hist.agg(F.approx_percentile("_s", probs, 10000).alias("b")).first()["b"] or []
    bounds = sorted(set(float(b) for b in bounds))
    blit = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    hist = hist.withColumn("_bk", F.size(F.filter(blit, lambda b: b < F.col("_s"))))
    part = [*g, "_bk"]
    w_in = Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_below_in", F.coalesce(F.sum("_neg").over(w_in), F.lit(0)))
    per_bucket = hist.groupBy(*part).agg(F.sum("_neg").alias("_bn"))
    wb = (Window.partitionBy(*g).orderBy("_bk") if g else Window.orderBy("_bk")).rowsBetween(
        Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_boff", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    h = hist.join(per_bucket, part)
    contrib = F.col("_pos") * (F.col("_below_in") + F.col("_boff") + F.col("_neg") / 2.0)
    agg = h.groupBy(*g).agg(F.sum(contrib).alias("_c"), F.sum("_pos").alias("n_pos"),
                            F.sum("_neg").alias("n_neg"))
    return agg.select(*g, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                 F.col("_c") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
                      F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


def auroc_binary(scored: DataFrame) -> DataFrame:
    return auroc(scored)


def auroc_multilabel(scored: DataFrame, label_key: str = "item") -> DataFrame:
    """Per-label AUROC averaged over labels that have both classes: one row."""
    per = auroc(scored, [label_key])
    return per.agg(F.avg("auroc").alias("auroc"), F.count("auroc").cast("long").alias("n_labels"))


def auc_per_client(scored: DataFrame) -> DataFrame:
    """Mean over clients of the AUC across their items; single-class clients skipped; 0
    when no client qualifies."""
    per = auroc(scored, ["client_id"])
    return per.agg(F.coalesce(F.avg("auroc"), F.lit(0.0)).alias("auc"),
                   F.count("auroc").cast("long").alias("n_clients"))


# ---- diversity, novelty ------------------------------------------------------------------------


def diversity(scores: DataFrame, n_items: int | None = None) -> DataFrame:
    """Mean entropy of per-client normalized sigmoid scores / log2(n items)."""
    eps = C.METRIC_EPS
    s = scores.withColumn("_p", sigmoid("score"))
    tot = s.groupBy("client_id").agg(F.sum("_p").alias("_t"), F.count(F.lit(1)).alias("_n"))
    s = s.join(tot, "client_id").withColumn("_q", F.col("_p") / F.col("_t"))
    ent = s.groupBy("client_id").agg(F.sum(-F.col("_q") * F.log2(F.col("_q") + F.lit(eps))).alias("_h"),
                                     F.max("_n").alias("_n"))
    n = F.lit(float(n_items)) if n_items else F.max("_n").cast("double")
    return ent.agg((F.sum("_h") / ((F.count(F.lit(1)) + F.lit(eps)) * F.log2(n))).alias("diversity"))


def novelty(scores: DataFrame, popularity: DataFrame, k: int = C.NOVELTY_K) -> DataFrame:
    """``(1 − mean Σ_topk σ(score)·popularity / top-k popularity sum)^100``, k = min(10, n).

    ``popularity``: ``item, popularity`` over the target items (bounded list)."""
    from clientele.operators.windows import score_topk
    pops = popularity.select("item", F.col("popularity").cast("double").alias("pop"))
    n_items = pops.count()
    kk = min(k, n_items)
    top_sum = pops.orderBy(F.desc("pop")).limit(kk).agg(F.sum("pop")).first()[0] or 0.0
    top = score_topk(scores, kk).join(F.broadcast(pops), "item", "left")
    per = top.groupBy("client_id").agg(F.sum(sigmoid("score") * F.coalesce("pop", F.lit(0.0)) /
                                             F.lit(top_sum)).alias("_v"))
    return per.agg(F.pow(F.lit(1.0) - F.sum("_v") / (F.count(F.lit(1)) + F.lit(C.METRIC_EPS)),
                         F.lit(float(C.NOVELTY_POWER))).alias("novelty"))


def weighted_metric(metrics: DataFrame) -> DataFrame:
    """churn = AUROC; propensity = 0.8·AUROC + 0.1·diversity + 0.1·novelty."""
    w = C.PROPENSITY_WEIGHTS
    prop = (F.lit(w["auroc"]) * F.col("auroc") + F.lit(w["diversity"]) * F.col("diversity")
            + F.lit(w["novelty"]) * F.col("novelty"))
    return metrics.withColumn("weighted_metric", F.when(F.col("task") == "churn", F.col("auroc"))
                              .otherwise(prop))


def average_score(task_scores: DataFrame, col: str = "score") -> DataFrame:
    return task_scores.agg(F.avg(col).alias("average_score"))


def multitask_score(churn_auroc, category_auroc, sku_auroc) -> F.Column:
    w = C.MULTITASK_WEIGHTS
    return (F.lit(w["churn"]) * churn_auroc + F.lit(w["category"]) * category_auroc
            + F.lit(w["sku"]) * sku_auroc)


def bce_with_logits(x, y) -> F.Column:
    """Numerically stable ``max(x,0) − x·y + log1p(exp(−|x|))``."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def multitask_log_loss(churn: DataFrame, category: DataFrame, sku: DataFrame) -> DataFrame:
    """Weighted sum of three mean BCE-with-logits losses; inputs have ``score, label``."""
    w = C.MULTITASK_WEIGHTS

    parts = [df.select(F.lit(t).alias("_task"), F.col("score").cast("double").alias("x"),
                       F.col("label").cast("double").alias("y"))
             for t, df in (("churn", churn), ("category", category), ("sku", sku))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_l", bce_with_logits("x", "y"))
    losses = u.agg(*[F.avg(F.when(F.col("_task") == t, F.col("_l"))).alias(f"{t}_loss")
                     for t in ("churn", "category", "sku")])
    return losses.withColumn("total_loss", F.lit(w["churn"]) * F.col("churn_loss") + F.lit(w["category"])
                             * F.col("category_loss") + F.lit(w["sku"]) * F.col("sku_loss"))


# ---- all tasks at once ---------------------------------------------------------------------------

#: The item of a task without items (churn).
NO_ITEM = -1


def task_scores(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table ``task, client_id, item, label, score`` of all tasks, written once.

    ``parts``: task → ``[task,] client_id, [item,] label, score``."""
    from clientele.session import materialize
    out = None
    for task, df in parts.items():
        item = F.col("item").cast("long") if "item" in df.columns else F.lit(NO_ITEM).cast("long")
        name = F.col("task") if "task" in df.columns else F.lit(task)
        p = df.select(name.alias("task"), "client_id", item.alias("item"), F.col("label").cast("int"),
                      F.col("score").cast("double"))
        out = p if out is None else out.unionByName(p)
    return materialize(out)


def task_metrics(scores: DataFrame, popularity: DataFrame, k: int = C.NOVELTY_K) -> DataFrame:
    """One row per task of a long score table: ``task, auroc, diversity, novelty, log_loss,
    weighted_metric`` (diversity and novelty null for a task without items).

    ``popularity``: ``task, item, popularity`` over the tasks' target items. One grouping by
    (task, client) holds a client's scores of a task, as many as the task has items, and
    gives its entropy, its top-k popularity and its losses; one grouping by task reduces
    them. AUROC reduces the same table by (task, item).
    """
    eps = F.lit(C.METRIC_EPS)
    w = Window.partitionBy("task").orderBy(F.desc("popularity"), "item")
    tops = (popularity.withColumn("_r", F.row_number().over(w))
            .groupBy("task").agg(F.count(F.lit(1)).alias("n_items"), F.sum(
                F.when(F.col("_r") <= k, F.col("popularity").cast("double"))).alias("top_sum")))
    rows = (scores.join(popularity.select("task", "item", F.col("popularity").cast("double").alias("pop")), ["task", "item"], "left")
            .withColumn("_p", sigmoid("score")).withColumn("_l", bce_with_logits("score", F.col("label").cast("double"))))
    per = (rows.groupBy("task", "client_id")
           .agg(F.sum("_p").alias("_t"), F.sum("_l").alias("_l"), F.count(F.lit(1)).alias("_n"),
                F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item", F.col("_p").alias("p"),
                                                     F.coalesce("pop", F.lit(0.0)).alias("pop")))).alias("_a")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    q = lambda x: x["p"] / F.col("_t")
    per = per.select("task", "_l", "_n", total(F.col("_a"), lambda x: -q(x) * F.log2(q(x) + eps)).alias("_h"),
                     total(F.slice("_a", 1, k), lambda x: x["p"] * x["pop"]).alias("_v"))
    by_task = per.groupBy("task").agg(F.sum("_h").alias("_h"), F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_c"),
                                      (F.sum("_l") / F.sum("_n")).alias("log_loss"))
    auc = auroc(scores, ["task", "item"]).groupBy("task").agg(F.avg("auroc").alias("auroc"))
    found = (by_task.join(tops, "task", "left").join(auc, "task", "left")
             .select("task", "auroc", (F.col("_h") / ((F.col("_c") + eps) * F.log2(F.col("n_items").cast("double")))).alias("diversity"),
                     F.pow(F.lit(1.0) - F.col("_v") / F.col("top_sum") / (F.col("_c") + eps), F.lit(float(C.NOVELTY_POWER))).alias("novelty"),
                     "log_loss"))
    return weighted_metric(found.withColumns({c: F.when(F.col("task") != "churn", F.col(c)) for c in ("diversity", "novelty")}))


def by_multitask_weight(metrics: DataFrame, column: str) -> DataFrame:
    """One row ``churn, propensity_category, propensity_sku, total`` of a column of
    :func:`task_metrics`; total is the weighted sum (null if a task is missing)."""
    names = {"churn": "churn", "propensity_category": "category", "propensity_sku": "sku"}
    one = metrics.agg(*[F.max(F.when(F.col("task") == t, F.col(column))).alias(t) for t in names])
    total = sum((F.lit(C.MULTITASK_WEIGHTS[w]) * F.col(t) for t, w in names.items()), F.lit(0.0))
    return one.withColumn("total", total)


def plugin_metric(scores: DataFrame, update, merge, compute, keys: list[str]) -> DataFrame:
    """A metric of the user's by ``keys``: ``keys..., value``.

    ``update(pdf) -> list[float]`` makes the state of some rows of one group, ``merge(a, b)``
    joins two states and ``compute(state) -> float`` ends. Every task folds the rows of a
    group that it holds into one state before the shuffle, so a group with most of the rows
    sends one state from each task."""
    import pandas as pd
    fields = [scores.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def folded(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, s) for k, s in states.items()], columns=[*keys, "state"])

    def updates(parts):
        held: dict = {}
        for part in parts:
            for key, rows in part.groupby(keys, dropna=False):
                key = tuple(None if pd.isna(v) else v for v in key)
                state = [float(x) for x in update(rows)]
                held[key] = merge(held[key], state) if key in held else state
        if held:
            yield folded(held)

    def merges(parts):
        held: dict = {}
        for part in parts:
            for row in part.itertuples(index=False):
                key, state = tuple(None if pd.isna(v) else v for v in row[:-1]), list(row[-1])
                held[key] = merge(held[key], state) if key in held else state
        if held:
            out = folded(held)
            yield out[keys].assign(value=[float(compute(s)) for s in out["state"]])

    states = scores.mapInPandas(updates, f"{schema}, state array<double>")
    return states.repartition(*keys).mapInPandas(merges, f"{schema}, value double")


def reconstruction_error(x: DataFrame, recon: DataFrame, weight_col: str | None = None,
                         pad_value: float = C.PAD_VALUE) -> DataFrame:
    """Σ squared error over valid steps (any element ≠ pad) / number of valid steps.

    Long form inputs ``client_id, pos, vec`` (x) and ``client_id, pos, rvec`` (recon); with
    ``weight_col`` (on x) each step's error is multiplied by that weight."""
    j = x.join(recon, ["client_id", "pos"])
    valid = F.exists("vec", lambda v: v != F.lit(pad_value))
    se = F.aggregate(F.zip_with("vec", "rvec", lambda a, b: (b - a) * (b - a)), F.lit(0.0),
                     lambda acc, v: acc + v)
    wgt = F.col(weight_col) if weight_col else F.lit(1.0)
    return (j.where(valid)
            .agg((F.sum(se * wgt) / F.count(F.lit(1))).alias("error")))
