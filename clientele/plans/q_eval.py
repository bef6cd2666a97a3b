"""Queries for targets, metrics, validators, model selection, ML operators and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import sigmoid, signed_log1p
from clientele.operators import counts as K
from clientele.operators import joins as J
from clientele.operators import metrics as M
from clientele.operators import ml as ML
from clientele.operators import project as P
from clientele.operators import validate as V
from clientele.operators import windows as W
from clientele.operators.ranking import factorize_ranking
from clientele.plans import oracle as O
from clientele.plans.context import Ctx
from clientele.plans.registry import ORACLES, long_form, r6, register
from clientele.sources import readers as R

S = O.sql

# ------------------------------------------------------------------------------------------------
# fixture predictions: dot products of the fixed factors (FIXTURES.md section 2)
# ------------------------------------------------------------------------------------------------

def scores_sql(items: str, factors: str = "item_factors", p: str = "") -> str:
    """CTEs ``<p>dots``, ``<p>known`` and ``<p>scores`` of relevant clients × ``items``."""
    return f"""
, {p}dots AS (SELECT c.client_id, i.item,
                  list_sum(list_transform(range(1, 17), lambda k: CAST(c.factors[k] AS DOUBLE) * CAST(i.factors[k] AS DOUBLE))) AS score
           FROM client_factors c CROSS JOIN {factors} i WHERE i.item IN (SELECT item FROM {items}))
, {p}known AS (SELECT client_id, avg(score) AS mean_score FROM {p}dots GROUP BY client_id)
, {p}scores AS (
    SELECT rc.client_id, t.item,
           CASE WHEN cf.client_id IS NULL THEN 0.0
                WHEN d.score IS NOT NULL THEN d.score
                ELSE COALESCE(k.mean_score, 0.0) END AS score,
           cf.client_id IS NOT NULL AS has_factors
    FROM relevant_clients rc CROSS JOIN {items} t
    LEFT JOIN client_factors cf ON cf.client_id = rc.client_id
    LEFT JOIN {p}dots d ON d.client_id = rc.client_id AND d.item = t.item
    LEFT JOIN {p}known k ON k.client_id = rc.client_id)
"""


SCORES_SQL = scores_sql("propensity_sku")


def fixture_scores(ctx: Ctx, items, known_only: bool = False, best: int | None = None):
    return ML.propensity_scores(ctx.relevant_clients, ctx.client_factors, ctx.item_factors, items,
                                known_only=known_only, best=best)


@register("propensity_scores", S(SCORES_SQL + """
SELECT client_id, item, round(score, 6) AS score FROM scores"""))
def q_propensity_scores(spark, sf):
    ctx = Ctx(spark, sf)
    return fixture_scores(ctx, ctx.propensity_sku).withColumn("score", r6("score"))


@register("propensity_scores_known", S(SCORES_SQL + """
SELECT client_id, item, round(score, 6) AS score FROM scores WHERE has_factors"""))
def q_propensity_scores_known(spark, sf):
    ctx = Ctx(spark, sf)
    return fixture_scores(ctx, ctx.propensity_sku, known_only=True).withColumn("score", r6("score"))


@register("sigmoid_scores", S(SCORES_SQL + """
SELECT client_id, item, round(1.0 / (1.0 + exp(-score)), 6) AS probability FROM scores"""))
def q_sigmoid_scores(spark, sf):
    ctx = Ctx(spark, sf)
    s = fixture_scores(ctx, ctx.propensity_sku)
    return s.select("client_id", "item", r6(sigmoid("score")).alias("probability"))


@register("score_topk", S(SCORES_SQL + """
SELECT * FROM (SELECT client_id, item, round(score, 6) AS score,
                      row_number() OVER (PARTITION BY client_id ORDER BY score DESC, item) AS rank FROM scores)
WHERE rank <= 10"""))
def q_score_topk(spark, sf):
    ctx = Ctx(spark, sf)
    top = W.score_topk(fixture_scores(ctx, ctx.propensity_sku, best=10), 10)
    return top.select("client_id", "item", r6("score").alias("score"), F.col("rank").cast("long"))


# ------------------------------------------------------------------------------------------------
# targets
# ------------------------------------------------------------------------------------------------

VAL_SQL = """
, val AS (SELECT b.* FROM product_buy b, split s WHERE b."timestamp" >= s.val_start AND b."timestamp" <= s.end_ts)
, trn AS (SELECT b.* FROM product_buy b, split s WHERE b."timestamp" >= s.train_start AND b."timestamp" < s.val_start)
"""


def val_target(ctx: Ctx):
    return ctx.targets()[1]


@register("churn_target", S(VAL_SQL + """
SELECT a.client_id, CAST(CASE WHEN a.client_id IN (SELECT client_id FROM val) THEN 0 ELSE 1 END AS INTEGER) AS target
FROM active_clients a"""))
def q_churn_target(spark, sf):
    ctx = Ctx(spark, sf)
    return M.churn_target(ctx.active_clients, val_target(ctx))


PROP_TARGET_SQL = VAL_SQL + """
, ptgt AS (SELECT r.client_id, t.item,
                  CAST(CASE WHEN EXISTS (SELECT 1 FROM val v WHERE v.client_id = r.client_id AND v.sku = t.item)
                       THEN 1 ELSE 0 END AS INTEGER) AS target
           FROM relevant_clients r CROSS JOIN propensity_sku t)
"""


@register("propensity_target", S(PROP_TARGET_SQL + "SELECT * FROM ptgt"))
def q_propensity_target(spark, sf):
    ctx = Ctx(spark, sf)
    return M.propensity_target(ctx.relevant_clients, val_target(ctx), ctx.propensity_sku, "sku")


# ------------------------------------------------------------------------------------------------
# AUROC family
# ------------------------------------------------------------------------------------------------


def auroc_sql(src: str, group: list[str]) -> str:
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    part = f"PARTITION BY {g}" if group else ""
    return f"""
, h_{src} AS (SELECT {gsel}CAST(score AS DOUBLE) AS s, sum(label) AS pos, sum(1 - label) AS neg
              FROM {src} GROUP BY {gsel}CAST(score AS DOUBLE))
, hb_{src} AS (SELECT *, COALESCE(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
               FROM h_{src})
, auc_{src} AS (SELECT {gsel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                        THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auroc,
                       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
                FROM hb_{src} {'GROUP BY ' + g if group else ''})
"""


CHURN_SQL = VAL_SQL + """
, ch AS (SELECT a.client_id, CASE WHEN a.client_id IN (SELECT client_id FROM val) THEN 0 ELSE 1 END AS label,
                list_sum(list_transform(range(1, 17), lambda k: CAST(c.factors[k] AS DOUBLE) * CAST(i.factors[k] AS DOUBLE))) AS score
         FROM active_clients a JOIN client_factors c USING (client_id)
         CROSS JOIN (SELECT factors FROM item_factors ORDER BY item LIMIT 1) i)
"""


def churn_scored(ctx: Ctx):
    """Active clients with factors: churn label on the validation window, score = dot
    product with the factors of the first item that has some."""
    from clientele.functions.vectors import dot
    tgt = M.churn_target(ctx.active_clients, val_target(ctx)).withColumnRenamed("target", "label")
    f1 = ctx.item_factors.orderBy("item").select("factors").first()["factors"]
    c = ctx.client_factors.join(tgt, "client_id")
    return c.select("client_id", "label",
                    dot("factors", F.array(*[F.lit(float(x)) for x in f1])).alias("score"))


@register("auroc_binary", S(CHURN_SQL + auroc_sql("ch", []) + """
SELECT round(auroc, 6) AS auroc, n_pos, n_neg FROM auc_ch"""))
def q_auroc_binary(spark, sf):
    out = M.auroc_binary(churn_scored(Ctx(spark, sf)))
    return out.select(r6("auroc").alias("auroc"), "n_pos", "n_neg")


ML_SQL = SCORES_SQL + PROP_TARGET_SQL.replace(VAL_SQL, "") + """
, ml AS (SELECT s.client_id, s.item, s.score, p.target AS label FROM scores s JOIN ptgt p USING (client_id, item))
"""


def multilabel_scored(ctx: Ctx):
    s = fixture_scores(ctx, ctx.propensity_sku)
    t = M.propensity_target(ctx.relevant_clients, val_target(ctx), ctx.propensity_sku, "sku")
    return s.join(t, ["client_id", "item"]).withColumnRenamed("target", "label")


@register("auroc_multilabel", S(VAL_SQL + ML_SQL + auroc_sql("ml", ["item"]) + """
SELECT round(avg(auroc), 6) AS auroc, count(auroc) AS n_labels FROM auc_ml"""))
def q_auroc_multilabel(spark, sf):
    out = M.auroc_multilabel(multilabel_scored(Ctx(spark, sf)))
    return out.select(r6("auroc").alias("auroc"), "n_labels")


@register("auc_per_client", S(VAL_SQL + ML_SQL + """
, kn AS (SELECT * FROM ml WHERE client_id IN (SELECT client_id FROM client_factors)
                           AND item IN (SELECT item FROM item_factors))
""" + auroc_sql("kn", ["client_id"]) + """
SELECT round(COALESCE(avg(auroc), 0.0), 6) AS auc, count(auroc) AS n_clients FROM auc_kn"""))
def q_auc_per_client(spark, sf):
    ctx = Ctx(spark, sf)
    sc = multilabel_scored(ctx).join(ctx.client_factors.select("client_id"), "client_id", "left_semi") \
        .join(ctx.item_factors.select("item"), "item", "left_semi")
    out = M.auc_per_client(sc)
    return out.select(r6("auc").alias("auc"), "n_clients")


@register("diversity", S(SCORES_SQL + """
, sg AS (SELECT client_id, 1.0 / (1.0 + exp(-score)) AS p FROM scores)
, nq AS (SELECT sg.client_id, p / sum(p) OVER (PARTITION BY client_id) AS q FROM sg)
, he AS (SELECT client_id, sum(-q * log2(q + 1e-9)) AS h FROM nq GROUP BY client_id)
SELECT round(sum(h) / ((count(*) + 1e-9) * log2((SELECT count(*) FROM propensity_sku))), 6) AS diversity FROM he"""))
def q_diversity(spark, sf):
    ctx = Ctx(spark, sf)
    out = M.diversity(fixture_scores(ctx, ctx.propensity_sku), n_items=O.PROP_SKU_N)
    return out.select(r6("diversity").alias("diversity"))


NOV_SQL = SCORES_SQL + """
, pop AS (SELECT t.item, CAST(COALESCE(c.n, 0) AS DOUBLE) AS pop FROM propensity_sku t
          LEFT JOIN (SELECT sku AS item, count(*) AS n FROM input_buys GROUP BY sku) c USING (item))
, topsum AS (SELECT sum(pop) AS ts FROM (SELECT pop FROM pop ORDER BY pop DESC LIMIT 10))
, topk AS (SELECT * FROM (SELECT client_id, item, score,
                                 row_number() OVER (PARTITION BY client_id ORDER BY score DESC, item) AS rk FROM scores)
           WHERE rk <= 10)
, per AS (SELECT client_id, sum(1.0 / (1.0 + exp(-score)) * pop.pop / (SELECT ts FROM topsum)) AS v
          FROM topk JOIN pop USING (item) GROUP BY client_id)
, nov AS (SELECT pow(1.0 - sum(v) / (count(*) + 1e-9), 100) AS novelty FROM per)
"""


def popularity_of_targets(ctx: Ctx):
    pop = K.item_popularity(ctx.input_buys)
    return ctx.propensity_sku.join(pop, "item", "left").select(
        "item", F.coalesce("popularity", F.lit(0)).alias("popularity"))


@register("novelty", S(NOV_SQL + "SELECT round(novelty, 6) AS novelty FROM nov"))
def q_novelty(spark, sf):
    ctx = Ctx(spark, sf)
    out = M.novelty(fixture_scores(ctx, ctx.propensity_sku), popularity_of_targets(ctx))
    return out.select(r6("novelty").alias("novelty"))


# ------------------------------------------------------------------------------------------------
# all three tasks: churn, category and sku propensity
# ------------------------------------------------------------------------------------------------

TASKS_SQL = VAL_SQL + CHURN_SQL.replace(VAL_SQL, "") + SCORES_SQL + scores_sql("propensity_category", "category_factors", "c") + """
, vcat AS (SELECT v.client_id, p.category FROM val v JOIN product_properties p USING (sku))
, ts AS (
    SELECT 'churn' AS task, client_id, CAST(-1 AS BIGINT) AS item, score, label FROM ch
    UNION ALL SELECT 'propensity_sku', client_id, item, score,
           CASE WHEN EXISTS (SELECT 1 FROM val v WHERE v.client_id = scores.client_id AND v.sku = scores.item) THEN 1 ELSE 0 END FROM scores
    UNION ALL SELECT 'propensity_category', client_id, item, score,
           CASE WHEN EXISTS (SELECT 1 FROM vcat v WHERE v.client_id = cscores.client_id AND v.category = cscores.item) THEN 1 ELSE 0 END FROM cscores)
""" + auroc_sql("ts", ["task", "item"]) + """
, pop AS (
    SELECT 'propensity_sku' AS task, t.item, CAST(COALESCE(c.n, 0) AS DOUBLE) AS pop FROM propensity_sku t
    LEFT JOIN (SELECT sku AS item, count(*) AS n FROM input_buys GROUP BY sku) c USING (item)
    UNION ALL SELECT 'propensity_category', t.item, CAST(COALESCE(c.n, 0) AS DOUBLE) FROM propensity_category t
    LEFT JOIN (SELECT p.category AS item, count(*) AS n FROM input_buys b JOIN product_properties p USING (sku) GROUP BY 1) c USING (item))
, tops AS (SELECT task, count(*) AS n_items, sum(pop) FILTER (WHERE rk <= 10) AS ts FROM (
             SELECT *, row_number() OVER (PARTITION BY task ORDER BY pop DESC) AS rk FROM pop) GROUP BY task)
, sg AS (SELECT ts.*, 1.0 / (1.0 + exp(-score)) AS p FROM ts WHERE task <> 'churn')
, nq AS (SELECT task, client_id, p / sum(p) OVER (PARTITION BY task, client_id) AS q FROM sg)
, he AS (SELECT task, client_id, sum(-q * log2(q + 1e-9)) AS h FROM nq GROUP BY task, client_id)
, dv AS (SELECT task, sum(h) / ((count(*) + 1e-9) * log2(any_value(n_items))) AS diversity FROM he JOIN tops USING (task) GROUP BY task)
, tk AS (SELECT *, row_number() OVER (PARTITION BY task, client_id ORDER BY score DESC, item) AS rk FROM sg)
, pv AS (SELECT task, client_id, sum(p * pop / tops.ts) AS v FROM tk JOIN pop USING (task, item) JOIN tops USING (task) WHERE rk <= 10 GROUP BY task, client_id)
, nv AS (SELECT task, pow(1.0 - sum(v) / (count(*) + 1e-9), 100) AS novelty FROM pv GROUP BY task)
, ll AS (SELECT task, avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))) AS log_loss FROM ts GROUP BY task)
, tm AS (SELECT ll.task, a.auroc, dv.diversity, nv.novelty, ll.log_loss FROM ll
         LEFT JOIN (SELECT task, avg(auroc) AS auroc FROM auc_ts GROUP BY task) a USING (task)
         LEFT JOIN dv USING (task) LEFT JOIN nv USING (task))
, wm AS (SELECT *, CASE WHEN task = 'churn' THEN auroc ELSE 0.8 * auroc + 0.1 * diversity + 0.1 * novelty END AS weighted_metric FROM tm)
"""


def task_popularity(ctx: Ctx):
    """Purchases in the input of both tasks' target items: ``task, item, popularity``."""
    sku = popularity_of_targets(ctx).select(F.lit("propensity_sku").alias("task"), "item", "popularity")
    buys = ctx.input_buys.join(ctx.product_properties.select("sku", "category"), "sku")
    pop = K.item_popularity(buys.select("client_id", "timestamp", F.col("category").alias("sku")))
    cat = ctx.propensity_category.join(pop, "item", "left").select(
        F.lit("propensity_category").alias("task"), "item", F.coalesce("popularity", F.lit(0)).alias("popularity"))
    return sku.unionByName(cat)


def category_scored(ctx: Ctx):
    """Scores of category factors with the category labels of the validation window."""
    s = ML.propensity_scores(ctx.relevant_clients, ctx.client_factors, ctx.category_factors, ctx.propensity_category)
    t = M.propensity_target(ctx.relevant_clients, val_target(ctx), ctx.propensity_category, "category")
    return s.join(t, ["client_id", "item"]).withColumnRenamed("target", "label")


def all_task_scores(ctx: Ctx):
    return M.task_scores({"churn": churn_scored(ctx), "propensity_category": category_scored(ctx), "propensity_sku": multilabel_scored(ctx)})


def task_metrics(ctx: Ctx):
    return M.task_metrics(all_task_scores(ctx), task_popularity(ctx))


@register("weighted_metric", S(TASKS_SQL + """
SELECT task, round(auroc, 6) AS auroc, round(diversity, 6) AS diversity, round(novelty, 6) AS novelty,
       round(weighted_metric, 6) AS weighted_metric FROM wm"""))
def q_weighted_metric(spark, sf):
    out = task_metrics(Ctx(spark, sf))
    return out.select("task", *[r6(c).alias(c) for c in ["auroc", "diversity", "novelty", "weighted_metric"]])


@register("average_score", S(TASKS_SQL + "SELECT round(avg(weighted_metric), 6) AS average_score FROM wm"))
def q_average_score(spark, sf):
    wm = task_metrics(Ctx(spark, sf))
    return M.average_score(wm, "weighted_metric").select(r6("average_score").alias("average_score"))


def by_task_sql(column: str) -> str:
    return f"""(SELECT {column} FROM wm WHERE task = 'churn') AS churn, (SELECT {column} FROM wm WHERE task = 'propensity_category') AS category,
       (SELECT {column} FROM wm WHERE task = 'propensity_sku') AS sku"""


@register("multitask_score", S(TASKS_SQL + f"""
SELECT round(0.3 * churn + 0.35 * category + 0.35 * sku, 6) AS multitask_score FROM (SELECT {by_task_sql("auroc")})"""))
def q_multitask_score(spark, sf):
    out = M.by_multitask_weight(task_metrics(Ctx(spark, sf)), "auroc")
    return out.select(r6("total").alias("multitask_score"))


@register("multitask_log_loss", S(TASKS_SQL + f"""
SELECT round(churn, 6) AS churn_loss, round(category, 6) AS category_loss, round(sku, 6) AS sku_loss,
       round(0.3 * churn + 0.35 * category + 0.35 * sku, 6) AS total_loss FROM (SELECT {by_task_sql("log_loss")})"""))
def q_multitask_log_loss(spark, sf):
    out = M.by_multitask_weight(task_metrics(Ctx(spark, sf)), "log_loss")
    return out.select(r6("churn").alias("churn_loss"), r6("propensity_category").alias("category_loss"),
                      r6("propensity_sku").alias("sku_loss"), r6("total").alias("total_loss"))


@register("plugin_metric", S(TASKS_SQL + """
SELECT task, round(avg((1.0 / (1.0 + exp(-score)) - label) * (1.0 / (1.0 + exp(-score)) - label)), 6) AS value FROM ts GROUP BY task"""))
def q_plugin_metric(spark, sf):
    """A user's metric (mean squared error of the probability) with mergeable states."""
    def update(rows):
        p = 1 / (1 + np.exp(-rows["score"].to_numpy()))
        return [float(((p - rows["label"].to_numpy()) ** 2).sum()), len(rows)]

    out = M.plugin_metric(all_task_scores(Ctx(spark, sf)), update, lambda a, b: [x + y for x, y in zip(a, b)],
                          lambda s: s[0] / s[1], ["task"])
    return out.select("task", r6("value").alias("value"))


# reconstruction errors: x = one-hot + time encoding of each event, recon = previous event's
RECON_SQL = """
, allev AS (SELECT client_id, "timestamp", event_type FROM products
            UNION ALL SELECT client_id, "timestamp", 'page_visit' FROM page_visit
            UNION ALL SELECT client_id, "timestamp", 'search_query' FROM search_query)
, xs AS (SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY "timestamp") - 1 AS INTEGER) AS pos,
                [CAST(event_type = 'product_buy' AS DOUBLE), CAST(event_type = 'add_to_cart' AS DOUBLE),
                 CAST(event_type = 'remove_from_cart' AS DOUBLE), CAST(event_type = 'page_visit' AS DOUBLE),
                 CAST(event_type NOT IN ('product_buy', 'add_to_cart', 'remove_from_cart', 'page_visit') AS DOUBLE),
                 hour("timestamp") / 23.0 * 2 - 1] AS vec FROM allev)
, rs AS (SELECT client_id, pos + 1 AS pos, vec AS rvec FROM xs)
, se AS (SELECT xs.client_id, list_sum(list_transform(range(1, 7), lambda k: (rs.rvec[k] - xs.vec[k]) * (rs.rvec[k] - xs.vec[k]))) AS e
         FROM xs JOIN rs USING (client_id, pos))
"""


def recon_inputs(ctx: Ctx):
    from clientele.functions.scalars import event_type_onehot
    from clientele.operators import encode as EN
    from clientele.plans.q_profile import all_events
    seq = EN.client_sequences(all_events(ctx))
    x = seq.select("client_id", "pos", F.concat(event_type_onehot("event_type").cast("array<double>"),
                                                 F.array(F.hour("timestamp") / 23.0 * 2 - 1)).alias("vec"))
    recon = x.select("client_id", (F.col("pos") + 1).alias("pos"), F.col("vec").alias("rvec"))
    return x, recon


@register("masked_reconstruction_error", S(RECON_SQL + "SELECT round(sum(e) / count(*), 6) AS error FROM se"))
def q_masked_reconstruction_error(spark, sf):
    x, r = recon_inputs(Ctx(spark, sf))
    return M.reconstruction_error(x, r).select(r6("error").alias("error"))


@register("weighted_reconstruction_error", S(RECON_SQL + """
, w AS (SELECT client_id, CASE WHEN client_id IN (SELECT client_id FROM active_clients) THEN 1.0 ELSE 0.8 END AS wt
        FROM (SELECT DISTINCT client_id FROM allev))
SELECT round(sum(e * wt) / count(*), 6) AS error FROM se JOIN w USING (client_id)"""))
def q_weighted_reconstruction_error(spark, sf):
    # clients without a purchase before the target window have a default future → 0.8
    ctx = Ctx(spark, sf)
    x, r = recon_inputs(ctx)
    act = ctx.active_clients.withColumn("_act", F.lit(True))
    x = x.join(act, "client_id", "left").withColumn(
        "wt", F.when(F.col("_act").isNull(), F.lit(C.DEFAULT_FUTURE_WEIGHT)).otherwise(F.lit(1.0)))
    return M.reconstruction_error(x, r, "wt").select(r6("error").alias("error"))


# ------------------------------------------------------------------------------------------------
# model selection
# ------------------------------------------------------------------------------------------------

BE_SQL = """
, allev AS (SELECT client_id, "timestamp", event_type FROM products
            UNION ALL SELECT client_id, "timestamp", 'page_visit' FROM page_visit
            UNION ALL SELECT client_id, "timestamp", 'search_query' FROM search_query)
, em AS (SELECT event_type AS task, CAST(weekofyear("timestamp") - 1 AS INTEGER) AS epoch,
                CAST(count(*) AS DOUBLE) / count(DISTINCT client_id) AS weighted_metric
         FROM allev GROUP BY 1, 2)
, be AS (SELECT task, epoch AS best_epoch, round(weighted_metric, 6) AS best_score FROM (
           SELECT *, row_number() OVER (PARTITION BY task ORDER BY weighted_metric DESC, epoch) AS r FROM em) WHERE r = 1)
"""


def epoch_metrics(ctx: Ctx):
    """Per event kind (task) and ISO week (epoch): events per active client that week."""
    from clientele.plans.q_profile import all_events
    ev = all_events(ctx)
    return (ev.groupBy(F.col("event_type").alias("task"),
                       (F.weekofyear("timestamp") - 1).cast("int").alias("epoch"))
            .agg((F.count(F.lit(1)) / F.count_distinct("client_id")).alias("weighted_metric")))


@register("best_epoch", S(BE_SQL + "SELECT * FROM be"))
def q_best_epoch(spark, sf):
    out = W.best_epoch(epoch_metrics(Ctx(spark, sf)), n_epochs=5)
    return out.withColumn("best_score", r6("best_score"))


@register("sink_scores", S(BE_SQL + "SELECT * FROM be"))
def q_sink_scores(spark, sf):
    best = W.best_epoch(epoch_metrics(Ctx(spark, sf)), n_epochs=5)
    return R.sink_scores(best).withColumn("best_score", r6("best_score"))


# ------------------------------------------------------------------------------------------------
# validators (embedding table = fixture client factors; relevant clients = even ids)
# ------------------------------------------------------------------------------------------------

VAL_EMB_SQL = """
, emb AS (SELECT client_id, factors AS embedding FROM client_factors)
, st AS (SELECT count(*) AS n, count(DISTINCT client_id) AS nd,
                max(len(embedding)) AS maxw,
                count(*) FILTER (WHERE list_bool_or(list_transform(embedding, lambda x: isnan(x)))) AS n_nan,
                count(*) FILTER (WHERE list_bool_or(list_transform(embedding, lambda x: isinf(x)))) AS n_inf,
                count(*) FILTER (WHERE embedding IS NULL) AS n_null,
                (SELECT count(*) FROM relevant_clients) AS n_rel,
                (SELECT count(*) FROM relevant_clients WHERE client_id NOT IN (SELECT client_id FROM emb)) AS n_missing
         FROM emb)
, msgs AS (
    SELECT 'client_ids' AS check_group, CASE WHEN NOT (n = n_rel AND n_missing = 0 AND nd = n)
           THEN 'client ids are not a permutation of relevant clients' END AS message FROM st
    UNION ALL SELECT 'embeddings', CASE WHEN maxw > 2048 THEN 'maximum embeddings dimensionality i.e. 2048 has been exceeded'
           WHEN n_nan > 0 THEN 'embeddings should not contain nans' WHEN n_inf > 0 THEN 'embeddings should not contain infs' END FROM st)
"""


def fixture_embeddings(ctx: Ctx):
    return ctx.client_factors.select("client_id", F.col("factors").alias("embedding"))


@register("validate_client_ids", S(VAL_EMB_SQL + """
SELECT message FROM msgs WHERE check_group = 'client_ids' AND message IS NOT NULL"""))
def q_validate_client_ids(spark, sf):
    ctx = Ctx(spark, sf)
    emb = fixture_embeddings(ctx)
    st = V.embedding_stats(emb, ctx.relevant_clients)
    msg = V.validate_client_ids(emb, st)
    return spark.createDataFrame([(msg,)] if msg else [], "message string")


@register("validate_embeddings", S(VAL_EMB_SQL + """
SELECT message FROM msgs WHERE check_group = 'embeddings' AND message IS NOT NULL"""))
def q_validate_embeddings(spark, sf):
    ctx = Ctx(spark, sf)
    emb = fixture_embeddings(ctx)
    msg = V.validate_embeddings(emb, V.embedding_stats(emb, None))
    return spark.createDataFrame([(msg,)] if msg else [], "message string")


@register("validate_consistency", S(VAL_EMB_SQL + """
SELECT CASE WHEN n_null > 0 THEN 'client ids and embeddings have different lengths' END AS message
FROM st WHERE n_null > 0"""))
def q_validate_consistency(spark, sf):
    ctx = Ctx(spark, sf)
    emb = fixture_embeddings(ctx)
    msg = V.validate_consistency(V.embedding_stats(emb, None))
    return spark.createDataFrame([(msg,)] if msg else [], "message string")


@register("validation_report", S(VAL_EMB_SQL + """
SELECT CAST(row_number() OVER (ORDER BY CASE check_group WHEN 'client_ids' THEN 1 ELSE 2 END) AS INTEGER) AS position,
       check_group, message FROM msgs WHERE message IS NOT NULL"""))
def q_validation_report(spark, sf):
    ctx = Ctx(spark, sf)
    return V.validation_report(fixture_embeddings(ctx), ctx.relevant_clients)


@register("restrict_active", S("""
SELECT c.client_id, CAST(k - 1 AS INTEGER) AS pos, round(CAST(c.factors[k] AS DOUBLE), 6) AS value
FROM client_factors c, range(1, 17) r(k) WHERE c.client_id IN (SELECT client_id FROM active_clients)"""))
def q_restrict_active(spark, sf):
    ctx = Ctx(spark, sf)
    return long_form(P.restrict_active(fixture_embeddings(ctx), ctx.active_clients), ["client_id"], "embedding")


@register("sort_embeddings", S("""
SELECT c.client_id, CAST(k - 1 AS INTEGER) AS pos, round(CAST(c.factors[k] AS DOUBLE), 6) AS value
FROM client_factors c, range(1, 17) r(k) ORDER BY client_id, pos"""))
def q_sort_embeddings(spark, sf):
    return long_form(W.sort_embeddings(fixture_embeddings(Ctx(spark, sf))), ["client_id"], "embedding")


@register("sink_embeddings", S("""
SELECT c.client_id, CAST(k - 1 AS INTEGER) AS pos, round(CAST(c.factors[k] AS DOUBLE), 6) AS value
FROM client_factors c, range(1, 17) r(k)"""))
def q_sink_embeddings(spark, sf):
    return long_form(R.sink_embeddings(fixture_embeddings(Ctx(spark, sf))), ["client_id"], "embedding")


# ------------------------------------------------------------------------------------------------
# blend, concat, alignment
# ------------------------------------------------------------------------------------------------

PAIR_SQL = """
, old_e AS (SELECT c.client_id, e.folded AS v FROM client_factors c
            JOIN vf e ON e.vec_id = (c.client_id + 200) % (SELECT count(*) FROM embeddings))
, new_e AS (SELECT client_id, factors AS v FROM client_factors)
"""


def emb_pair(ctx: Ctx):
    """new = fixed client factors; old = another vector of the same client (200 further on)."""
    new = fixture_embeddings(ctx)
    return new, ctx._vector_of(new.select("client_id"), "client_id", 200, "embedding")


@register("blend_embeddings", S(PAIR_SQL + """
SELECT n.client_id, CAST(k - 1 AS INTEGER) AS pos,
       round(0.3 * CAST(o.v[k] AS DOUBLE) + 0.7 * CAST(n.v[k] AS DOUBLE), 6) AS value
FROM new_e n JOIN old_e o USING (client_id), range(1, 17) r(k)"""))
def q_blend_embeddings(spark, sf):
    new, old = emb_pair(Ctx(spark, sf))
    return long_form(ML.blend_embeddings(new, old), ["client_id"], "embedding")


@register("concat_embeddings", S(PAIR_SQL + """
SELECT n.client_id, CAST(k - 1 AS INTEGER) AS pos, round(CAST(list_concat(n.v, o.v)[k] AS DOUBLE), 6) AS value
FROM new_e n JOIN old_e o USING (client_id), range(1, 33) r(k)"""))
def q_concat_embeddings(spark, sf):
    new, old = emb_pair(Ctx(spark, sf))
    return long_form(ML.concat_embeddings([new, old], expected_width=32), ["client_id"], "embedding")


@register("align_embeddings", S(PAIR_SQL + """
SELECT client_id, CAST(len(n.v) AS INTEGER) AS width_a, CAST(len(o.v) AS INTEGER) AS width_b FROM new_e n JOIN old_e o USING (client_id)"""))
def q_align_embeddings(spark, sf):
    new, old = emb_pair(Ctx(spark, sf))
    a = J.align_embeddings(new, old)
    return a.select("client_id", F.size("a").alias("width_a"), F.size("b").alias("width_b"))


@register("hybrid_profile", S(PAIR_SQL + """
SELECT n.client_id, 48 AS width FROM new_e n JOIN old_e o USING (client_id)"""))
def q_hybrid_profile(spark, sf):
    """align → blend → concat → width check (fixture parts)."""
    new, old = emb_pair(Ctx(spark, sf))
    blended = ML.blend_embeddings(new, old)
    out = ML.concat_embeddings([blended, new, old], expected_width=48)
    return out.select("client_id", F.size("embedding").alias("width"))


@register("align_history_future", S(VAL_SQL + """
, fut AS (SELECT client_id, count(*) AS n FROM val GROUP BY client_id)
SELECT r.client_id, COALESCE(f.n, 1) AS n_future, f.n IS NULL AS is_default
FROM relevant_clients r LEFT JOIN fut f USING (client_id)"""))
def q_align_history_future(spark, sf):
    from clientele.operators import encode as EN
    ctx = Ctx(spark, sf)
    fut = EN.client_sequences(val_target(ctx).select("client_id", "timestamp", "sku"))
    out = J.align_history_future(ctx.relevant_clients, fut, {"pos": 0, "sku": 0})
    return (out.groupBy("client_id", "is_default")
            .agg(F.count(F.lit(1)).cast("long").alias("n_future")))


# ------------------------------------------------------------------------------------------------
# interactions, clustering, factorization, probes
# ------------------------------------------------------------------------------------------------

WEIGHTS = (1.0, 0.5, -0.5)


@register("interaction_weights", S("""
SELECT client_id, item, round(sum(w), 6) AS weight FROM (
  SELECT client_id, sku AS item, CAST(1.0 AS DOUBLE) AS w FROM product_buy
  UNION ALL SELECT client_id, sku, CAST(0.5 AS DOUBLE) FROM add_to_cart
  UNION ALL SELECT client_id, sku, CAST(-0.5 AS DOUBLE) FROM remove_from_cart) GROUP BY client_id, item"""))
def q_interaction_weights(spark, sf):
    ctx = Ctx(spark, sf)
    w = ML.interaction_weights(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart, *WEIGHTS)
    return w.withColumn("weight", r6("weight"))


@register("signed_log1p", S("""
SELECT client_id, item, round(sign(w) * ln(1 + abs(w)), 6) AS weight FROM (
  SELECT client_id, item, sum(w) AS w FROM (
    SELECT client_id, sku AS item, 1.0 AS w FROM product_buy UNION ALL SELECT client_id, sku, 0.5 FROM add_to_cart
    UNION ALL SELECT client_id, sku, -0.5 FROM remove_from_cart) GROUP BY client_id, item)"""))
def q_signed_log1p(spark, sf):
    ctx = Ctx(spark, sf)
    w = ML.interaction_weights(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart, *WEIGHTS)
    return w.select("client_id", "item", r6(signed_log1p("weight")).alias("weight"))


@register("time_decay", S("""
, mx AS (SELECT max("timestamp") AS m FROM products)
SELECT client_id, "timestamp", sku, event_type,
       round(exp(-0.06 * (((epoch_us(m) - epoch_us("timestamp")) // 86400000000) / 7.0)), 6) AS decay
FROM products CROSS JOIN mx"""))
def q_time_decay(spark, sf):
    from clientele.functions.scalars import time_decay
    from clientele.operators import encode as EN
    t = EN.temporal_features(Ctx(spark, sf).products)
    return t.select("client_id", "timestamp", "sku", "event_type",
                    r6(time_decay("weeks_since_test_start")).alias("decay"))


@register("event_type_onehot", S("""
SELECT client_id, "timestamp", event_type,
       CAST(event_type = 'product_buy' AS INTEGER) AS slot_buy, CAST(event_type = 'add_to_cart' AS INTEGER) AS slot_add,
       CAST(event_type = 'remove_from_cart' AS INTEGER) AS slot_remove, CAST(event_type = 'page_visit' AS INTEGER) AS slot_visit,
       CAST(event_type NOT IN ('product_buy', 'add_to_cart', 'remove_from_cart', 'page_visit') AS INTEGER) AS slot_other
FROM (SELECT client_id, "timestamp", event_type FROM products
      UNION ALL SELECT client_id, "timestamp", 'page_visit' FROM page_visit
      UNION ALL SELECT client_id, "timestamp", 'search_query' FROM search_query)"""))
def q_event_type_onehot(spark, sf):
    from clientele.functions.scalars import event_type_onehot
    from clientele.plans.q_profile import all_events
    e = all_events(Ctx(spark, sf)).withColumn("_oh", event_type_onehot("event_type"))
    return e.select("client_id", "timestamp", "event_type",
                    *[F.col("_oh")[i].alias(n) for i, n in enumerate(
                        ["slot_buy", "slot_add", "slot_remove", "slot_visit", "slot_other"])])


CENT_SQL = """
, nv AS (SELECT sku, list_transform(list_filter(string_split(replace(replace(name, '[', ''), ']', ''), ' '),
                lambda s: s <> ''), lambda s: CAST(s AS DOUBLE)) AS v FROM product_properties)
, lv AS (SELECT vt.label, list_transform(list_filter(string_split(replace(replace(vt.vtext, '[', ''), ']', ''), ' '),
                lambda s: s <> ''), lambda s: CAST(s AS DOUBLE)) AS v FROM vt)
, cent AS (SELECT CAST(label AS BIGINT) AS cluster_id, CAST(k - 1 AS INTEGER) AS d, avg(v[k]) AS c
           FROM lv, range(1, 17) r(k) GROUP BY label, k)
, dist AS (SELECT nv.sku, cent.cluster_id, sum((nv.v[cent.d + 1] - cent.c) * (nv.v[cent.d + 1] - cent.c)) AS dd
           FROM nv CROSS JOIN cent GROUP BY nv.sku, cent.cluster_id)
"""


def label_centroids(ctx: Ctx):
    """Fixed centroids: per ``embeddings.label`` the mean quantized vector (bounded: labels)."""
    from clientele.functions.vectors import parse_vector_strict
    v = ctx.vector_texts.select("label", F.posexplode(parse_vector_strict("vtext")).alias("d", "x"))
    m = v.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy(F.col("label").cast("long").alias("cluster_id"))
            .agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("_s"))
            .select("cluster_id", F.transform("_s", lambda s: s["x"]).alias("centroid")))


@register("nearest_centroid", S(CENT_SQL + """
SELECT sku, cluster_id, round(dd, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY dd, cluster_id) AS r FROM dist) WHERE r = 1"""))
def q_nearest_centroid(spark, sf):
    from clientele.functions.vectors import parse_vector_strict
    ctx = Ctx(spark, sf)
    v = ctx.product_properties.select("sku", parse_vector_strict("name").alias("embedding"))
    out = ML.nearest_centroid(v, label_centroids(ctx))
    return out.select("sku", "cluster_id", r6("distance").alias("distance"))


@register("lloyd_step", S(CENT_SQL + """
, own AS (SELECT sku, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY dd, cluster_id) AS r FROM dist) WHERE r = 1)
, moved AS (SELECT own.cluster_id, CAST(k - 1 AS INTEGER) AS d, avg(nv.v[k]) AS c
            FROM own JOIN nv USING (sku), range(1, 17) r(k) GROUP BY own.cluster_id, k)
SELECT cent.cluster_id, cent.d AS pos, round(COALESCE(moved.c, cent.c), 4) AS value FROM cent LEFT JOIN moved USING (cluster_id, d)"""))
def q_lloyd_step(spark, sf):
    """One k-means step over the product names from the label means."""
    from clientele.functions.vectors import parse_vector_strict
    ctx = Ctx(spark, sf)
    rows = ML.collect_bounded(label_centroids(ctx).orderBy("cluster_id"), "centroids")
    v = ctx.product_properties.select("sku", parse_vector_strict("name").alias("embedding"))
    moved = ML.lloyd_step(v, np.array([r["centroid"] for r in rows]))
    out = spark.createDataFrame([(int(r["cluster_id"]), [float(x) for x in c]) for r, c in zip(rows, moved)],
                                "cluster_id long, centroid array<double>")
    return long_form(out, ["cluster_id"], "centroid").withColumn("value", F.round("value", 4))


@register("cluster_names")
def q_cluster_names(spark, sf):
    out = ML.cluster_names(Ctx(spark, sf).product_properties)
    return out.select("sku", "cluster_id", F.size("centroid").alias("dim"))


@register("cluster_queries")
def q_cluster_queries(spark, sf):
    ctx = Ctx(spark, sf)
    q = W.distinct_queries(ctx.search_query)
    out = ML.cluster_queries(q)
    return out.select("query_id", "cluster_id", F.size("centroid").alias("dim"))


def factor_profile(ctx: Ctx, rank: int = 8, epochs: int = 5, category: bool = False):
    """interactions → signed log → ranking factors → scores for relevant clients × targets."""
    buy, add, rem = ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart
    items = ctx.propensity_sku
    if category:
        buy, add, rem = (J.category_as_item(d, ctx.product_properties) for d in (buy, add, rem))
        items = ctx.propensity_category
    w = ML.interaction_weights(P.split_input(buy, ctx.split[0]), P.split_input(add, ctx.split[0]),
                               P.split_input(rem, ctx.split[0]), *WEIGHTS)
    cf, itf = factorize_ranking(w, rank=rank, epochs=epochs)
    return ML.propensity_scores(ctx.relevant_clients, cf, itf, items)


@register("factorize_interactions")
def q_factorize_interactions(spark, sf):
    ctx = Ctx(spark, sf)
    w = ML.interaction_weights(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart, *WEIGHTS)
    cf, itf = factorize_ranking(w, rank=8, epochs=5)
    return (cf.select(F.lit("client").alias("side"), F.col("client_id").alias("id"), F.size("factors").alias("rank"))
            .unionByName(itf.select(F.lit("item").alias("side"), F.col("item").alias("id"),
                                    F.size("factors").alias("rank"))))


@register("factor_profile")
def q_factor_profile(spark, sf):
    return factor_profile(Ctx(spark, sf)).withColumn("score", r6("score"))


def probe_sets(ctx: Ctx):
    """Train on the train-window churn label, evaluate on the validation window."""
    emb = fixture_embeddings(ctx)
    tr_t, va_t = ctx.targets()
    act = ctx.active_clients
    tr = M.churn_target(act, tr_t).withColumnRenamed("target", "label").join(emb, "client_id")
    te = M.churn_target(act, va_t).withColumnRenamed("target", "label").join(emb, "client_id")
    return tr, te


@register("embedding_probe_churn")
def q_embedding_probe_churn(spark, sf):
    tr, te = probe_sets(Ctx(spark, sf))
    scored = ML.embedding_probe(tr, te)
    return M.auroc_binary(scored).select(F.lit("churn").alias("task"), "auroc", "n_pos", "n_neg")


@register("embedding_probe_propensity")
def q_embedding_probe_propensity(spark, sf):
    ctx = Ctx(spark, sf)
    emb = fixture_embeddings(ctx)
    tr_t, va_t = ctx.targets()
    items = ctx.propensity_sku
    ttr = M.propensity_target(ctx.relevant_clients, tr_t, items)
    tte = M.propensity_target(ctx.relevant_clients, va_t, items)
    return M.auroc(ML.embedding_probe_multilabel(ttr, tte, emb), ["item"])


@register("factor_profile_category")
def q_factor_profile_category(spark, sf):
    """The same on categories: interactions of categories, scores of category targets."""
    return factor_profile(Ctx(spark, sf), category=True).withColumn("score", r6("score"))


def task_targets(ctx: Ctx, events):
    """Targets of all three tasks on a window: ``task, client_id, item, label``. Churn counts
    the active clients only."""
    churn = M.churn_target(ctx.active_clients, events).select(
        F.lit("churn").alias("task"), "client_id", F.lit(M.NO_ITEM).cast("long").alias("item"), F.col("target").alias("label"))
    for task, items, column in (("propensity_category", ctx.propensity_category, "category"), ("propensity_sku", ctx.propensity_sku, "sku")):
        t = M.propensity_target(ctx.relevant_clients, events, items, column)
        churn = churn.unionByName(t.select(F.lit(task).alias("task"), "client_id", "item", F.col("target").alias("label")))
    return churn


def evaluate_profile(ctx: Ctx, embeddings, epochs: int = C.MAX_EPOCH, iterations: int = 4):
    """validate → targets of three tasks → one probe, carried from epoch to epoch → metrics
    of every task after each epoch → best epoch by task. Embeddings that fail a check of the
    validator, that of the client ids among them, are rejected with its messages."""
    from clientele.operators.probe import LabelProbe
    report = V.validation_report(embeddings, ctx.relevant_clients).orderBy("position").collect()
    if report:
        raise ValueError("; ".join(r["message"] for r in report))
    train, valid = (task_targets(ctx, t) for t in ctx.targets())
    popularity = task_popularity(ctx)
    probe, rows = LabelProbe(train, embeddings), None
    for epoch in range(epochs):
        probe.run(iterations)
        scores = M.task_scores({"all": probe.score(valid, embeddings)})
        m = M.task_metrics(scores, popularity).select("task", F.lit(epoch).alias("epoch"), "weighted_metric")
        rows = m if rows is None else rows.unionByName(m)
    return W.best_epoch(rows, n_epochs=epochs)


@register("evaluate_profile")
def q_evaluate_profile(spark, sf):
    ctx = Ctx(spark, sf)
    return evaluate_profile(ctx, ctx._vector_of(ctx.relevant_clients, "client_id", 0, "embedding"))


@register("time_split", S("""
SELECT 'input/' || t AS output, n AS "rows" FROM (
  SELECT 'product_buy' AS t, count(*) AS n FROM product_buy, split s WHERE "timestamp" < s.train_start
  UNION ALL SELECT 'add_to_cart', count(*) FROM add_to_cart, split s WHERE "timestamp" < s.train_start
  UNION ALL SELECT 'remove_from_cart', count(*) FROM remove_from_cart, split s WHERE "timestamp" < s.train_start
  UNION ALL SELECT 'page_visit', count(*) FROM page_visit, split s WHERE "timestamp" < s.train_start
  UNION ALL SELECT 'search_query', count(*) FROM search_query, split s WHERE "timestamp" < s.train_start)
UNION ALL SELECT 'target/train_target', count(*) FROM product_buy, split s
  WHERE "timestamp" >= s.train_start AND "timestamp" < s.val_start
UNION ALL SELECT 'target/validation_target', count(*) FROM product_buy, split s
  WHERE "timestamp" >= s.val_start AND "timestamp" <= s.end_ts"""))
def q_time_split(spark, sf):
    """dates → input chunks → target chunks, written and read back (row counts)."""
    return R.sink_split(Ctx(spark, sf))


ORACLES["sink_split"] = ORACLES["time_split"]
