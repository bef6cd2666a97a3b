"""Queries for entropies, gaps, sessions, the as-of match and the event pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele import config as C
from clientele.operators import counts as K
from clientele.operators import entropy as E
from clientele.operators import joins as J
from clientele.operators import project as P
from clientele.operators import sessions as SS
from clientele.operators import windows as W
from clientele.plans import oracle as O
from clientele.plans import pipelines as PL
from clientele.plans.context import Ctx
from clientele.plans.q_basic import (EV_KEY, PC_SQL, PE_SQL, RATE_COLS, RATES, SEARCH_SQL, TOP_SQL,
                                     ratio_sql, search_ids)
from clientele.plans.registry import r6, register

S = O.sql
T_S = O.SESSION_S
TOL = O.TOLERANCE_S


def entropy_sql(src: str, key: str, name: str, user: bool) -> str:
    """CTE ``ent_<name>(g, name)`` mirroring :func:`entropy_from_counts`."""
    g = "client_id" if user else key
    return f"""
, pairs_{name} AS (SELECT {key}, client_id, count(*) AS n FROM {src} GROUP BY {key}, client_id)
, tot_{name} AS (SELECT {g} AS _g, sum(n) AS total FROM pairs_{name} GROUP BY {g})
, ent_{name} AS (
    SELECT {g}, sum(-p * log2(p + 1e-9)) AS {name} FROM (
      SELECT pr.{g}, CASE WHEN t.total > 0 THEN least(pr.n / (t.total + 1e-9), 0.999999) ELSE 0.0 END AS p
      FROM pairs_{name} pr JOIN tot_{name} t ON pr.{g} IS NOT DISTINCT FROM t._g) GROUP BY {g})
"""


def _pe(ctx: Ctx):
    return J.join_category(ctx.products, ctx.product_properties)


@register("key_entropy", S(PE_SQL + entropy_sql("pe", "sku", "sku_entropy", False) + """
SELECT sku, round(sku_entropy, 6) AS sku_entropy FROM ent_sku_entropy"""))
def q_key_entropy(spark, sf):
    out = E.key_entropy(_pe(Ctx(spark, sf)), "sku", "sku_entropy")
    return out.select("sku", r6("sku_entropy").alias("sku_entropy"))


@register("client_entropy", S(PE_SQL + entropy_sql("pe", "category", "user_cat_entropy", True) + """
SELECT client_id, round(user_cat_entropy, 6) AS user_cat_entropy FROM ent_user_cat_entropy"""))
def q_client_entropy(spark, sf):
    out = E.client_entropy(_pe(Ctx(spark, sf)), "category", "user_cat_entropy")
    return out.select("client_id", r6("user_cat_entropy").alias("user_cat_entropy"))


# product events with cluster id and cluster counts, nulls filled (the input of entropies)
PCL_SQL = PC_SQL + """
, pcl0 AS (SELECT pc.*, COALESCE(nc.cluster_id, 0) AS cluster_id FROM pc LEFT JOIN name_clusters nc USING (sku))
, clc AS (SELECT cluster_id, count(*) FILTER (WHERE event_type='add_to_cart') AS cluster_add_count,
                 count(*) FILTER (WHERE event_type='product_buy') AS cluster_buy_count,
                 count(*) FILTER (WHERE event_type='remove_from_cart') AS cluster_remove_count
          FROM pcl0 GROUP BY cluster_id)
, clu AS (SELECT client_id, cluster_id,
                 count(*) FILTER (WHERE event_type='add_to_cart') AS cluster_add_user_count,
                 count(*) FILTER (WHERE event_type='product_buy') AS cluster_buy_user_count,
                 count(*) FILTER (WHERE event_type='remove_from_cart') AS cluster_remove_user_count
          FROM pcl0 GROUP BY client_id, cluster_id)
, pcl AS (SELECT pcl0.*, clc.cluster_add_count, clc.cluster_buy_count, clc.cluster_remove_count,
                 clu.cluster_add_user_count, clu.cluster_buy_user_count, clu.cluster_remove_user_count
          FROM pcl0 JOIN clc USING (cluster_id) JOIN clu USING (client_id, cluster_id))
"""
ENT_SPECS = PL.PRODUCT_ENTROPY_SPECS
ENT_COLS = [n for _, n, _ in ENT_SPECS]
PENT_SQL = PCL_SQL + "".join(entropy_sql("pcl", k, n, u) for k, n, u in ENT_SPECS) + f"""
, pent AS (SELECT pcl.*, {', '.join(f'e_{n}.{n}' for n in ENT_COLS)} FROM pcl
  {' '.join(f"LEFT JOIN ent_{n} e_{n} ON pcl.{'client_id' if u else k} = e_{n}.{'client_id' if u else k}" for k, n, u in ENT_SPECS)})
"""


def product_with_clusters(ctx: Ctx, entropies: bool = False):
    """Product events with category, cluster, the 21 counts (and the 6 entropies), nulls
    filled — one aggregation of the events and one join back."""
    from clientele.operators import product_stats as PS
    ev = J.attach_cluster(J.join_category(ctx.products, ctx.product_properties), ctx.name_clusters, "sku")
    ev = PS.attach_statistics(ev, with_clusters=True, entropy_specs=ENT_SPECS if entropies else None)
    return P.fill_numeric_nulls(ev)


@register("attach_entropies", S(PENT_SQL + f"""
SELECT client_id, "timestamp", sku, event_type, {', '.join(f'round({n}, 6) AS {n}' for n in ENT_COLS)}
FROM pent"""))
def q_attach_entropies(spark, sf):
    out = product_with_clusters(Ctx(spark, sf), entropies=True)
    return out.select(*EV_KEY, *[r6(n).alias(n) for n in ENT_COLS])


@register("attach_cluster_counts", S(PCL_SQL + "SELECT * FROM pcl"))
def q_attach_cluster_counts(spark, sf):
    return product_with_clusters(Ctx(spark, sf))


@register("total_over_key", S("""
, pr AS (SELECT sku, client_id, count(*) AS n FROM products GROUP BY sku, client_id)
SELECT pr.*, CAST(t.total AS BIGINT) AS total FROM pr JOIN (SELECT sku, sum(n) AS total FROM pr GROUP BY sku) t USING (sku)"""))
def q_total_over_key(spark, sf):
    pairs = Ctx(spark, sf).products.groupBy("sku", "client_id").agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    return W.total_over_key(pairs, "sku", "n", "total").withColumn("total", F.col("total").cast("long"))


# ------------------------------------------------------------------------------------------------
# gaps and sessions
# ------------------------------------------------------------------------------------------------

GAP_SQL = """
, gaps AS (SELECT client_id, "timestamp", url,
     lag("timestamp") OVER (PARTITION BY client_id ORDER BY "timestamp") AS prev_ts,
     CAST(COALESCE((epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY client_id ORDER BY "timestamp"))) // 1000000, 0) AS BIGINT) AS gap_s,
     row_number() OVER (PARTITION BY client_id ORDER BY "timestamp") AS rn
   FROM {src})
"""


@register("prev_event_gap", S(GAP_SQL.format(src="page_visit") + """
SELECT client_id, "timestamp", url, prev_ts, gap_s FROM gaps"""))
def q_prev_event_gap(spark, sf):
    return SS.prev_event_gap(Ctx(spark, sf).page_visit)


def session_sql(src: str, key: str, threshold: int) -> str:
    """Recursive-CTE oracle of the greedy length-capped sessions; ``sess`` rows carry
    ``client_id, timestamp, <key>, session``."""
    return GAP_SQL.replace("url", key).format(src=src) + f"""
, rec(client_id, rn, total, session) AS (
    SELECT client_id, rn, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM gaps WHERE rn = 1
    UNION ALL
    SELECT g.client_id, g.rn,
           CASE WHEN r.total + g.gap_s > {threshold} THEN 0 ELSE r.total + g.gap_s END,
           CASE WHEN r.total + g.gap_s > {threshold} THEN r.session + 1 ELSE r.session END
    FROM rec r JOIN gaps g ON g.client_id = r.client_id AND g.rn = r.rn + 1)
, sess0 AS (SELECT g.client_id, g."timestamp", g.{key}, g.rn, r.session AS s0 FROM gaps g JOIN rec r USING (client_id, rn))
, sess AS (SELECT client_id, "timestamp", {key}, min(rn) OVER (PARTITION BY client_id, s0) AS session FROM sess0)
, coll AS (SELECT client_id, session, arg_min({key}, "timestamp") AS {key},
                  min("timestamp") AS session_start, max("timestamp") AS session_end,
                  CAST((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000000 AS BIGINT) AS time_diff
           FROM sess GROUP BY client_id, session)
"""


RV_SQL = """
, rv AS (SELECT * FROM page_visit WHERE client_id IN (SELECT client_id FROM relevant_clients))
"""


def relevant_visits(ctx: Ctx):
    return P.filter_relevant(ctx.page_visit, ctx.relevant_clients)


@register("sessionize", S(RV_SQL + session_sql("rv", "url", T_S) + "SELECT * FROM sess", recursive=True))
def q_sessionize(spark, sf):
    return SS.sessionize(relevant_visits(Ctx(spark, sf)), T_S)


@register("session_collapse", S(RV_SQL + session_sql("rv", "url", T_S) + "SELECT * FROM coll",
                                recursive=True))
def q_session_collapse(spark, sf):
    return SS.collapse(relevant_visits(Ctx(spark, sf)), "url", T_S)


ASOF_SQL = RV_SQL + session_sql("rv", "url", T_S) + TOP_SQL + f"""
, se AS (SELECT client_id, url, session_start, time_diff,
                session_start + to_seconds(time_diff + {TOL}) AS session_end_ext FROM coll)
, pe2 AS (SELECT p.client_id, p."timestamp", p.sku, pp.category,
                 CAST(CASE WHEN p.sku IN (SELECT sku FROM top_skus) THEN 1 ELSE 0 END AS TINYINT) AS is_top_sku,
                 CAST(CASE WHEN pp.category IN (SELECT category FROM top_cats) THEN 1 ELSE 0 END AS TINYINT) AS is_top_category
          FROM products p LEFT JOIN product_properties pp USING (sku))
, m AS (SELECT pe2.*, se.session_start, se.session_end_ext, se.url
        FROM pe2 ASOF JOIN se ON pe2.client_id = se.client_id AND pe2."timestamp" >= se.session_start
        WHERE pe2."timestamp" <= se.session_end_ext)
, nb AS (SELECT client_id, url, session_start, CAST(count(*) AS INTEGER) AS num_events_nearby,
                max(is_top_sku) AS has_top_sku, max(is_top_category) AS has_top_category
         FROM m GROUP BY client_id, url, session_start)
, near AS (SELECT c.client_id, c.session, c.url, c.session_start, c.session_end, c.time_diff,
                  se.session_end_ext,
                  COALESCE(nb.num_events_nearby, 0) AS num_events_nearby,
                  CAST(COALESCE(nb.has_top_sku, 0) AS TINYINT) AS has_top_sku,
                  CAST(COALESCE(nb.has_top_category, 0) AS TINYINT) AS has_top_category
           FROM coll c JOIN se USING (client_id, session_start, url)
           LEFT JOIN nb USING (client_id, url, session_start))
"""


def _top_lists(ctx: Ctx):
    return W.top_skus(ctx.product_buy), W.top_categories(ctx.product_buy, ctx.product_properties)


def _flagged_products(ctx: Ctx):
    ts, tc = _top_lists(ctx)
    return _pe(ctx).select("client_id", "timestamp", "sku", "category"), ts, tc


@register("asof_session", S(ASOF_SQL + "SELECT * FROM m", recursive=True))
def q_asof_session(spark, sf):
    ctx = Ctx(spark, sf)
    sess = SS.collapse(relevant_visits(ctx), "url", T_S)
    p, ts, tc = _flagged_products(ctx)
    p = P.flag_top_items(p, ts, tc).withColumnRenamed("top_sku", "is_top_sku") \
        .withColumnRenamed("top_category", "is_top_category")
    return SS.asof_session(p, sess, tolerance_s=TOL, carry=["url"])


@register("nearby_products", S(ASOF_SQL + "SELECT * FROM near", recursive=True))
def q_nearby_products(spark, sf):
    ctx = Ctx(spark, sf)
    from clientele.session import materialize
    sess = materialize(SS.collapse(relevant_visits(ctx), "url", T_S))
    p, ts, tc = _flagged_products(ctx)
    return SS.nearby_products(sess, "url", p, ts, tc, tolerance_s=TOL)


@register("attach_query_scores", S(SEARCH_SQL + """
SELECT s.client_id, s."timestamp", s.query_id, s.cluster_id, a.query_score, b.query_user_score,
       c.queries_made_by_user, d.cluster_made_by_user, e.cluster_score
FROM sqc s
LEFT JOIN (SELECT query_id, count(*) AS query_score FROM sqc GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT client_id, query_id, count(*) AS query_user_score FROM sqc GROUP BY 1, 2) b USING (client_id, query_id)
LEFT JOIN (SELECT client_id, count(*) AS queries_made_by_user FROM sqc GROUP BY 1) c USING (client_id)
LEFT JOIN (SELECT client_id, cluster_id, count(*) AS cluster_made_by_user FROM sqc GROUP BY 1, 2) d USING (client_id, cluster_id)
LEFT JOIN (SELECT cluster_id, count(*) AS cluster_score FROM sqc GROUP BY 1) e USING (cluster_id)"""))
def q_attach_query_scores(spark, sf):
    ctx = Ctx(spark, sf)
    sq, qcl, _ = search_ids(ctx)
    sqc = sq.join(qcl, "query_id", "left")
    return J.attach_query_scores(sqc, sqc)


# ------------------------------------------------------------------------------------------------
# pipelines
# ------------------------------------------------------------------------------------------------

PROD_FEATURE_COLS = (["client_id", "timestamp", "sku", "event_type", "category", "cluster_id",
                      "top_sku", "top_category"])


@register("product_events_pipeline", S(PENT_SQL + TOP_SQL + f"""
SELECT client_id, "timestamp", sku, event_type, category, cluster_id,
  CAST(CASE WHEN sku IN (SELECT sku FROM top_skus) THEN 1 ELSE 0 END AS TINYINT) AS top_sku,
  CAST(CASE WHEN category IN (SELECT category FROM top_cats) THEN 1 ELSE 0 END AS TINYINT) AS top_category,
  {', '.join(f'round({ratio_sql(n, d)}, 6) AS {name}' for name, n, d in RATES)},
  {', '.join(f'round({n}, 6) AS {n}' for n in ENT_COLS)},
  round(((SELECT price FROM product_properties pp WHERE pp.sku = pent.sku) + 1) / 100.0, 6) AS price
FROM pent"""))
def q_product_events_pipeline(spark, sf):
    ctx = Ctx(spark, sf)
    out = PL.product_events_pipeline(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart,
                                     ctx.product_properties, ctx.name_clusters)
    return out.select(*PROD_FEATURE_COLS, *[r6(c).alias(c) for c in RATE_COLS],
                      *[r6(c).alias(c) for c in ENT_COLS], r6("price").alias("price"))


def product_features(ctx: Ctx):
    return PL.product_events_pipeline(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart,
                                      ctx.product_properties, ctx.name_clusters)


def light_products(ctx: Ctx):
    """What the session pipelines read of the product events: client, time, sku, category
    (category null → 0, as after the product pipeline's null fill)."""
    return (J.join_category(ctx.products, ctx.product_properties)
            .select("client_id", "timestamp", "sku", F.coalesce("category", F.lit(0)).alias("category")))


def visit_features(ctx: Ctx, products=None):
    products = products if products is not None else light_products(ctx)
    ts, tc = _top_lists(ctx)
    return PL.visit_sessions_pipeline(ctx.page_visit, ctx.relevant_clients,
                                      products.select("client_id", "timestamp", "sku", "category"),
                                      ts, tc, T_S, TOL)


def search_features(ctx: Ctx, products=None):
    products = products if products is not None else light_products(ctx)
    ts, tc = _top_lists(ctx)
    sq, qcl, q = search_ids(ctx)
    return PL.search_sessions_pipeline(ctx.search_query, products.select(
        "client_id", "timestamp", "sku", "category"), qcl, ts, tc, T_S, TOL, queries=q)


VISIT_OUT = ["client_id", "url", "timestamp", "time_diff", "num_events_nearby", "has_top_sku",
             "has_top_category", "count", "client_total_visits", "client_url_visits"]


@register("visit_sessions_pipeline", S(ASOF_SQL + entropy_sql("near", "url", "url_entropy", False)
                                       + entropy_sql("near", "url", "client_entropy", True) + """
SELECT n.client_id, n.url, n.session_start AS "timestamp", n.time_diff, n.num_events_nearby,
       n.has_top_sku, n.has_top_category, u."count", ct.client_total_visits, cu.client_url_visits,
       round(e1.url_entropy, 6) AS url_entropy, round(e2.client_entropy, 6) AS client_entropy
FROM near n
LEFT JOIN (SELECT url, count(*) AS "count" FROM page_visit GROUP BY url) u USING (url)
LEFT JOIN (SELECT client_id, count(*) AS client_total_visits FROM page_visit GROUP BY client_id) ct USING (client_id)
LEFT JOIN (SELECT client_id, url, count(*) AS client_url_visits FROM page_visit GROUP BY 1, 2) cu USING (client_id, url)
LEFT JOIN ent_url_entropy e1 USING (url) LEFT JOIN ent_client_entropy e2 USING (client_id)""",
    recursive=True))
def q_visit_sessions_pipeline(spark, sf):
    out = visit_features(Ctx(spark, sf))
    return out.select(*VISIT_OUT, r6("url_entropy").alias("url_entropy"),
                      r6("client_entropy").alias("client_entropy"))


def nearby_sql(key: str) -> str:
    """Nearby-product counts for the sessions in ``coll`` keyed by ``key`` (CTE ``near``)."""
    return TOP_SQL + f"""
, se AS (SELECT client_id, {key}, session_start, time_diff,
                session_start + to_seconds(time_diff + {TOL}) AS session_end_ext FROM coll)
, pe2 AS (SELECT p.client_id, p."timestamp", p.sku, COALESCE(pp.category, 0) AS category,
                 CAST(CASE WHEN p.sku IN (SELECT sku FROM top_skus) THEN 1 ELSE 0 END AS TINYINT) AS is_top_sku,
                 CAST(CASE WHEN COALESCE(pp.category, 0) IN (SELECT category FROM top_cats) THEN 1 ELSE 0 END AS TINYINT) AS is_top_category
          FROM products p LEFT JOIN product_properties pp USING (sku))
, m AS (SELECT pe2.*, se.session_start, se.session_end_ext, se.{key}
        FROM pe2 ASOF JOIN se ON pe2.client_id = se.client_id AND pe2."timestamp" >= se.session_start
        WHERE pe2."timestamp" <= se.session_end_ext)
, nb AS (SELECT client_id, {key}, session_start, CAST(count(*) AS INTEGER) AS num_events_nearby,
                max(is_top_sku) AS has_top_sku, max(is_top_category) AS has_top_category
         FROM m GROUP BY client_id, {key}, session_start)
, near AS (SELECT c.client_id, c.session, c.{key}, c.session_start, c.session_end, c.time_diff,
                  COALESCE(nb.num_events_nearby, 0) AS num_events_nearby,
                  CAST(COALESCE(nb.has_top_sku, 0) AS TINYINT) AS has_top_sku,
                  CAST(COALESCE(nb.has_top_category, 0) AS TINYINT) AS has_top_category
           FROM coll c LEFT JOIN nb USING (client_id, {key}, session_start))
"""


SEARCH_PIPE_SQL = (SEARCH_SQL + session_sql("sq", "query_id", T_S) + nearby_sql("query_id") + """
, ns AS (SELECT near.*, qcl.cluster_id FROM near LEFT JOIN qcl USING (query_id))
""" + "".join(entropy_sql("ns", k, n, u) for k, n, u in PL.SEARCH_ENTROPY_SPECS))


@register("search_sessions_pipeline", S(SEARCH_PIPE_SQL + """
SELECT ns.client_id, ns.query_id, ns.cluster_id, ns.session_start AS "timestamp", ns.time_diff,
       ns.num_events_nearby, ns.has_top_sku, ns.has_top_category, a.query_score, b.query_user_score,
       c.queries_made_by_user, d.cluster_made_by_user, e.cluster_score,
       round(e1.query_entropy, 6) AS query_entropy, round(e2.cluster_entropy, 6) AS cluster_entropy,
       round(e3.user_query_entropy, 6) AS user_query_entropy,
       round(e4.user_cluster_entropy, 6) AS user_cluster_entropy
FROM ns
LEFT JOIN (SELECT query_id, count(*) AS query_score FROM sqc GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT client_id, query_id, count(*) AS query_user_score FROM sqc GROUP BY 1, 2) b USING (client_id, query_id)
LEFT JOIN (SELECT client_id, count(*) AS queries_made_by_user FROM sqc GROUP BY 1) c USING (client_id)
LEFT JOIN (SELECT client_id, cluster_id, count(*) AS cluster_made_by_user FROM sqc GROUP BY 1, 2) d USING (client_id, cluster_id)
LEFT JOIN (SELECT cluster_id, count(*) AS cluster_score FROM sqc GROUP BY 1) e USING (cluster_id)
LEFT JOIN ent_query_entropy e1 USING (query_id) LEFT JOIN ent_cluster_entropy e2 USING (cluster_id)
LEFT JOIN ent_user_query_entropy e3 USING (client_id) LEFT JOIN ent_user_cluster_entropy e4 USING (client_id)""",
    recursive=True))
def q_search_sessions_pipeline(spark, sf):
    out = search_features(Ctx(spark, sf))
    return out.select("client_id", "query_id", "cluster_id", "timestamp", "time_diff",
                      "num_events_nearby", "has_top_sku", "has_top_category", "query_score",
                      "query_user_score", "queries_made_by_user", "cluster_made_by_user",
                      "cluster_score", *[r6(c).alias(c) for _, c, _ in PL.SEARCH_ENTROPY_SPECS])
