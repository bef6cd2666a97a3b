"""Queries for sources, projections, simple joins, counts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import ieee_ratio
from clientele.operators import counts as K
from clientele.operators import joins as J
from clientele.operators import project as P
from clientele.operators import windows as W
from clientele.plans import oracle as O
from clientele.plans.context import Ctx
from clientele.plans.registry import ORACLES, names, r6, register, type_counts_sql
from clientele.sources import readers as R

S = O.sql

# ------------------------------------------------------------------------------------------------
# shared SQL: product events with category and the 15 counts (null → 0), then rates
# ------------------------------------------------------------------------------------------------
PE_SQL = """
, pe AS (SELECT p.client_id, p."timestamp", p.sku, p.event_type, pp.category
         FROM products p LEFT JOIN (SELECT sku, category FROM product_properties) pp USING (sku))
"""
COUNT_TABLES = [
    ("sc", ["sku"], "count_{}"),
    ("scc", ["sku", "client_id"], "count_user_{}"),
    ("ct", ["client_id"], "tot_user_{}"),
    ("cc", ["category"], "count_cat_{}"),
    ("ccc", ["category", "client_id"], "count_cat_user_{}"),
]


def _count_ctes(src: str) -> str:
    return "".join(f", {n} AS ({type_counts_sql(src, k, p)})\n" for n, k, p in COUNT_TABLES)


def _count_join(src: str) -> str:
    sel, joins = [], []
    for n, keys, pat in COUNT_TABLES:
        on = " AND ".join(f"{src}.{k} = {n}.{k}" for k in keys)
        joins.append(f"LEFT JOIN {n} ON {on}")
        sel += [f"COALESCE({n}.{c}, 0) AS {c}" for c in names(pat)]
    return sel, " ".join(joins)


_sel, _joins = _count_join("pe")
PC_SQL = PE_SQL + _count_ctes("pe") + f"""
, pc AS (SELECT pe.client_id, pe."timestamp", pe.sku, pe.event_type,
                COALESCE(pe.category, 0) AS category, {', '.join(_sel)}
         FROM pe {_joins})
"""
COUNT_COLS = [c for _, _, p in COUNT_TABLES for c in names(p)]


def ratio_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN (CASE WHEN {n} = 0 THEN 0.0 ELSE 1.0 END) ELSE {n} / {d} END"


RATES = [("global_cat_cr", "count_cat_buy", "count_cat_add"),
         ("local_cat_cr", "count_cat_user_buy", "count_cat_user_add"),
         ("global_cr", "count_buy", "count_add"),
         ("local_cr", "tot_user_buy", "tot_user_add"),
         ("cr", "count_user_buy", "count_user_add")]
PR_SQL = PC_SQL + f"""
, pr AS (SELECT *, {', '.join(f'{ratio_sql(n, d)} AS {name}' for name, n, d in RATES)} FROM pc)
"""
RATE_COLS = [r[0] for r in RATES]


def product_counts(ctx: Ctx):
    ev = J.join_category(ctx.products, ctx.product_properties)
    return J.attach_product_counts(ev)


def product_rates(ctx: Ctx):
    return K.conversion_rates(product_counts(ctx))


EV_KEY = ["client_id", "timestamp", "sku", "event_type"]

# ------------------------------------------------------------------------------------------------
# 2.1 sources
# ------------------------------------------------------------------------------------------------


@register("src_events", S('SELECT client_id, "timestamp", sku FROM add_to_cart'))
def q_src_events(spark, sf):
    return R.src_events(Ctx(spark, sf), C.ADD_TO_CART)


@register("src_properties", S("SELECT sku, category FROM product_properties"))
def q_src_properties(spark, sf):
    return R.src_properties(Ctx(spark, sf), ["sku", "category"])


@register("src_id_lists", S("""
SELECT 'relevant' AS list_name, client_id AS id, CAST(NULL AS BIGINT) AS value FROM relevant_clients
UNION ALL SELECT 'active', client_id, NULL FROM active_clients
UNION ALL SELECT 'propensity_sku', item, pos FROM propensity_sku
UNION ALL SELECT 'propensity_category', item, pos FROM propensity_category
UNION ALL SELECT 'popularity_sku', sku, count(*) FROM input_buys GROUP BY sku
"""))
def q_src_id_lists(spark, sf):
    return R.src_id_lists(Ctx(spark, sf))


@register("src_targets", S("""
, t AS (SELECT b.client_id, b."timestamp", b.sku, p.category, p.price, p.name,
               CASE WHEN b."timestamp" < s.val_start THEN 'train_target' ELSE 'validation_target' END AS target
        FROM product_buy b CROSS JOIN split s JOIN product_properties p USING (sku)
        WHERE b."timestamp" >= s.train_start AND b."timestamp" <= s.end_ts)
SELECT * FROM t
"""))
def q_src_targets(spark, sf):
    return R.src_targets(Ctx(spark, sf))


@register("load_with_properties", S("""
SELECT a.client_id, a."timestamp", a.sku, p.category, p.price, p.name
FROM add_to_cart a LEFT JOIN product_properties p USING (sku)
"""))
def q_load_with_properties(spark, sf):
    return R.load_with_properties(Ctx(spark, sf), C.ADD_TO_CART)


@register("materialize_once")
def q_materialize_once(spark, sf):
    ctx = Ctx(spark, sf)
    return R.materialize_once(spark, "top_skus_" + R.path_key(sf),
                              lambda: W.top_skus(ctx.product_buy))


@register("sink_features")
def q_sink_features(spark, sf):
    back = R.sink_features(product_rates(Ctx(spark, sf)), "product_events")
    return back.select(*EV_KEY, "category", *[r6(c).alias(c) for c in RATE_COLS])


@register("sink_split")
def q_sink_split(spark, sf):
    ctx = Ctx(spark, sf)
    return R.sink_split(ctx)


# ------------------------------------------------------------------------------------------------
# 2.2 projections, filters, null handling
# ------------------------------------------------------------------------------------------------


@register("tag_event_type", S("""SELECT client_id, "timestamp", url, 'page_visit' AS event_type FROM page_visit"""))
def q_tag_event_type(spark, sf):
    return P.tag_event_type(Ctx(spark, sf).page_visit, C.PAGE_VISIT)


@register("filter_relevant", S("""
SELECT v.* FROM page_visit v WHERE v.client_id IN (SELECT client_id FROM relevant_clients)"""))
def q_filter_relevant(spark, sf):
    ctx = Ctx(spark, sf)
    return P.filter_relevant(ctx.page_visit, ctx.relevant_clients)


@register("clients_without_events", S("""
, fv AS (SELECT * FROM page_visit WHERE client_id IN (SELECT client_id FROM relevant_clients)
                                    AND "timestamp" >= TIMESTAMP '2024-01-15')
, fs AS (SELECT * FROM search_query WHERE "timestamp" >= TIMESTAMP '2024-01-22')
, fp AS (SELECT * FROM products WHERE "timestamp" >= TIMESTAMP '2024-01-22')
, seen AS (SELECT client_id FROM fv UNION SELECT client_id FROM fs UNION SELECT client_id FROM fp)
, excl AS (SELECT client_id FROM relevant_clients WHERE client_id NOT IN (SELECT client_id FROM seen))
SELECT * FROM fv UNION ALL SELECT v.* FROM page_visit v WHERE v.client_id IN (SELECT client_id FROM excl)
"""))
def q_clients_without_events(spark, sf):
    # windowed inputs (later-period activity) so that some relevant clients are absent
    ctx = Ctx(spark, sf)
    fv = P.filter_relevant(ctx.page_visit, ctx.relevant_clients).where(
        F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    fs = ctx.search_query.where(F.col("timestamp") >= F.lit("2024-01-22").cast("timestamp_ntz"))
    fp = ctx.products.where(F.col("timestamp") >= F.lit("2024-01-22").cast("timestamp_ntz"))
    return P.clients_without_events(ctx.relevant_clients, fv, fs, fp, ctx.page_visit)


TOP_SQL = """
, top_skus AS (SELECT sku FROM product_buy GROUP BY sku ORDER BY count(*) DESC, sku LIMIT 150)
, top_cats AS (SELECT pp.category FROM product_buy b LEFT JOIN product_properties pp USING (sku)
               GROUP BY pp.category ORDER BY count(*) DESC, pp.category NULLS LAST LIMIT 150)
"""


@register("flag_top_items", S(PE_SQL + TOP_SQL + """
SELECT pe.*, CAST(CASE WHEN pe.sku IN (SELECT sku FROM top_skus) THEN 1 ELSE 0 END AS TINYINT) AS top_sku,
       CAST(CASE WHEN pe.category IN (SELECT category FROM top_cats) THEN 1 ELSE 0 END AS TINYINT) AS top_category
FROM pe"""))
def q_flag_top_items(spark, sf):
    ctx = Ctx(spark, sf)
    ev = J.join_category(ctx.products, ctx.product_properties)
    return P.flag_top_items(ev, W.top_skus(ctx.product_buy),
                            W.top_categories(ctx.product_buy, ctx.product_properties))


@register("fill_numeric_nulls", S("""
SELECT COALESCE(client_id, 0) AS client_id, "timestamp", COALESCE(sku, 0) AS sku,
       COALESCE(url, 0) AS url, event_type
FROM (SELECT client_id, "timestamp", sku, NULL::BIGINT AS url, event_type FROM products
      UNION ALL SELECT client_id, "timestamp", NULL, url, 'page_visit' FROM page_visit)"""))
def q_fill_numeric_nulls(spark, sf):
    ctx = Ctx(spark, sf)
    u = W.union_all_events(ctx.products, P.tag_event_type(ctx.page_visit, C.PAGE_VISIT))
    return P.fill_numeric_nulls(u)


IEEE_SQL = """
, raw AS (SELECT sku, client_id,
    CASE WHEN count_user_add = 0 THEN (CASE WHEN count_user_buy = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END)
         ELSE count_user_buy / count_user_add END AS cr_raw,
    CASE WHEN count_user_add = 0 THEN (CASE WHEN count_user_remove = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END)
         ELSE count_user_remove / count_user_add END AS rr_raw
  FROM (""" + type_counts_sql("products", ["sku", "client_id"], "count_user_{}") + "))\n"


def _raw_ratios(ctx: Ctx):
    c = K.sku_client_counts(ctx.products)
    return c.select("sku", "client_id",
                    ieee_ratio("count_user_buy", "count_user_add").alias("cr_raw"),
                    ieee_ratio("count_user_remove", "count_user_add").alias("rr_raw"))


@register("fill_nan", S(IEEE_SQL + """
SELECT sku, client_id, round(CASE WHEN isnan(cr_raw) THEN 0.0 ELSE cr_raw END, 6) AS cr_raw,
       round(CASE WHEN isnan(rr_raw) THEN 0.0 ELSE rr_raw END, 6) AS rr_raw FROM raw"""))
def q_fill_nan(spark, sf):
    out = P.fill_nan(_raw_ratios(Ctx(spark, sf)))
    return out.select("sku", "client_id", r6("cr_raw").alias("cr_raw"), r6("rr_raw").alias("rr_raw"))


@register("nan_report", S(IEEE_SQL + """
SELECT 'cr_raw' AS column_name, count(*) FILTER (WHERE isnan(cr_raw)) AS nan_count FROM raw
UNION ALL SELECT 'rr_raw', count(*) FILTER (WHERE isnan(rr_raw)) FROM raw"""))
def q_nan_report(spark, sf):
    return P.nan_report(_raw_ratios(Ctx(spark, sf)))


@register("clip_unit", S(IEEE_SQL + """
SELECT sku, client_id,
  round(CASE WHEN cr_raw IS NULL OR isnan(cr_raw) THEN 0 WHEN cr_raw > 1 THEN 1 ELSE cr_raw END, 6) AS cr_raw,
  round(CASE WHEN rr_raw IS NULL OR isnan(rr_raw) THEN 0 WHEN rr_raw > 1 THEN 1 ELSE rr_raw END, 6) AS rr_raw
FROM raw"""))
def q_clip_unit(spark, sf):
    # NaN → null first (as the legacy clean-up sees nulls), then null → 0 and > 1 → 1
    raw = _raw_ratios(Ctx(spark, sf))
    raw = raw.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
                           for c in ["cr_raw", "rr_raw"]})
    out = P.clip_unit(raw, ["cr_raw", "rr_raw"])
    return out.select("sku", "client_id", r6("cr_raw").alias("cr_raw"), r6("rr_raw").alias("rr_raw"))


@register("price_norm", S("""
SELECT p.client_id, p."timestamp", p.sku, p.event_type, round((pp.price + 1) / 100.0, 6) AS price
FROM products p LEFT JOIN product_properties pp USING (sku)"""))
def q_price_norm(spark, sf):
    ctx = Ctx(spark, sf)
    out = P.price_norm(ctx.products, ctx.product_properties)
    return out.select(*EV_KEY, r6("price").alias("price"))


@register("split_input", S("""
SELECT b.* FROM product_buy b, split s WHERE b."timestamp" < s.train_start"""))
def q_split_input(spark, sf):
    return Ctx(spark, sf).input_buys


@register("split_targets", S("""
SELECT b.client_id, b."timestamp", b.sku, p.category, p.price, p.name,
       CASE WHEN b."timestamp" < s.val_start THEN 'train_target' ELSE 'validation_target' END AS target
FROM product_buy b CROSS JOIN split s JOIN product_properties p USING (sku)
WHERE b."timestamp" >= s.train_start AND b."timestamp" <= s.end_ts"""))
def q_split_targets(spark, sf):
    ctx = Ctx(spark, sf)
    tr, va, end = ctx.split
    t, v = P.split_targets(ctx.product_buy, ctx.product_properties, tr, va, end, check=True)
    return (t.withColumn("target", F.lit("train_target"))
            .unionByName(v.withColumn("target", F.lit("validation_target"))))


@register("split_dates", S("SELECT train_start, val_start, end_ts FROM split"))
def q_split_dates(spark, sf):
    return P.split_dates(Ctx(spark, sf).product_buy, O.DAYS_IN_TARGET)


@register("last_month_only", S(PC_SQL + """
SELECT * FROM pc WHERE "timestamp" >= (SELECT end_ts - INTERVAL 7 DAY FROM split)"""))
def q_last_month_only(spark, sf):
    # features on all data first, then only the last window's rows are kept
    ctx = Ctx(spark, sf)
    cutoff = ctx.split[2] - __import__("datetime").timedelta(days=7)
    return P.last_month_only(product_counts(ctx), cutoff)


# ------------------------------------------------------------------------------------------------
# 2.3 joins (simple)
# ------------------------------------------------------------------------------------------------


@register("join_category", S(PE_SQL + "SELECT * FROM pe"))
def q_join_category(spark, sf):
    ctx = Ctx(spark, sf)
    return J.join_category(ctx.products, ctx.product_properties)


@register("join_properties_checked", S("""
SELECT b.client_id, b."timestamp", b.sku, p.category, p.price, p.name
FROM product_buy b JOIN product_properties p USING (sku)"""))
def q_join_properties_checked(spark, sf):
    ctx = Ctx(spark, sf)
    return J.join_properties_checked(ctx.product_buy, ctx.product_properties)


@register("category_as_item", S("""
SELECT b.client_id, b."timestamp", pp.category AS sku
FROM product_buy b LEFT JOIN product_properties pp USING (sku)"""))
def q_category_as_item(spark, sf):
    ctx = Ctx(spark, sf)
    return J.category_as_item(ctx.product_buy, ctx.product_properties)


@register("attach_product_counts", S(PC_SQL + "SELECT * FROM pc"))
def q_attach_product_counts(spark, sf):
    return product_counts(Ctx(spark, sf))


@register("attach_cluster", S(PE_SQL + """
SELECT pe.*, nc.cluster_id FROM pe LEFT JOIN name_clusters nc USING (sku)"""))
def q_attach_cluster(spark, sf):
    ctx = Ctx(spark, sf)
    ev = J.join_category(ctx.products, ctx.product_properties)
    return J.attach_cluster(ev, ctx.name_clusters, "sku")


@register("attach_visit_counts", S("""
SELECT v.client_id, v."timestamp", v.url, u."count", ct.client_total_visits, cu.client_url_visits
FROM page_visit v
LEFT JOIN (SELECT url, count(*) AS "count" FROM page_visit GROUP BY url) u USING (url)
LEFT JOIN (SELECT client_id, count(*) AS client_total_visits FROM page_visit GROUP BY client_id) ct USING (client_id)
LEFT JOIN (SELECT client_id, url, count(*) AS client_url_visits FROM page_visit GROUP BY client_id, url) cu
  USING (client_id, url)"""))
def q_attach_visit_counts(spark, sf):
    ctx = Ctx(spark, sf)
    return J.attach_visit_counts(ctx.page_visit, ctx.page_visit)


@register("attach_url_score", S("""
SELECT v.*, u.score FROM page_visit v JOIN (SELECT url, count(*) AS score FROM page_visit GROUP BY url) u USING (url)"""))
def q_attach_url_score(spark, sf):
    return J.attach_url_score(Ctx(spark, sf).page_visit)


@register("index_ids", S("""
, pr AS (SELECT client_id, sku FROM products)
SELECT 'client' AS kind, client_id AS id, CAST(dense_rank() OVER (ORDER BY client_id) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT client_id FROM pr)
UNION ALL
SELECT 'item', sku, CAST(dense_rank() OVER (ORDER BY sku) - 1 AS BIGINT) FROM (SELECT DISTINCT sku FROM pr)"""))
def q_index_ids(spark, sf):
    c, i = J.index_ids(Ctx(spark, sf).products)
    return (c.select(F.lit("client").alias("kind"), F.col("client_id").alias("id"),
                     F.col("client_idx").alias("idx"))
            .unionByName(i.select(F.lit("item").alias("kind"), F.col("sku").alias("id"),
                                  F.col("item_idx").alias("idx"))))


# ------------------------------------------------------------------------------------------------
# 2.4 counts
# ------------------------------------------------------------------------------------------------


def _count_query(key: str, fn, keys: list[str], pattern: str, with_category=False,
                 with_cluster=False):
    src = "pe" if with_category else "products"
    pre = PE_SQL if with_category else ""
    if with_cluster:
        pre = PE_SQL + ", pcl AS (SELECT pe.*, nc.cluster_id FROM pe LEFT JOIN name_clusters nc USING (sku))\n"
        src = "pcl"

    @register(key, S(pre + type_counts_sql(src, keys, pattern)))
    def _q(spark, sf):
        ctx = Ctx(spark, sf)
        ev = ctx.products
        if with_category or with_cluster:
            ev = J.join_category(ev, ctx.product_properties)
        if with_cluster:
            ev = J.attach_cluster(ev, ctx.name_clusters, "sku")
        return fn(ev)
    return _q


_count_query("sku_counts", K.sku_counts, ["sku"], "count_{}")
_count_query("sku_client_counts", K.sku_client_counts, ["sku", "client_id"], "count_user_{}")
_count_query("client_totals", K.client_totals, ["client_id"], "tot_user_{}")
_count_query("category_counts", K.category_counts, ["category"], "count_cat_{}", with_category=True)
_count_query("category_client_counts", K.category_client_counts, ["category", "client_id"],
             "count_cat_user_{}", with_category=True)
_count_query("cluster_counts", K.cluster_counts, ["cluster_id"], "cluster_{}_count",
             with_cluster=True)
_count_query("cluster_client_counts", K.cluster_client_counts, ["client_id", "cluster_id"],
             "cluster_{}_user_count", with_cluster=True)


@register("conversion_rates", S(PR_SQL + f"""
SELECT client_id, "timestamp", sku, event_type, category,
       {', '.join(f'round({c}, 6) AS {c}' for c in RATE_COLS)} FROM pr"""))
def q_conversion_rates(spark, sf):
    out = product_rates(Ctx(spark, sf))
    return out.select(*EV_KEY, "category", *[r6(c).alias(c) for c in RATE_COLS])


def _simple_count(key: str, fn, table: str, keys: list[str], name: str, pre: str = "",
                  src_fn=None):
    @register(key, S(pre + f'SELECT {", ".join(keys)}, count(*) AS "{name}" FROM {table} GROUP BY {", ".join(keys)}'))
    def _q(spark, sf):
        ctx = Ctx(spark, sf)
        return fn(src_fn(ctx) if src_fn else ctx.page_visit)
    return _q


_simple_count("url_counts", K.url_counts, "page_visit", ["url"], "count")
_simple_count("client_visit_totals", K.client_visit_totals, "page_visit", ["client_id"],
              "client_total_visits")
_simple_count("client_url_visits", K.client_url_visits, "page_visit", ["client_id", "url"],
              "client_url_visits")

SEARCH_SQL = """
, qids AS (SELECT query, CAST(dense_rank() OVER (ORDER BY query) - 1 AS BIGINT) AS query_id
           FROM (SELECT DISTINCT query FROM search_query WHERE query IS NOT NULL))
, sq AS (SELECT s.client_id, s."timestamp", q.query_id FROM search_query s LEFT JOIN qids q USING (query))
, qcl AS (SELECT q.query_id, c.cluster_id FROM qids q JOIN query_cluster_of_text c USING (query))
, sqc AS (SELECT sq.*, qcl.cluster_id FROM sq LEFT JOIN qcl USING (query_id))
"""


def search_ids(ctx: Ctx):
    """``(searches with query_id, query_id → cluster_id, distinct queries)``."""
    q = W.distinct_queries(ctx.search_query)
    sq = ctx.search_query.join(q, "query", "left").drop("query")
    qcl = q.join(ctx.query_cluster_of_text, "query").select("query_id", "cluster_id")
    return sq, qcl, q


def _searches_with_clusters(ctx: Ctx):
    sq, qcl, _ = search_ids(ctx)
    return sq.join(qcl, "query_id", "left")


_simple_count("query_score", K.query_score, "sqc", ["query_id"], "query_score", SEARCH_SQL,
              _searches_with_clusters)
_simple_count("query_user_score", K.query_user_score, "sqc", ["client_id", "query_id"],
              "query_user_score", SEARCH_SQL, _searches_with_clusters)
_simple_count("queries_by_user", K.queries_by_user, "sqc", ["client_id"],
              "queries_made_by_user", SEARCH_SQL, _searches_with_clusters)
_simple_count("cluster_by_user", K.cluster_by_user, "sqc", ["cluster_id", "client_id"],
              "cluster_made_by_user", SEARCH_SQL, _searches_with_clusters)
_simple_count("cluster_score", K.cluster_score, "sqc", ["cluster_id"], "cluster_score",
              SEARCH_SQL, _searches_with_clusters)


@register("distinct_counts", S(PE_SQL + """
SELECT column_name, n_unique, round(log2(n_unique), 6) AS log2_n_unique FROM (
  SELECT 'sku' AS column_name, count(DISTINCT sku) AS n_unique FROM pe
  UNION ALL SELECT 'client_id', count(DISTINCT client_id) FROM pe
  UNION ALL SELECT 'category', count(DISTINCT category) FROM pe)"""))
def q_distinct_counts(spark, sf):
    ctx = Ctx(spark, sf)
    ev = J.join_category(ctx.products, ctx.product_properties)
    out = K.distinct_counts(ev, ["sku", "client_id", "category"])
    return out.withColumn("log2_n_unique", r6("log2_n_unique"))


@register("positives_per_client", S("""
SELECT DISTINCT b.client_id, b.sku AS item FROM product_buy b, split s
WHERE b."timestamp" >= s.train_start AND b."timestamp" < s.val_start"""))
def q_positives_per_client(spark, sf):
    t, _ = Ctx(spark, sf).targets()
    return K.positives_per_client(t)


@register("item_popularity", S("""
SELECT sku AS item, count(*) AS popularity FROM input_buys GROUP BY sku"""))
def q_item_popularity(spark, sf):
    return K.item_popularity(Ctx(spark, sf).input_buys)


ALL_TS_SQL = """
, all_ts AS (SELECT client_id, "timestamp" FROM products UNION ALL SELECT client_id, "timestamp" FROM page_visit
             UNION ALL SELECT client_id, "timestamp" FROM search_query)
, wk AS (SELECT client_id, CAST(weekofyear("timestamp") AS INTEGER) AS week, count(*) AS event_count
         FROM all_ts GROUP BY 1, 2)
"""


def all_timestamps(ctx: Ctx):
    return (ctx.products.select("client_id", "timestamp")
            .unionByName(ctx.page_visit.select("client_id", "timestamp"))
            .unionByName(ctx.search_query.select("client_id", "timestamp")))


@register("weekly_counts", S(ALL_TS_SQL + "SELECT * FROM wk"))
def q_weekly_counts(spark, sf):
    return K.weekly_counts(all_timestamps(Ctx(spark, sf)))


# ------------------------------------------------------------------------------------------------
# 2.6 top-k, 2.7 set operations
# ------------------------------------------------------------------------------------------------


@register("top_skus", S("""
SELECT sku, count(*) AS "count", CAST(row_number() OVER (ORDER BY count(*) DESC, sku) AS INTEGER) AS rank
FROM product_buy GROUP BY sku ORDER BY count(*) DESC, sku LIMIT 150"""))
def q_top_skus(spark, sf):
    return W.top_skus(Ctx(spark, sf).product_buy)


@register("top_categories", S("""
SELECT pp.category, count(*) AS "count",
       CAST(row_number() OVER (ORDER BY count(*) DESC, pp.category NULLS LAST) AS INTEGER) AS rank
FROM product_buy b LEFT JOIN product_properties pp USING (sku)
GROUP BY pp.category ORDER BY count(*) DESC, pp.category NULLS LAST LIMIT 150"""))
def q_top_categories(spark, sf):
    ctx = Ctx(spark, sf)
    return W.top_categories(ctx.product_buy, ctx.product_properties)


@register("weeks_desc", S(ALL_TS_SQL + """
SELECT week, CAST(row_number() OVER (ORDER BY week DESC) AS INTEGER) AS position
FROM (SELECT DISTINCT week FROM wk)"""))
def q_weeks_desc(spark, sf):
    ctx = Ctx(spark, sf)
    wk = K.weekly_counts(all_timestamps(ctx)).select("week").distinct()
    # at most 53 rows per year: the ordering window is over this tiny table only
    return wk.select(F.col("week").cast("int").alias("week"),
                     F.row_number().over(Window.orderBy(F.desc("week"))).cast("int").alias("position"))


@register("union_products", S("SELECT * FROM products"))
def q_union_products(spark, sf):
    return Ctx(spark, sf).products


@register("union_all_events", S("""
SELECT client_id, "timestamp", sku, NULL::BIGINT AS url, NULL::VARCHAR AS query, event_type FROM products
UNION ALL SELECT client_id, "timestamp", NULL, url, NULL, 'page_visit' FROM page_visit
UNION ALL SELECT client_id, "timestamp", NULL, NULL, query, 'search_query' FROM search_query"""))
def q_union_all_events(spark, sf):
    ctx = Ctx(spark, sf)
    return W.union_all_events(ctx.products, P.tag_event_type(ctx.page_visit, C.PAGE_VISIT),
                              P.tag_event_type(ctx.search_query, C.SEARCH_QUERY))


@register("distinct_queries", S(SEARCH_SQL + "SELECT query, query_id FROM qids"))
def q_distinct_queries(spark, sf):
    return W.distinct_queries(Ctx(spark, sf).search_query)


@register("distinct_train_ids", S("""
SELECT DISTINCT 'client' AS kind, client_id AS id FROM products
UNION ALL SELECT DISTINCT 'item', sku FROM products"""))
def q_distinct_train_ids(spark, sf):
    ctx = Ctx(spark, sf)
    c = W.distinct_train_ids(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart, "client_id")
    i = W.distinct_train_ids(ctx.product_buy, ctx.add_to_cart, ctx.remove_from_cart, "sku")
    return (c.select(F.lit("client").alias("kind"), F.col("client_id").alias("id"))
            .unionByName(i.select(F.lit("item").alias("kind"), F.col("sku").alias("id"))))


# ------------------------------------------------------------------------------------------------
# large interactions (bench fixture): line items ⋈ orders as product events
# ------------------------------------------------------------------------------------------------

LINE_SQL = """
, li AS (SELECT o.o_custkey AS client_id, l.l_shipdate AS "timestamp", l.l_partkey AS sku,
                CASE l.l_returnflag WHEN 'N' THEN 'product_buy' WHEN 'A' THEN 'add_to_cart'
                                    WHEN 'R' THEN 'remove_from_cart' END AS event_type
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         WHERE l.l_returnflag IN ('N', 'A', 'R'))
"""
_lsel, _ljoins = _count_join("li")
_LINE_COUNT_TABLES = [t for t in COUNT_TABLES if "category" not in t[1]]


@register("line_product_counts", S(LINE_SQL + "".join(
    f", {n} AS ({type_counts_sql('li', k, p)})\n" for n, k, p in _LINE_COUNT_TABLES) + f"""
SELECT li.client_id, li.sku, li.event_type,
       {', '.join(f'COALESCE({n}.{c}, 0) AS {c}' for n, _, p in _LINE_COUNT_TABLES for c in names(p))},
       round({ratio_sql('COALESCE(sc.count_buy, 0)', 'COALESCE(sc.count_add, 0)')}, 6) AS global_cr,
       round({ratio_sql('COALESCE(ct.tot_user_buy, 0)', 'COALESCE(ct.tot_user_add, 0)')}, 6) AS local_cr,
       round({ratio_sql('COALESCE(scc.count_user_buy, 0)', 'COALESCE(scc.count_user_add, 0)')}, 6) AS cr
FROM li {' '.join(f"LEFT JOIN {n} ON " + ' AND '.join(f'li.{k} = {n}.{k}' for k in ks) for n, ks, _ in _LINE_COUNT_TABLES)}"""))
def q_line_product_counts(spark, sf):
    """Per-type counts (sku, sku+client, client) and rates over the line-item interactions."""
    ev = Ctx(spark, sf).line_interactions
    out = (ev.join(K.sku_counts(ev), "sku", "left")
           .join(K.sku_client_counts(ev), ["sku", "client_id"], "left")
           .join(K.client_totals(ev), "client_id", "left"))
    out = P.fill_numeric_nulls(out)
    out = out.withColumns({
        "global_cr": r6(K.conversion_ratio("count_buy", "count_add")),
        "local_cr": r6(K.conversion_ratio("tot_user_buy", "tot_user_add")),
        "cr": r6(K.conversion_ratio("count_user_buy", "count_user_add"))})
    cnt = [c for _, _, p in _LINE_COUNT_TABLES for c in names(p)]
    return out.select("client_id", "sku", "event_type", *cnt, "global_cr", "local_cr", "cr")

# what the sinks read back is what was written
ORACLES["materialize_once"] = ORACLES["top_skus"]
ORACLES["sink_features"] = ORACLES["conversion_rates"]
