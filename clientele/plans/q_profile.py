"""Queries for the aggregate profile, vector parsing, temporal features, weekly pivot,
scaling, encoders, sequences, padding and pooling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import event_type_onehot
from clientele.functions.vectors import parse_vector_lenient, parse_vector_strict
from clientele.operators import counts as K
from clientele.operators import encode as EN
from clientele.operators import joins as J
from clientele.operators import profile as PR
from clientele.operators import scale as SC
from clientele.operators import windows as W
from clientele.plans import oracle as O
from clientele.plans.context import Ctx
from clientele.plans.q_basic import COUNT_COLS, EV_KEY, PC_SQL, all_timestamps, product_counts
from clientele.plans.q_features import (ENT_COLS, PENT_SQL, product_features, product_with_clusters,
                                        search_features, visit_features)
from clientele.plans.registry import long_form, r6, register

S = O.sql

# ------------------------------------------------------------------------------------------------
# aggregate profile
# ------------------------------------------------------------------------------------------------

PROFILE_TYPES = [C.PRODUCT_BUY, C.ADD_TO_CART, C.REMOVE_FROM_CART, C.PAGE_VISIT]


def _typed(ctx: Ctx, t: str):
    ev = ctx.event_table(t)
    if t in C.PRODUCT_TYPES:
        ev = ev.join(ctx.product_properties, "sku", "left")
    return ev.join(ctx.relevant_clients, "client_id", "left_semi")


def tv_sql(t: str, cols: list[str], n: int = C.PROFILE_TOP_N) -> str:
    src = (f"(SELECT e.*, p.category, p.price FROM {t} e LEFT JOIN product_properties p USING (sku))"
           if t in C.PRODUCT_TYPES else t)
    parts = [f"""SELECT '{c}' AS column_name, CAST({c} AS BIGINT) AS value, count(*) AS "count"
                 FROM rel_{t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} NULLS LAST LIMIT {n}""" for c in cols]
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""
, rel_{t} AS (SELECT * FROM {src} x WHERE x.client_id IN (SELECT client_id FROM relevant_clients))
, tv_{t} AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY "count" DESC, value NULLS LAST) AS INTEGER) AS rank
             FROM ({union}))
"""


@register("top_values", S("".join(tv_sql(t, C.EVENT_TYPE_TO_COLUMNS[t]) for t in PROFILE_TYPES) +
                          " UNION ALL ".join(f"SELECT '{t}' AS event_type, * FROM tv_{t}" for t in PROFILE_TYPES)))
def q_top_values(spark, sf):
    ctx = Ctx(spark, sf)
    out = None
    for t in PROFILE_TYPES:
        tv = PR.top_values(_typed(ctx, t), C.EVENT_TYPE_TO_COLUMNS[t]).withColumn("event_type", F.lit(t))
        out = tv if out is None else out.unionByName(tv)
    return out


def wvc_sql(t: str, cols: list[str], days=C.PROFILE_NUM_DAYS) -> str:
    """Dense per-client vectors in long form ``wv_<t>(client_id, pos, value)``."""
    offs = " + ".join(["0"])
    col_off = []
    for i, c in enumerate(cols):
        prev = " + ".join([f"(SELECT count(*) FROM tv_{t} WHERE column_name = '{p}')" for p in cols[:i]]) or "0"
        col_off.append(f"SELECT '{c}' AS column_name, {prev} AS coff")
    since = ", ".join(f"count(*) FILTER (WHERE \"timestamp\" >= mx - INTERVAL {d} DAY) AS w{i}"
                      for i, d in enumerate(days))
    unpivot = " UNION ALL ".join(
        f"SELECT client_id, \"timestamp\", '{c}' AS column_name, CAST({c} AS BIGINT) AS value FROM rel_{t}" for c in cols)
    per_window = " UNION ALL ".join(
        f"SELECT client_id, 1 + {i} * blk + coff + rank - 1 AS pos, w{i} AS v FROM cnt_{t}"
        for i in range(len(days)))
    return f"""
, coff_{t} AS ({' UNION ALL '.join(col_off)})
, lng_{t} AS ({unpivot})
, cnt_{t} AS (SELECT l.client_id, tv.rank, co.coff, (SELECT count(*) FROM tv_{t}) AS blk, {since}
              FROM lng_{t} l JOIN tv_{t} tv USING (column_name, value) JOIN coff_{t} co USING (column_name)
              CROSS JOIN (SELECT max("timestamp") AS mx FROM rel_{t})
              GROUP BY l.client_id, tv.rank, co.coff)
, nz_{t} AS ({per_window})
, sz_{t} AS (SELECT 1 + {len(days)} * (SELECT count(*) FROM tv_{t}) AS size)
, wv_{t} AS (
    SELECT c.client_id, g.pos,
           CAST(CASE WHEN g.pos = 0 THEN c.tot ELSE COALESCE(nz.v, 0) END AS DOUBLE) AS value
    FROM (SELECT client_id, count(*) AS tot FROM rel_{t} GROUP BY client_id) c
    CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range((SELECT size FROM sz_{t}))) g
    LEFT JOIN nz_{t} nz ON nz.client_id = c.client_id AND nz.pos = g.pos)
"""


@register("windowed_value_counts", S(tv_sql(C.ADD_TO_CART, C.EVENT_TYPE_TO_COLUMNS[C.ADD_TO_CART]) +
                                     wvc_sql(C.ADD_TO_CART, C.EVENT_TYPE_TO_COLUMNS[C.ADD_TO_CART]) +
                                     "SELECT client_id, pos, round(value, 6) AS value FROM wv_add_to_cart"))
def q_windowed_value_counts(spark, sf):
    ctx = Ctx(spark, sf)
    ev = _typed(ctx, C.ADD_TO_CART)
    cols = C.EVENT_TYPE_TO_COLUMNS[C.ADD_TO_CART]
    out, _ = PR.stats_calculator(cols, C.PROFILE_NUM_DAYS, C.PROFILE_TOP_N)(ev)
    return long_form(out, ["client_id"], "features")


QV_SQL = """
, rel_sq AS (SELECT * FROM search_query WHERE client_id IN (SELECT client_id FROM relevant_clients))
, qv AS (SELECT client_id, CAST(i - 1 AS INTEGER) AS pos, avg(CAST(v[i] AS DOUBLE)) AS value
         FROM (SELECT client_id, list_transform(list_filter(string_split(replace(replace(query, '[', ''), ']', ''), ' '),
                      lambda s: s <> ''), lambda s: CAST(s AS INTEGER)) AS v FROM rel_sq) t,
              range(1, len(v) + 1) r(i)
         GROUP BY client_id, i)
"""


@register("mean_query_vector", S(QV_SQL + "SELECT client_id, pos, round(value, 6) AS value FROM qv"))
def q_mean_query_vector(spark, sf):
    ctx = Ctx(spark, sf)
    sq = ctx.search_query.join(ctx.relevant_clients, "client_id", "left_semi")
    return long_form(PR.mean_query_vector(sq), ["client_id"], "features")


@register("merge_event_features", S(tv_sql(C.PAGE_VISIT, ["url"]) + wvc_sql(C.PAGE_VISIT, ["url"]) + QV_SQL + """
, cl AS (SELECT client_id FROM wv_page_visit UNION SELECT client_id FROM qv)
, sz AS (SELECT size FROM sz_page_visit)
SELECT cl.client_id, g.pos, round(COALESCE(w.value, 0.0), 6) AS value
FROM cl CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range((SELECT size FROM sz))) g
LEFT JOIN wv_page_visit w ON w.client_id = cl.client_id AND w.pos = g.pos
UNION ALL
SELECT cl.client_id, CAST((SELECT size FROM sz) + g.pos AS INTEGER), round(COALESCE(q.value, 0.0), 6)
FROM cl CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range(16)) g
LEFT JOIN qv q ON q.client_id = cl.client_id AND q.pos = g.pos"""))
def q_merge_event_features(spark, sf):
    ctx = Ctx(spark, sf)
    v = _typed(ctx, C.PAGE_VISIT)
    visits, size = PR.stats_calculator(["url"], C.PROFILE_NUM_DAYS, C.PROFILE_TOP_N)(v)
    sq = ctx.search_query.join(ctx.relevant_clients, "client_id", "left_semi")
    merged = J.merge_event_features([(visits, size), (PR.mean_query_vector(sq), 16)])
    return long_form(merged, ["client_id"], "embedding")


def aggregate_profile(ctx: Ctx):
    events_of = {t: (ctx.event_table(t).join(ctx.product_properties, "sku", "left")
                     if t in C.PRODUCT_TYPES else ctx.event_table(t))
                 for t in C.EVENT_TYPE_TO_COLUMNS}
    return PR.aggregate_profile(events_of, ctx.relevant_clients)


@register("aggregate_profile")
def q_aggregate_profile(spark, sf):
    return long_form(aggregate_profile(Ctx(spark, sf)), ["client_id"], "embedding")


@register("register_calculator")
def q_register_calculator(spark, sf):
    """A custom plug-in calculator with mergeable states replaces the visit statistics:
    events, distinct urls, mean url (the state ends with the distinct urls)."""
    ctx = Ctx(spark, sf)

    def accumulate(pdf):
        urls = pdf["url"].dropna()
        return [len(pdf), len(urls), urls.sum(), *sorted(urls.unique())]

    def merge(a, b):
        return [a[0] + b[0], a[1] + b[1], a[2] + b[2], *sorted({*a[3:], *b[3:]})]

    def finish(s):
        return [s[0], float(len(s) - 3), s[2] / s[1] if s[1] else 0.0]

    PR.register_calculator(C.PAGE_VISIT, PR.mergeable_calculator(accumulate, merge, finish, 3))
    try:
        prof = aggregate_profile(ctx)
    finally:
        PR.unregister_calculator(C.PAGE_VISIT)
    return prof.select("client_id", F.size("embedding").alias("width"),
                       r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# ------------------------------------------------------------------------------------------------
# vector parsing
# ------------------------------------------------------------------------------------------------

NAMES_SQL = """
, nv AS (SELECT sku, list_transform(list_filter(string_split(replace(replace(name, '[', ''), ']', ''), ' '),
                lambda s: s <> ''), lambda s: CAST(s AS INTEGER)) AS v FROM product_properties)
, nvl AS (SELECT sku, CAST(i - 1 AS INTEGER) AS pos, v[i] AS value FROM nv, range(1, len(v) + 1) r(i))
"""


@register("parse_vector_strict", S(NAMES_SQL + "SELECT sku, pos, value FROM nvl"))
def q_parse_vector_strict(spark, sf):
    p = Ctx(spark, sf).product_properties.select("sku", parse_vector_strict("name").alias("v"))
    return long_form(p, ["sku"], "v", round_values=False)


@register("parse_vector_lenient", S(NAMES_SQL + "SELECT sku, pos, value FROM nvl"))
def q_parse_vector_lenient(spark, sf):
    # the same names written with commas: '[1, 2, 3]'
    p = Ctx(spark, sf).product_properties.select(
        "sku", parse_vector_lenient(F.regexp_replace("name", " ", ", ")).alias("v"))
    return long_form(p, ["sku"], "v", round_values=False)


@register("vector_minmax", S(NAMES_SQL + """
SELECT CAST(min(value) AS DOUBLE) AS min_val, CAST(max(value) AS DOUBLE) AS max_val FROM nvl"""))
def q_vector_minmax(spark, sf):
    p = Ctx(spark, sf).product_properties.select(parse_vector_strict("name").alias("embedding"))
    return SC.vector_minmax(p)


@register("scale_vectors", S(NAMES_SQL + """
SELECT sku, pos, round((value - mn) / (mx - mn) * 2 - 1, 6) AS value
FROM nvl CROSS JOIN (SELECT CAST(min(value) AS DOUBLE) AS mn, CAST(max(value) AS DOUBLE) AS mx FROM nvl)"""))
def q_scale_vectors(spark, sf):
    p = Ctx(spark, sf).product_properties.select("sku", parse_vector_strict("name").alias("embedding"))
    return long_form(SC.scale_vectors(p), ["sku"], "norm")


@register("vector_max_norm", S(NAMES_SQL + """
SELECT sku, pos, round(value / mx, 6) AS value FROM nvl CROSS JOIN (SELECT CAST(max(value) AS DOUBLE) AS mx FROM nvl)"""))
def q_vector_max_norm(spark, sf):
    p = Ctx(spark, sf).product_properties.select("sku", parse_vector_strict("name").alias("embedding"))
    return long_form(SC.vector_max_norm(p), ["sku"], "norm")


# ------------------------------------------------------------------------------------------------
# temporal features, weekly pivot
# ------------------------------------------------------------------------------------------------

ALLEV_SQL = """
, allev AS (SELECT client_id, "timestamp", event_type FROM products
            UNION ALL SELECT client_id, "timestamp", 'page_visit' FROM page_visit
            UNION ALL SELECT client_id, "timestamp", 'search_query' FROM search_query)
"""


def all_events(ctx: Ctx):
    return (ctx.products.select("client_id", "timestamp", "event_type")
            .unionByName(ctx.page_visit.select("client_id", "timestamp", F.lit(C.PAGE_VISIT).alias("event_type")))
            .unionByName(ctx.search_query.select("client_id", "timestamp",
                                                 F.lit(C.SEARCH_QUERY).alias("event_type"))))


TEMP_COLS = ["hour_norm", "weekday_norm", "week_of_month_norm", "weeks_diff"]


def temporal_sql(end_expr: str, unit: bool) -> str:
    sc = (lambda e: e) if unit else (lambda e: f"{e} * 2 - 1")
    return f"""
SELECT client_id, "timestamp", event_type, CAST(hour("timestamp") AS INTEGER) AS hour,
       CAST(isodow("timestamp") AS INTEGER) AS weekday, CAST(day("timestamp") AS INTEGER) AS day,
       CAST(month("timestamp") AS INTEGER) AS month,
       round({sc('hour("timestamp") / 23.0')}, 6) AS hour_norm,
       round({sc('isodow("timestamp") / 6.0')}, 6) AS weekday_norm,
       round({sc('day("timestamp") / 31.0')}, 6) AS week_of_month_norm,
       round(((epoch_us({end_expr}) - epoch_us("timestamp")) // 86400000000) / 7.0, 6) AS weeks_diff
FROM allev"""


@register("temporal_features", S(ALLEV_SQL + temporal_sql("(SELECT max(\"timestamp\") FROM allev)", False)))
def q_temporal_features(spark, sf):
    out = EN.temporal_features(all_events(Ctx(spark, sf)))
    return out.select("client_id", "timestamp", "event_type", "hour", "weekday", "day", "month",
                      *[r6(c).alias(c) for c in TEMP_COLS])


UNIT_END = dt.datetime(2024, 2, 1)


@register("temporal_features_unit", S(ALLEV_SQL + temporal_sql("TIMESTAMP '2024-02-01 00:00:00'", True)))
def q_temporal_features_unit(spark, sf):
    out = EN.temporal_features_unit(all_events(Ctx(spark, sf)), UNIT_END)
    return out.select("client_id", "timestamp", "event_type", "hour", "weekday", "day", "month",
                      *[r6(c).alias(c) for c in TEMP_COLS])


# The weeks of the driver's event stream (fixed values): SQL needs its columns by name.
PIVOT_WEEKS = (1, 2, 3, 4, 5)
PIVOT_SQL = """
, piv AS (SELECT user_id AS client_id, """ + ", ".join(
    f'count(*) FILTER (WHERE weekofyear(ts) = {w}) AS "{w}"' for w in PIVOT_WEEKS) + """
          FROM events WHERE event_type IN ('purchase', 'click', 'error', 'view', 'signup')
          GROUP BY user_id)
"""


def weekly(ctx: Ctx):
    return W.weekly_pivot(K.weekly_counts(all_timestamps(ctx)))


@register("weekly_pivot", S(PIVOT_SQL + "SELECT * FROM piv"))
def q_weekly_pivot(spark, sf):
    return weekly(Ctx(spark, sf))


@register("attach_slope", S(PIVOT_SQL + """
SELECT v.client_id, v."timestamp", v.url, """ + ", ".join(f'piv."{w}"' for w in PIVOT_WEEKS) + """
FROM page_visit v LEFT JOIN piv USING (client_id)"""))
def q_attach_slope(spark, sf):
    ctx = Ctx(spark, sf)
    return J.attach_slope(ctx.page_visit, weekly(ctx))


@register("cap_weekly", S(PIVOT_SQL + """
SELECT client_id, """ + ", ".join(f'round(least("{w}" / 600.0, 1.0), 6) AS "{w}"' for w in PIVOT_WEEKS) + " FROM piv"))
def q_cap_weekly(spark, sf):
    wk = weekly(Ctx(spark, sf))
    cols = [c for c in wk.columns if c != "client_id"]
    out = SC.cap_weekly(wk, cols)
    return out.select("client_id", *[r6(c).alias(c) for c in cols])


# ------------------------------------------------------------------------------------------------
# scaling
# ------------------------------------------------------------------------------------------------

MM_COLS = ["count_add", "count_user_buy", "tot_user_add", "count_cat_buy"]


def minmax_sql(cols: list[str], src: str, pre: str = "") -> str:
    sel = ", ".join(
        f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {pre}{c} - min({c}) OVER () "
        f"ELSE ({pre}{c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END * 2 - 1, 6) AS {c}"
        for c in cols)
    return f'SELECT client_id, "timestamp", sku, event_type, {sel} FROM {src}'


@register("scale_minmax", S(PC_SQL + minmax_sql(MM_COLS, "pc")))
def q_scale_minmax(spark, sf):
    out = SC.scale_minmax(product_counts(Ctx(spark, sf)), MM_COLS)
    return out.select(*EV_KEY, *[r6(c).alias(c) for c in MM_COLS])


@register("scale_log", S(PENT_SQL + """
, lg AS (SELECT client_id, "timestamp", sku, event_type, """ +
                         ", ".join(f"ln(1 + {c}) AS {c}" for c in ENT_COLS) + " FROM pent)\n" +
                         minmax_sql(ENT_COLS, "lg")))
def q_scale_log(spark, sf):
    ev = product_with_clusters(Ctx(spark, sf), entropies=True)
    out = SC.scale_log(ev, ENT_COLS)
    return out.select(*EV_KEY, *[r6(c).alias(c) for c in ENT_COLS])


@register("scale_yeo")
def q_scale_yeo(spark, sf):
    wk = weekly(Ctx(spark, sf))
    cols = [c for c in wk.columns if c != "client_id"]
    out = SC.scale_yeo(wk, cols)
    return out.select("client_id", *[r6(c).alias(c) for c in cols])


@register("scale_yeo_wide")
def q_scale_yeo_wide(spark, sf):
    """Weekly counts in thousands: values this small have a λ far outside the usual range."""
    wk = weekly(Ctx(spark, sf))
    cols = [c for c in wk.columns if c != "client_id"]
    out = SC.scale_yeo(wk.withColumns({c: F.col(c) / 1000.0 for c in cols}), cols)
    return out.select("client_id", *[r6(c).alias(c) for c in cols])


@register("scale_groups", S(PC_SQL + minmax_sql(COUNT_COLS, "pc")))
def q_scale_groups(spark, sf):
    # count group of the product kind with the minmax normalizer
    df = product_counts(Ctx(spark, sf))
    out = SC.scale_columns(df, COUNT_COLS, "minmax")
    return out.select(*EV_KEY, *[r6(c).alias(c) for c in COUNT_COLS])


@register("max_scale", S(PC_SQL + "SELECT client_id, \"timestamp\", sku, event_type, " + ", ".join(
    f"round(COALESCE({c}, 0) / (max({c}) OVER () + 1e-9), 6) AS {c}" for c in MM_COLS) + " FROM pc"))
def q_max_scale(spark, sf):
    out = SC.max_scale(product_counts(Ctx(spark, sf)), MM_COLS)
    return out.select(*EV_KEY, *[r6(c).alias(c) for c in MM_COLS])


ENT_NORM = [("sku_entropy", "client_id"), ("user_sku_entropy", "sku"), ("user_cat_entropy", "category")]


@register("entropy_norm", S(PENT_SQL + """
SELECT client_id, "timestamp", sku, event_type, """ + ", ".join(
    f"round(COALESCE({c}, 0.0) / (log2((SELECT count(DISTINCT {k}) FROM pent)) + 1e-9), 6) AS {c}"
    for c, k in ENT_NORM) + " FROM pent"))
def q_entropy_norm(spark, sf):
    ev = product_with_clusters(Ctx(spark, sf), entropies=True)
    out = SC.entropy_norm(ev, ENT_NORM)
    return out.select(*EV_KEY, *[r6(c).alias(c) for c, _ in ENT_NORM])


# ------------------------------------------------------------------------------------------------
# sequences, encoders, padding, pooling
# ------------------------------------------------------------------------------------------------


@register("client_sequences", S(ALLEV_SQL + """
SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY "timestamp") - 1 AS INTEGER) AS pos,
       "timestamp", event_type FROM allev"""))
def q_client_sequences(spark, sf):
    return EN.client_sequences(all_events(Ctx(spark, sf)))


ONEHOT_SQL = ALLEV_SQL + """
, seq AS (SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY "timestamp") - 1 AS INTEGER) AS pos,
                 [CAST(event_type = 'product_buy' AS DOUBLE), CAST(event_type = 'add_to_cart' AS DOUBLE),
                  CAST(event_type = 'remove_from_cart' AS DOUBLE), CAST(event_type = 'page_visit' AS DOUBLE),
                  CAST(event_type NOT IN ('product_buy', 'add_to_cart', 'remove_from_cart', 'page_visit') AS DOUBLE)] AS vec
          FROM allev)
, steps AS (SELECT c.client_id, CAST(s.range AS INTEGER) AS pos FROM (SELECT DISTINCT client_id FROM seq) c
            CROSS JOIN range((SELECT max(pos) + 1 FROM seq)) s)
, padded AS (SELECT st.client_id, st.pos, COALESCE(seq.vec, [-1.0, -1.0, -1.0, -1.0, -1.0]) AS vec
             FROM steps st LEFT JOIN seq USING (client_id, pos))
"""


def onehot_sequences(ctx: Ctx):
    seq = EN.client_sequences(all_events(ctx))
    return seq.select("client_id", "pos", event_type_onehot("event_type").cast("array<double>").alias("vec"))


@register("pad_sequences", S(ONEHOT_SQL + """
SELECT client_id, pos, CAST(d - 1 AS INTEGER) AS dim, vec[d] AS value FROM padded, range(1, 6) r(d)"""))
def q_pad_sequences(spark, sf):
    padded = EN.pad_sequences(onehot_sequences(Ctx(spark, sf)), "vec")
    return padded.select("client_id", "pos", F.posexplode("vec").alias("dim", "value")) \
        .withColumn("dim", F.col("dim").cast("int"))


@register("sequence_length", S(ONEHOT_SQL + """
SELECT client_id, count(*) FILTER (WHERE list_bool_or(list_transform(vec, lambda x: x <> -1.0))) AS length
FROM padded GROUP BY client_id"""))
def q_sequence_length(spark, sf):
    padded = EN.pad_sequences(onehot_sequences(Ctx(spark, sf)), "vec")
    return EN.sequence_length(padded, "vec")


@register("masked_mean_pool", S(ONEHOT_SQL + """
SELECT client_id, CAST(d - 1 AS INTEGER) AS pos, round(avg(vec[d]), 6) AS value
FROM padded, range(1, 6) r(d) WHERE list_bool_or(list_transform(vec, lambda x: x <> -1.0))
GROUP BY client_id, d"""))
def q_masked_mean_pool(spark, sf):
    padded = EN.pad_sequences(onehot_sequences(Ctx(spark, sf)), "vec")
    out = EN.masked_mean_pool(padded, "vec")
    return out.select("client_id", F.col("pos").cast("int"), r6("value").alias("value"))


def names_norm(ctx: Ctx):
    """Scaled name vectors keyed by sku (the map the product encoder reads)."""
    p = ctx.product_properties.select("sku", parse_vector_strict("name").alias("embedding"))
    return SC.scale_vectors(p).select("sku", "norm")


PROD_ENC_SQL = PENT_SQL + NAMES_SQL + """
, nn AS (SELECT sku, list_transform(v, lambda x: (x - mn) / (mx - mn) * 2 - 1) AS norm
         FROM nv CROSS JOIN (SELECT CAST(min(value) AS DOUBLE) AS mn, CAST(max(value) AS DOUBLE) AS mx FROM nvl))
, tops AS (SELECT sku FROM product_buy GROUP BY sku ORDER BY count(*) DESC, sku LIMIT 150)
, topc AS (SELECT pp.category FROM product_buy b LEFT JOIN product_properties pp USING (sku)
           GROUP BY pp.category ORDER BY count(*) DESC, pp.category NULLS LAST LIMIT 150)
, feat AS (SELECT pent.*, CAST(pent.sku IN (SELECT sku FROM tops) AS DOUBLE) AS top_sku,
                  CAST(pent.category IN (SELECT category FROM topc) AS DOUBLE) AS top_category,
                  CASE WHEN count_user_add = 0 THEN (CASE WHEN count_user_buy = 0 THEN 0.0 ELSE 1.0 END) ELSE count_user_buy / count_user_add END AS cr,
                  CASE WHEN tot_user_add = 0 THEN (CASE WHEN tot_user_buy = 0 THEN 0.0 ELSE 1.0 END) ELSE tot_user_buy / tot_user_add END AS local_cr,
                  CASE WHEN count_add = 0 THEN (CASE WHEN count_buy = 0 THEN 0.0 ELSE 1.0 END) ELSE count_buy / count_add END AS global_cr,
                  CASE WHEN count_cat_add = 0 THEN (CASE WHEN count_cat_buy = 0 THEN 0.0 ELSE 1.0 END) ELSE count_cat_buy / count_cat_add END AS global_cat_cr,
                  CASE WHEN count_cat_user_add = 0 THEN (CASE WHEN count_cat_user_buy = 0 THEN 0.0 ELSE 1.0 END) ELSE count_cat_user_buy / count_cat_user_add END AS local_cat_cr,
                  ((SELECT price FROM product_properties pp WHERE pp.sku = pent.sku) + 1) / 100.0 AS price
           FROM pent)
, enc AS (SELECT client_id, "timestamp", event_type,
                 list_concat([""" + ", ".join(f"CAST({c} AS DOUBLE)" for c in C.PRODUCT_SCALARS) + """],
                             nn.norm) AS v
          FROM feat LEFT JOIN nn USING (sku))
"""


@register("encode_product", S(PROD_ENC_SQL + """
SELECT client_id, "timestamp", event_type, CAST(i - 1 AS INTEGER) AS pos, round(v[i], 6) AS value
FROM enc, range(1, len(v) + 1) r(i)"""))
def q_encode_product(spark, sf):
    ctx = Ctx(spark, sf)
    f = product_features(ctx).join(names_norm(ctx), "sku", "left")
    enc = f.select("client_id", "timestamp", "event_type", EN.encode_product(f).alias("v"))
    return long_form(enc, ["client_id", "timestamp", "event_type"], "v")


@register("encode_event", S(PROD_ENC_SQL + """
, mx AS (SELECT max("timestamp") AS mx FROM feat)
, fullv AS (SELECT e.client_id, e."timestamp", e.event_type,
                  list_concat([CAST(e.event_type = 'product_buy' AS DOUBLE), CAST(e.event_type = 'add_to_cart' AS DOUBLE),
                               CAST(e.event_type = 'remove_from_cart' AS DOUBLE), 0.0, 0.0,
                               hour(e."timestamp") / 23.0 * 2 - 1, isodow(e."timestamp") / 6.0 * 2 - 1,
                               day(e."timestamp") / 31.0 * 2 - 1], e.v) AS v,
                  exp(-0.06 * (((epoch_us(mx.mx) - epoch_us(e."timestamp")) // 86400000000) / 7.0)) AS w
           FROM enc e CROSS JOIN mx)
SELECT client_id, "timestamp", event_type, CAST(i - 1 AS INTEGER) AS pos, round(v[i] * w, 6) AS value
FROM fullv, range(1, len(v) + 1) r(i)"""))
def q_encode_event(spark, sf):
    ctx = Ctx(spark, sf)
    f = EN.temporal_features(product_features(ctx).join(names_norm(ctx), "sku", "left"))
    enc = EN.encode_event(f, weekly_cols=[])
    return long_form(enc.select("client_id", "timestamp", "event_type", "encoded"),
                     ["client_id", "timestamp", "event_type"], "encoded")


@register("encode_visit")
def q_encode_visit(spark, sf):
    ctx = Ctx(spark, sf)
    v = visit_features(ctx)
    wk = weekly(ctx)
    cols = [c for c in wk.columns if c != "client_id"]
    v = v.join(wk, "client_id", "left")
    enc = v.select("client_id", "timestamp", EN.encode_visit(v, cols).alias("v"))
    return long_form(enc, ["client_id", "timestamp"], "v")


@register("encode_search")
def q_encode_search(spark, sf):
    ctx = Ctx(spark, sf)
    s = search_features(ctx)
    from clientele.plans.q_basic import search_ids
    _, _, q = search_ids(ctx)
    qn = SC.scale_vectors(q.select("query_id", parse_vector_strict("query").alias("embedding")))
    s = s.join(qn.select("query_id", "norm"), "query_id", "left")
    enc = s.select("client_id", "timestamp", EN.encode_search(s).alias("v"))
    return long_form(enc, ["client_id", "timestamp"], "v")


def grouped_pipeline(ctx: Ctx, normalizer: str = "yeo"):
    """scale three kinds → union → temporal → weekly columns → sequences (long form)."""
    from clientele.plans import pipelines as P2
    from clientele.plans.q_basic import search_ids
    _, _, q = search_ids(ctx)
    qn = SC.scale_vectors(q.select("query_id", parse_vector_strict("query").alias("embedding")))
    return P2.grouped_pipeline(product_features(ctx), visit_features(ctx), search_features(ctx),
                               names_norm(ctx), qn.select("query_id", "norm"), normalizer)


@register("grouped_pipeline")
def q_grouped_pipeline(spark, sf):
    g = grouped_pipeline(Ctx(spark, sf))
    return g.select("client_id", "pos", "timestamp", "event_type", F.size("encoded").alias("width"),
                    r6(F.aggregate("encoded", F.lit(0.0), lambda a, x: a + x)).alias("encoded_sum"))


@register("attach_norm_vector", S(NAMES_SQL + """
, nn AS (SELECT sku, list_transform(v, lambda x: (x - mn) / (mx - mn) * 2 - 1) AS norm
         FROM nv CROSS JOIN (SELECT CAST(min(value) AS DOUBLE) AS mn, CAST(max(value) AS DOUBLE) AS mx FROM nvl))
SELECT p.client_id, p."timestamp", p.sku, p.event_type, CAST(i - 1 AS INTEGER) AS pos, round(nn.norm[i], 6) AS value
FROM products p JOIN nn USING (sku), range(1, len(nn.norm) + 1) r(i)"""))
def q_attach_norm_vector(spark, sf):
    ctx = Ctx(spark, sf)
    out = J.attach_norm_vector(ctx.products, names_norm(ctx), "sku")
    return long_form(out, EV_KEY, "norm")


@register("sink_sequences", S("""
, allev AS (SELECT client_id, "timestamp", event_type FROM products
            UNION ALL SELECT client_id, "timestamp", 'page_visit' FROM page_visit
            UNION ALL SELECT client_id, "timestamp", 'search_query' FROM search_query)
, seq AS (SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY "timestamp") - 1 AS INTEGER) AS pos,
                 "timestamp", event_type FROM allev)
SELECT * FROM seq WHERE client_id IN (SELECT client_id FROM relevant_clients)"""))
def q_sink_sequences(spark, sf):
    """Write all-client and relevant-client sequence tables; read the relevant one back."""
    from clientele.sources import readers as R
    ctx = Ctx(spark, sf)
    seq = EN.client_sequences(all_events(ctx))
    back = R.sink_sequences(seq, ctx.relevant_clients)
    return back.select("client_id", "pos", "timestamp", "event_type")


_AGG_TYPES = list(C.EVENT_TYPE_TO_COLUMNS)
_AGG_SQL = "".join(tv_sql(t, C.EVENT_TYPE_TO_COLUMNS[t]) + wvc_sql(t, C.EVENT_TYPE_TO_COLUMNS[t])
                   for t in PROFILE_TYPES) + QV_SQL


def _agg_oracle() -> str:
    # offsets of each type's block in the fixed type order (search block has width 16)
    off = []
    acc = "0"
    for t in _AGG_TYPES:
        off.append((t, acc))
        size = "16" if t == C.SEARCH_QUERY else f"(SELECT size FROM sz_{t})"
        acc = f"{acc} + {size}"
    cl = " UNION ".join([f"SELECT client_id FROM wv_{t}" for t in PROFILE_TYPES] + ["SELECT client_id FROM qv"])
    parts = []
    for t, o in off:
        if t == C.SEARCH_QUERY:
            parts.append(f"""SELECT cl.client_id, CAST({o} + g.pos AS INTEGER) AS pos, round(COALESCE(q.value, 0.0), 6) AS value
FROM cl CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range(16)) g
LEFT JOIN qv q ON q.client_id = cl.client_id AND q.pos = g.pos""")
        else:
            parts.append(f"""SELECT cl.client_id, CAST({o} + g.pos AS INTEGER) AS pos, round(COALESCE(w.value, 0.0), 6) AS value
FROM cl CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range((SELECT size FROM sz_{t}))) g
LEFT JOIN wv_{t} w ON w.client_id = cl.client_id AND w.pos = g.pos""")
    return _AGG_SQL + f", cl AS ({cl})\n" + "\nUNION ALL\n".join(parts)


from clientele.plans.registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["aggregate_profile"] = S(_agg_oracle())


# ---- encoder oracles: the visit / search feature SQL + weekly vectors + query norms -----------
from clientele.plans.q_features import ASOF_SQL, SEARCH_PIPE_SQL, entropy_sql  # noqa: E402

WEEKVEC_SQL = """
, wk2 AS (SELECT client_id, CAST(weekofyear("timestamp") AS INTEGER) AS week, count(*) AS event_count
          FROM (SELECT client_id, "timestamp" FROM products UNION ALL SELECT client_id, "timestamp" FROM page_visit
                UNION ALL SELECT client_id, "timestamp" FROM search_query) GROUP BY 1, 2)
, weeks AS (SELECT DISTINCT week FROM wk2)
, wvec AS (SELECT c.client_id, list(CAST(COALESCE(w.event_count, 0) AS DOUBLE) ORDER BY weeks.week DESC) AS wv
           FROM (SELECT DISTINCT client_id FROM wk2) c CROSS JOIN weeks
           LEFT JOIN wk2 w ON w.client_id = c.client_id AND w.week = weeks.week GROUP BY c.client_id)
"""

VISIT_ENC_SQL = ASOF_SQL + entropy_sql("near", "url", "url_entropy", False) + \
    entropy_sql("near", "url", "client_entropy", True) + WEEKVEC_SQL + """
, visit_vec AS (SELECT n.client_id, n.session_start AS "timestamp",
                list_concat([CAST(cu.client_url_visits AS DOUBLE), CAST(ct.client_total_visits AS DOUBLE),
                             e1.url_entropy, CAST(u."count" AS DOUBLE), CAST(n.has_top_sku AS DOUBLE),
                             CAST(n.has_top_category AS DOUBLE), CAST(n.num_events_nearby AS DOUBLE),
                             CAST(n.time_diff AS DOUBLE)], wvec.wv) AS v
         FROM near n
         LEFT JOIN (SELECT url, count(*) AS "count" FROM page_visit GROUP BY url) u USING (url)
         LEFT JOIN (SELECT client_id, count(*) AS client_total_visits FROM page_visit GROUP BY client_id) ct USING (client_id)
         LEFT JOIN (SELECT client_id, url, count(*) AS client_url_visits FROM page_visit GROUP BY 1, 2) cu USING (client_id, url)
         LEFT JOIN ent_url_entropy e1 USING (url) LEFT JOIN wvec USING (client_id))
SELECT client_id, "timestamp", CAST(i - 1 AS INTEGER) AS pos, round(v[i], 6) AS value
FROM visit_vec, range(1, len(v) + 1) r(i)"""

SEARCH_ENC_SQL = SEARCH_PIPE_SQL + """
, qvec AS (SELECT query_id, list_transform(list_filter(string_split(replace(replace(query, '[', ''), ']', ''), ' '),
                  lambda s: s <> ''), lambda s: CAST(s AS DOUBLE)) AS v FROM qids)
, qmm AS (SELECT min(list_min(v)) AS mn, max(list_max(v)) AS mx FROM qvec)
, qn AS (SELECT query_id, list_transform(list_transform(v, lambda x: [x, mn, mx]), lambda t: (t[1] - t[2]) / (t[3] - t[2]) * 2 - 1) AS norm
         FROM qvec CROSS JOIN qmm)
, sf AS (SELECT ns.client_id, ns.session_start AS "timestamp",
                list_concat([CAST(b.query_user_score AS DOUBLE), CAST(c.queries_made_by_user AS DOUBLE),
                             e3.user_query_entropy, e4.user_cluster_entropy, CAST(a.query_score AS DOUBLE),
                             CAST(e.cluster_score AS DOUBLE), CAST(d.cluster_made_by_user AS DOUBLE),
                             e1.query_entropy, e2.cluster_entropy, CAST(ns.has_top_sku AS DOUBLE),
                             CAST(ns.has_top_category AS DOUBLE), CAST(ns.num_events_nearby AS DOUBLE),
                             CAST(ns.time_diff AS DOUBLE)], qn.norm) AS v
         FROM ns
         LEFT JOIN (SELECT query_id, count(*) AS query_score FROM sqc GROUP BY 1) a USING (query_id)
         LEFT JOIN (SELECT client_id, query_id, count(*) AS query_user_score FROM sqc GROUP BY 1, 2) b USING (client_id, query_id)
         LEFT JOIN (SELECT client_id, count(*) AS queries_made_by_user FROM sqc GROUP BY 1) c USING (client_id)
         LEFT JOIN (SELECT client_id, cluster_id, count(*) AS cluster_made_by_user FROM sqc GROUP BY 1, 2) d USING (client_id, cluster_id)
         LEFT JOIN (SELECT cluster_id, count(*) AS cluster_score FROM sqc GROUP BY 1) e USING (cluster_id)
         LEFT JOIN ent_query_entropy e1 USING (query_id) LEFT JOIN ent_cluster_entropy e2 USING (cluster_id)
         LEFT JOIN ent_user_query_entropy e3 USING (client_id) LEFT JOIN ent_user_cluster_entropy e4 USING (client_id)
         LEFT JOIN qn USING (query_id))
SELECT client_id, "timestamp", CAST(i - 1 AS INTEGER) AS pos, round(v[i], 6) AS value
FROM sf, range(1, len(v) + 1) r(i)"""

_ORACLES["encode_visit"] = S(VISIT_ENC_SQL, recursive=True)
_ORACLES["encode_search"] = S(SEARCH_ENC_SQL, recursive=True)


def _psi_sql(x: str, lam: str) -> str:
    return f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END"


def _yeo_round(prev: str, name: str, grid: str, points: int) -> str:
    """One grid round: CTE ``<name>(col, lam)`` = best λ per column over ``grid`` (SQL over
    ``k``, may use ``b.lam`` of the previous round ``prev``). Rows are not negative; the
    variance is that of all rows, not of a histogram."""
    src = f"(SELECT col, {grid} AS lam FROM {prev} b, range(0, {points}) r(k))" if prev else \
        f"(SELECT DISTINCT col, {grid} AS lam FROM wz, range(0, {points}) r(k))"
    return f"""
, ll_{name} AS (
    SELECT g.col, g.lam, count(*) AS nn, var_pop({_psi_sql("w.x", "g.lam")}) AS v, sum(ln(1 + w.x)) AS sl
    FROM {src} g JOIN wz w USING (col) GROUP BY g.col, g.lam)
, {name} AS (
    SELECT col, lam FROM (
      SELECT col, lam, row_number() OVER (PARTITION BY col ORDER BY -nn / 2.0 * ln(v) + (lam - 1) * sl DESC, abs(lam)) AS r
      FROM ll_{name} WHERE v > 0) WHERE r = 1)
"""


def yeo_sql(value: str, span: int) -> str:
    """Scaled weekly counts: λ on the quarters of [-span, span], then two finer rounds."""
    return WEEKVEC_SQL + f"""
, wz AS (SELECT c.client_id, CAST(weeks.week AS VARCHAR) AS col, CAST(COALESCE(w.event_count, 0) AS DOUBLE){value} AS x
         FROM (SELECT DISTINCT client_id FROM wk2) c CROSS JOIN weeks
         LEFT JOIN wk2 w ON w.client_id = c.client_id AND w.week = weeks.week)
""" + _yeo_round("", "b1", f"k * 0.25 - {span}", 8 * span + 1) + \
        _yeo_round("b1", "b2", "round(b.lam - 0.25 + k * 0.025, 6)", 21) + \
        _yeo_round("b2", "b3", "round(b.lam - 0.01 + k * 0.001, 6)", 21) + f"""
, yt AS (SELECT wz.client_id, wz.col, {_psi_sql("wz.x", "b3.lam")} AS y FROM wz JOIN b3 USING (col))
, ys AS (SELECT client_id, col,
                round(CASE WHEN max(y) OVER (PARTITION BY col) = min(y) OVER (PARTITION BY col)
                           THEN y - min(y) OVER (PARTITION BY col)
                           ELSE (y - min(y) OVER (PARTITION BY col)) / (max(y) OVER (PARTITION BY col) - min(y) OVER (PARTITION BY col)) END * 2 - 1, 6) AS v
         FROM yt)
SELECT client_id, """ + ", ".join(f"max(v) FILTER (WHERE col = '{w}') AS \"{w}\"" for w in PIVOT_WEEKS) + """
FROM ys GROUP BY client_id
"""


_ORACLES["scale_yeo"] = S(yeo_sql("", 16))
_ORACLES["scale_yeo_wide"] = S(yeo_sql(" / 1000.0", 512))


def _calc_oracle() -> str:
    """Aggregate profile with the visit block replaced by the plug-in's
    ``[events, distinct urls, mean url]``: per client the width and the rounded total."""
    blocks = [t for t in _AGG_TYPES if t in C.PRODUCT_TYPES]
    sql = "".join(tv_sql(t, C.EVENT_TYPE_TO_COLUMNS[t]) + wvc_sql(t, C.EVENT_TYPE_TO_COLUMNS[t])
                  for t in blocks) + QV_SQL + """
, rel_pv AS (SELECT * FROM page_visit WHERE client_id IN (SELECT client_id FROM relevant_clients))
, pv AS (SELECT client_id, CAST(count(*) AS DOUBLE) + CAST(count(DISTINCT url) AS DOUBLE) + avg(url) AS s
         FROM rel_pv GROUP BY client_id)
"""
    cl = " UNION ".join([f"SELECT client_id FROM wv_{t}" for t in blocks] +
                        ["SELECT client_id FROM qv", "SELECT client_id FROM pv"])
    width = " + ".join([f"(SELECT size FROM sz_{t})" for t in blocks] + ["3", "16"])
    sums = " + ".join([f"COALESCE((SELECT sum(value) FROM wv_{t} w WHERE w.client_id = cl.client_id), 0)"
                       for t in blocks] +
                      ["COALESCE((SELECT s FROM pv WHERE pv.client_id = cl.client_id), 0)",
                       "COALESCE((SELECT sum(value) FROM qv WHERE qv.client_id = cl.client_id), 0)"])
    return sql + f", cl AS ({cl})\nSELECT client_id, CAST({width} AS INTEGER) AS width, round({sums}, 6) AS total FROM cl"


_ORACLES["register_calculator"] = S(_calc_oracle())
