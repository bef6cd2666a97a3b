"""User-level compositions: each is one lazy DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C
from clientele.operators import counts as K
from clientele.operators import entropy as E
from clientele.operators import joins as J
from clientele.operators import product_stats as PS
from clientele.operators import project as P
from clientele.operators import sessions as S
from clientele.operators import windows as W

PRODUCT_ENTROPY_SPECS = [
    ("sku", "sku_entropy", False), ("cluster_id", "cluster_entropy", False),
    ("category", "cat_entropy", False), ("sku", "user_sku_entropy", True),
    ("cluster_id", "user_cluster_entropy", True), ("category", "user_cat_entropy", True),
]
VISIT_ENTROPY_SPECS = [("url", "url_entropy", False), ("url", "client_entropy", True)]
SEARCH_ENTROPY_SPECS = [
    ("query_id", "query_entropy", False), ("cluster_id", "cluster_entropy", False),
    ("query_id", "user_query_entropy", True), ("cluster_id", "user_cluster_entropy", True),
]


def product_events_pipeline(buy: DataFrame, add: DataFrame, remove: DataFrame,
                            properties: DataFrame, name_clusters: DataFrame,
                            complete_buys: DataFrame | None = None,
                            top_k: int = C.TOP_ITEMS) -> DataFrame:
    """union → category → counts → rates → top flags → clusters → entropies → price."""
    ev = W.union_products(buy, add, remove)
    ev = J.join_category(ev, properties)
    src = complete_buys if complete_buys is not None else buy
    ev = P.flag_top_items(ev, W.top_skus(src, top_k), W.top_categories(src, properties, top_k))
    ev = J.attach_cluster(ev, name_clusters, "sku")
    # counts, cluster counts and entropies from one aggregation, one join back
    ev = PS.attach_statistics(ev, with_clusters=True, entropy_specs=PRODUCT_ENTROPY_SPECS)
    ev = P.fill_numeric_nulls(ev)
    ev = K.conversion_rates(ev)
    return P.price_norm(ev, properties)


def visit_sessions_pipeline(visits: DataFrame, relevant: DataFrame, products: DataFrame,
                            top_skus: DataFrame, top_cats: DataFrame,
                            threshold_s: int = C.SESSION_THRESHOLD_S,
                            tolerance_s: int = C.ASOF_TOLERANCE_S) -> DataFrame:
    """relevant filter → sessionize → nearby products → counts → entropies."""
    from clientele.session import materialize
    filtered = P.filter_relevant(visits, relevant)
    sess = materialize(S.collapse(filtered, "url", threshold_s))
    sess = S.nearby_products(sess, "url", products, top_skus, top_cats, tolerance_s)
    sess = J.attach_visit_counts(sess, visits)
    sess = E.attach_entropies(sess, VISIT_ENTROPY_SPECS)
    return (sess.withColumnRenamed("session_start", "timestamp")
            .drop("session", "session_end", "session_end_ext"))


def search_sessions_pipeline(searches: DataFrame, products: DataFrame, query_clusters: DataFrame,
                             top_skus: DataFrame, top_cats: DataFrame,
                             threshold_s: int = C.SESSION_THRESHOLD_S,
                             tolerance_s: int = C.ASOF_TOLERANCE_S,
                             queries: DataFrame | None = None) -> DataFrame:
    """query ids → clusters → scores → sessionize → nearby → entropies.

    ``query_clusters``: ``query_id, cluster_id`` (from :func:`cluster_queries` or a fixture).
    """
    q = queries if queries is not None else W.distinct_queries(searches)
    sq = searches.join(q, "query", "left").drop("query")
    clusters = query_clusters.select("query_id", "cluster_id")
    sq_c = sq.join(clusters, "query_id", "left")
    from clientele.session import materialize
    sess = materialize(S.collapse(sq, "query_id", threshold_s))
    sess = S.nearby_products(sess, "query_id", products, top_skus, top_cats, tolerance_s)
    sess = sess.join(clusters, "query_id", "left")
    sess = J.attach_query_scores(sess, sq_c)
    sess = E.attach_entropies(sess, SEARCH_ENTROPY_SPECS)
    return (sess.withColumnRenamed("session_start", "timestamp")
            .drop("session", "session_end", "session_end_ext"))


def grouped_pipeline(products: DataFrame, visits: DataFrame, searches: DataFrame,
                     names_norm: DataFrame | None = None, query_norm: DataFrame | None = None,
                     normalizer: str = "yeo", weekly_transform: str | None = "yeo") -> DataFrame:
    """scale three kinds → union → temporal → weekly columns → encoded sequences.

    Returns the long-form sequence table ``client_id, pos, ...event columns..., encoded``
    (one row per event, positions in time order); see ``sink_sequences`` for the write.
    """
    from clientele.operators import encode as EN
    from clientele.operators import scale as SC
    from clientele.sources.readers import sink_features
    # cut lineage: each kind is written once to the shared scratch folder, then fitted
    # statistics and the union read the written tables
    products, visits, searches = (sink_features(products, "product_events"),
                                  sink_features(visits, "visit_events"),
                                  sink_features(searches, "search_events"))
    p = SC.scale_groups(products, "product", normalizer)
    if names_norm is not None:
        p = p.join(names_norm.select("sku", "norm"), "sku", "left")
    v = SC.scale_groups(visits, "visit", normalizer).withColumn("event_type", F.lit(C.PAGE_VISIT))
    s = SC.scale_groups(searches, "query", normalizer).withColumn("event_type", F.lit(C.SEARCH_QUERY))
    if query_norm is not None:
        s = s.join(query_norm.select("query_id", "norm"), "query_id", "left")
    allev = EN.temporal_features(W.union_all_events(p, v, s))
    wk = W.weekly_pivot(K.weekly_counts(allev.select("client_id", "timestamp")))
    week_cols = [c for c in wk.columns if c != "client_id"]
    if weekly_transform:
        wk = SC.scale_columns(wk, week_cols, weekly_transform)
    allev = allev.join(wk, "client_id", "left")
    enc = EN.encode_event(allev, week_cols)
    return EN.client_sequences(enc)
