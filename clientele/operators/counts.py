"""Grouped counts, conversion rates and per-key statistics.

Every per-type count is one ``count_if`` inside a single aggregate, so the three event
types of a key are counted in one pass with map-side partial aggregation; a hot key is
pre-aggregated before the shuffle and never reaches one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import conversion_ratio

_ABBR = {C.ADD_TO_CART: "add", C.PRODUCT_BUY: "buy", C.REMOVE_FROM_CART: "remove"}
_ORDER = [C.ADD_TO_CART, C.PRODUCT_BUY, C.REMOVE_FROM_CART]


def type_counts(events: DataFrame, keys: list[str], name_of: dict[str, str],
                type_col: str = "event_type") -> DataFrame:
    """One row per key with one count column per event type (zero when absent)."""
    aggs = [F.count_if(F.col(type_col) == t).cast("long").alias(n) for t, n in name_of.items()]
    return events.groupBy(*keys).agg(*aggs)


def _names(pattern: str) -> dict[str, str]:
    return {t: pattern.format(_ABBR[t]) for t in _ORDER}


def sku_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["sku"], _names("count_{}"))


def sku_client_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["sku", "client_id"], _names("count_user_{}"))


def client_totals(events: DataFrame) -> DataFrame:
    return type_counts(events, ["client_id"], _names("tot_user_{}"))


def category_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["category"], _names("count_cat_{}"))


def category_client_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["category", "client_id"], _names("count_cat_user_{}"))


def cluster_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["cluster_id"], _names("cluster_{}_count"))


def cluster_client_counts(events: DataFrame) -> DataFrame:
    return type_counts(events, ["client_id", "cluster_id"], _names("cluster_{}_user_count"))


def conversion_rates(df: DataFrame) -> DataFrame:
    """Buy/add ratios; x/0 → 1.0, 0/0 → 0.0 (after null fill the inputs are counts)."""
    return df.withColumns({
        "global_cat_cr": conversion_ratio("count_cat_buy", "count_cat_add"),
        "local_cat_cr": conversion_ratio("count_cat_user_buy", "count_cat_user_add"),
        "global_cr": conversion_ratio("count_buy", "count_add"),
        "local_cr": conversion_ratio("tot_user_buy", "tot_user_add"),
        "cr": conversion_ratio("count_user_buy", "count_user_add"),
    })


def key_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows per key as ``bigint``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias(name))


def url_counts(visits: DataFrame) -> DataFrame:
    return key_count(visits, ["url"], "count")


def client_visit_totals(visits: DataFrame) -> DataFrame:
    return key_count(visits, ["client_id"], "client_total_visits")


def client_url_visits(visits: DataFrame) -> DataFrame:
    return key_count(visits, ["client_id", "url"], "client_url_visits")


def query_score(searches: DataFrame) -> DataFrame:
    return key_count(searches, ["query_id"], "query_score")


def query_user_score(searches: DataFrame) -> DataFrame:
    return key_count(searches, ["client_id", "query_id"], "query_user_score")


def queries_by_user(searches: DataFrame) -> DataFrame:
    return key_count(searches, ["client_id"], "queries_made_by_user")


def cluster_by_user(searches: DataFrame) -> DataFrame:
    return key_count(searches, ["cluster_id", "client_id"], "cluster_made_by_user")


def cluster_score(searches: DataFrame) -> DataFrame:
    return key_count(searches, ["cluster_id"], "cluster_score")


def item_popularity(buys: DataFrame, item_col: str = "sku") -> DataFrame:
    """Purchase count per item: ``item, popularity``."""
    return (buys.groupBy(F.col(item_col).alias("item"))
            .agg(F.count(F.lit(1)).cast("long").alias("popularity")))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact n_unique per column and its log2 (the entropy ceiling): long form."""
    aggs = []
    for c in cols:
        aggs.append(F.count_distinct(F.col(c)).alias(c))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, n_unique)")
            .withColumn("n_unique", F.col("n_unique").cast("long"))
            .withColumn("log2_n_unique", F.log2(F.col("n_unique").cast("double"))))


def positives_per_client(buys: DataFrame, item_col: str = "sku") -> DataFrame:
    """Set of items bought per client, in long form ``client_id, item`` (one row per member).

    Long form keeps a client with a huge basket spread over tasks; ``collect_set`` would
    build the whole set in one task.
    """
    return buys.select("client_id", F.col(item_col).alias("item")).distinct()


def weekly_counts(events: DataFrame, ts_col: str = "timestamp", with_year: bool = False) -> DataFrame:
    """Events per (client, ISO week)."""
    week = F.weekofyear(ts_col)
    if with_year:
        week = F.year(F.date_sub(F.next_day(F.col(ts_col).cast("date"), "Sun"), 3)) * 100 + week
    return (events.groupBy("client_id", week.alias("week"))
            .agg(F.count(F.lit(1)).cast("long").alias("event_count")))
