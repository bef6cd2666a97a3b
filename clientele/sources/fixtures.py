"""Logical input tables built from the driver's generic tables (FIXTURES.md section 2).

Every logical table is a lazy DataFrame over the parquet files, so filters and column
pruning reach the scans. The DuckDB oracle builds the same tables in SQL
(``clientele.plans.oracle.PRELUDE``).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stand-in mapping (FIXTURES.md section 2).
EVENT_KIND_OF = {
    "product_buy": "purchase",
    "add_to_cart": "click",
    "remove_from_cart": "error",
    "page_visit": "view",
    "search_query": "signup",
}
VECTOR_WIDTH = 16
SOURCE_WIDTH = 64
QUERY_VEC_OFFSET = 100
ITEM_VEC_OFFSET = 100
RELEVANT_DAYS = 2
FACTOR_DAYS = 3
FACTOR_PRICE = 45


def folded(arr: Column, width: int = VECTOR_WIDTH) -> Column:
    """The whole vector folded to ``width`` doubles: means of consecutive groups."""
    group = SOURCE_WIDTH // width
    parts = lambda i: [F.element_at(arr, i * group + j + 1).cast("double") for j in range(group)]
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: sum(parts(i)[1:], parts(i)[0]) / float(group))


def vector_text(arr: Column) -> Column:
    """The folded vector in [-1, 1] as a quantized vector string ``[a b c]``."""
    q = F.transform(folded(arr), lambda x: F.floor((x + F.lit(1.0)) * F.lit(127.5)).cast("int"))
    return F.concat(F.lit("["), F.array_join(q, " "), F.lit("]"))


@dataclass
class Tables:
    """Driver tables of one scale factor, mapped to the reference's logical inputs."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    # ---- raw event stream ---------------------------------------------------------------
    @cached_property
    def _events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("client_id"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("_kind"),
            F.get_json_object("props", "$.k").cast("long").alias("_k"),
        )

    def _kind(self, logical: str) -> DataFrame:
        return self._events.where(F.col("_kind") == EVENT_KIND_OF[logical])

    @cached_property
    def vector_texts(self) -> DataFrame:
        """``vec_id, vtext, label`` (quantized text of the folded vector)."""
        return self.raw("embeddings").select(
            "vec_id", vector_text(F.col("embedding")).alias("vtext"), "label")

    @cached_property
    def _n_vectors(self) -> int:
        """Number of vectors; items beyond it use the vectors again (from file metadata)."""
        return max(1, self.raw("embeddings").count())

    # ---- logical event tables -----------------------------------------------------------
    @property
    def product_buy(self) -> DataFrame:
        return self._kind("product_buy").select("client_id", "timestamp", F.col("_k").alias("sku"))

    @property
    def add_to_cart(self) -> DataFrame:
        return self._kind("add_to_cart").select("client_id", "timestamp", F.col("_k").alias("sku"))

    @property
    def remove_from_cart(self) -> DataFrame:
        return self._kind("remove_from_cart").select("client_id", "timestamp",
                                                     F.col("_k").alias("sku"))

    @property
    def page_visit(self) -> DataFrame:
        return self._kind("page_visit").select("client_id", "timestamp", F.col("_k").alias("url"))

    @property
    def search_query(self) -> DataFrame:
        v = self.vector_texts.select(F.col("vec_id").alias("_vid"), F.col("vtext").alias("query"))
        s = self._kind("search_query").select(
            "client_id", "timestamp", (F.col("_k") + QUERY_VEC_OFFSET).alias("_vid"))
        return s.join(v, "_vid", "left").select("client_id", "timestamp", "query")

    def event_table(self, logical: str) -> DataFrame:
        return getattr(self, logical)

    # ---- dimension and id lists -----------------------------------------------------------
    @property
    def product_properties(self) -> DataFrame:
        v = self.vector_texts.select(F.col("vec_id").alias("_vid"), F.col("vtext").alias("name"))
        p = self.raw("part").select(
            F.col("p_partkey").alias("sku"),
            F.pmod("p_partkey", F.lit(self._n_vectors)).alias("_vid"),
            F.regexp_extract("p_brand", r"[0-9]+", 0).cast("long").alias("category"),
            F.col("p_size").cast("long").alias("price"),
        )
        return p.join(v, "_vid", "left").select("sku", "category", "price", "name")

    @property
    def relevant_clients(self) -> DataFrame:
        """Clients with a page visit in the last two days."""
        since = self._period[1] - timedelta(days=RELEVANT_DAYS)
        return self._kind("page_visit").where(F.col("timestamp") >= F.lit(since)).select("client_id").distinct()

    @cached_property
    def _period(self) -> tuple:
        """First and last time of the event stream (one aggregate)."""
        return tuple(self._events.agg(F.min("timestamp"), F.max("timestamp")).first())

    def _vector_of(self, keys: DataFrame, key: str, offset: int, name: str = "factors") -> DataFrame:
        """``key`` and the folded vector ``(key + offset) mod number of vectors``."""
        vec = self.raw("embeddings").select(F.col("vec_id").alias("_vid"), folded(F.col("embedding")).alias(name))
        return keys.withColumn("_vid", F.pmod(F.col(key) + offset, F.lit(self._n_vectors))).join(vec, "_vid").select(key, name)

    @property
    def name_clusters(self) -> DataFrame:
        """Fixed name clusters: ``sku, cluster_id`` from ``embeddings.label``."""
        return self.raw("embeddings").select(F.col("vec_id").alias("sku"), F.col("label").cast("long").alias("cluster_id"))

    @property
    def query_cluster_of_text(self) -> DataFrame:
        """Fixed query clusters keyed by query text: ``query, cluster_id``.

        The same text can come from two vectors; the smallest label wins so the map is a
        function of the text.
        """
        return (self.vector_texts
                .groupBy(F.col("vtext").alias("query"))
                .agg(F.min("label").cast("long").alias("cluster_id")))

    @property
    def client_factors(self) -> DataFrame:
        """Fixed client factors: ``client_id, factors`` (16 doubles) of the clients with a
        purchase in the first three days."""
        until = self._period[0] + timedelta(days=FACTOR_DAYS)
        clients = self._kind("product_buy").where(F.col("timestamp") < F.lit(until)).select("client_id").distinct()
        return self._vector_of(clients, "client_id", 0)

    @property
    def item_factors(self) -> DataFrame:
        """Fixed item factors: ``item, factors`` of the catalog's items up to a price bucket."""
        items = self.raw("part").where(F.col("p_size") <= FACTOR_PRICE).select(F.col("p_partkey").alias("item"))
        return self._vector_of(items, "item", ITEM_VEC_OFFSET)

    @property
    def category_factors(self) -> DataFrame:
        """Category factors: the means of the factors of a category's items."""
        from clientele.operators.ml import aggregate_factors
        members = self.product_properties.select(F.col("sku").alias("item"), "category")
        return aggregate_factors(self.item_factors, members, "category")

    # ---- large interactions for the bench ----------------------------------------------------
    @property
    def line_interactions(self) -> DataFrame:
        """``client_id, timestamp, sku, event_type`` from line items joined to orders."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        kind = (F.when(F.col("l_returnflag") == "N", "product_buy")
                .when(F.col("l_returnflag") == "A", "add_to_cart")
                .when(F.col("l_returnflag") == "R", "remove_from_cart"))
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select(F.col("o_custkey").alias("client_id"),
                        F.col("l_shipdate").alias("timestamp"),
                        F.col("l_partkey").alias("sku"),
                        kind.alias("event_type"))
                .where(F.col("event_type").isNotNull()))
