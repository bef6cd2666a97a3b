"""Derived inputs shared by the registered queries (same definitions as the SQL prelude)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.operators import project as P
from clientele.operators import windows as W
from clientele.plans import oracle as O
from clientele.sources.fixtures import Tables


class Ctx(Tables):
    """Logical tables plus split dates, targets and id lists for the driver queries."""

    @property
    def products(self) -> DataFrame:
        """The three product kinds tagged with their type, from one scan of the stream
        (equal to ``union_products`` of the three logical tables)."""
        from clientele.sources.fixtures import EVENT_KIND_OF
        kinds = {EVENT_KIND_OF[t]: t for t in ("product_buy", "add_to_cart", "remove_from_cart")}
        et = F.lit(None).cast("string")
        for k, t in kinds.items():
            et = F.when(F.col("_kind") == k, F.lit(t)).otherwise(et)
        return (self._events.where(F.col("_kind").isin(*kinds))
                .select("client_id", "timestamp", F.col("_k").alias("sku"), et.alias("event_type")))

    @cached_property
    def split(self):
        """``(train_start, val_start, end_ts)`` as literals (one tiny action)."""
        return P.collect_split_dates(self.product_buy, O.DAYS_IN_TARGET)

    @property
    def input_buys(self) -> DataFrame:
        return P.split_input(self.product_buy, self.split[0])

    @property
    def active_clients(self) -> DataFrame:
        return self.input_buys.select("client_id").distinct()

    def targets(self) -> tuple[DataFrame, DataFrame]:
        tr, va, end = self.split
        return P.split_targets(self.product_buy, self.product_properties, tr, va, end, check=False)

    @property
    def propensity_sku(self) -> DataFrame:
        t = W.top_items(self.input_buys, "sku", O.PROP_SKU_N)
        return t.select(F.col("sku").alias("item"), F.col("rank").alias("pos"))

    @property
    def propensity_category(self) -> DataFrame:
        b = self.input_buys.join(self.product_properties.select("sku", "category"), "sku")
        t = W.top_items(b, "category", O.PROP_CAT_N)
        return t.select(F.col("category").alias("item"), F.col("rank").alias("pos"))
