"""Projections, filters, predicates and null handling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC_FILL_TYPES = (T.LongType, T.IntegerType, T.DoubleType)


def tag_event_type(df: DataFrame, event_type: str) -> DataFrame:
    return df.withColumn("event_type", F.lit(event_type))


def filter_relevant(df: DataFrame, ids: DataFrame, client_col: str = "client_id") -> DataFrame:
    """Keep rows whose client is in ``ids`` (left semi join; no columns of ``ids`` added)."""
    return df.join(ids.select(F.col("client_id").alias(client_col)), client_col, "left_semi")


def restrict_active(embeddings: DataFrame, active: DataFrame) -> DataFrame:
    return filter_relevant(embeddings, active)


def clients_without_events(relevant: DataFrame, filtered_visits: DataFrame,
                           searches: DataFrame, products: DataFrame,
                           visits: DataFrame) -> DataFrame:
    """Legacy recipe: relevant clients absent from filtered visits, searches and products
    get their (unfiltered) visits appended to the filtered visits."""
    seen = (filtered_visits.select("client_id").unionByName(searches.select("client_id"))
            .unionByName(products.select("client_id")).distinct())
    excluded = relevant.select("client_id").join(seen, "client_id", "left_anti")
    extra = visits.join(excluded, "client_id", "left_semi")
    return filtered_visits.unionByName(extra.select(*filtered_visits.columns))


def flag_top_items(df: DataFrame, top_skus: DataFrame, top_cats: DataFrame) -> DataFrame:
    """``top_sku`` / ``top_category`` as tinyint 0/1 by membership in the (bounded) top lists."""
    ts = F.broadcast(top_skus.select("sku").distinct().withColumn("_in_s", F.lit(1)))
    tc = F.broadcast(top_cats.select("category").distinct().withColumn("_in_c", F.lit(1)))
    return (df.join(ts, "sku", "left").join(tc, "category", "left")
            .withColumn("top_sku", F.col("_in_s").isNotNull().cast("tinyint"))
            .withColumn("top_category", F.col("_in_c").isNotNull().cast("tinyint"))
            .drop("_in_s", "_in_c"))


def fill_numeric_nulls(df: DataFrame, columns: list[str] | None = None, fill_value=0) -> DataFrame:
    """null → 0 on long/int/double columns (ids included) or on ``columns``.

    As in the reference, ``fill_value`` is accepted but 0 is always used.
    """
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, _NUMERIC_FILL_TYPES)]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                           for c in cols})


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def fill_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or float_columns(df)
    return df.withColumns({c: F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)) for c in cols})


def nan_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count of NaN per float column, long form ``column_name, nan_count``."""
    cols = columns or float_columns(df)
    wide = df.agg(*[F.count_if(F.isnan(c)).cast("long").alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, nan_count)")


def clip_unit(df: DataFrame, columns: list[str]) -> DataFrame:
    """null → 0, > 1 → 1, otherwise unchanged (no lower clip)."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.lit(0)).when(F.col(c) > 1, F.lit(1))
                           .otherwise(F.col(c)) for c in columns})


def price_norm(df: DataFrame, properties: DataFrame) -> DataFrame:
    """``price = (price + 1) / 100`` after a left join on sku."""
    p = properties.select("sku", "price")
    return (df.drop("price").join(p, "sku", "left")
            .withColumn("price", (F.col("price") + 1) / 100.0))


# ---- time split -----------------------------------------------------------------------------

def split_dates(buys: DataFrame, days_in_target: int) -> DataFrame:
    """One row: ``train_start, val_start, end_ts``.

    ``train_start = end − (2·days − 1)`` days truncated to midnight; ``val_start =
    train_start + days``; ``end`` = last buy.
    """
    end = F.max("timestamp")
    start = F.date_trunc("day", end - F.make_dt_interval(F.lit(2 * days_in_target - 1)))
    return buys.agg(start.cast("timestamp_ntz").alias("train_start"),
                    (start.cast("timestamp_ntz") + F.make_dt_interval(F.lit(days_in_target))).alias("val_start"),
                    end.alias("end_ts"))


def collect_split_dates(buys: DataFrame, days_in_target: int) -> tuple[dt.datetime, dt.datetime, dt.datetime]:
    """The split dates as literals (one-row action) so later filters reach the parquet scans."""
    r = split_dates(buys, days_in_target).first()
    return r["train_start"], r["val_start"], r["end_ts"]


def split_input(df: DataFrame, train_start) -> DataFrame:
    return df.where(F.col("timestamp") < F.lit(train_start))


def split_targets(buys: DataFrame, properties: DataFrame, train_start, val_start, end_ts,
                  check: bool = True) -> tuple[DataFrame, DataFrame]:
    from clientele.operators.joins import join_properties_checked
    tr = buys.where((F.col("timestamp") >= F.lit(train_start)) & (F.col("timestamp") < F.lit(val_start)))
    va = buys.where((F.col("timestamp") >= F.lit(val_start)) & (F.col("timestamp") <= F.lit(end_ts)))
    if check:
        return join_properties_checked(tr, properties), join_properties_checked(va, properties)
    p = properties
    return tr.join(p, "sku", "left"), va.join(p, "sku", "left")


def last_month_only(df: DataFrame, cutoff) -> DataFrame:
    """Keep rows at or after ``cutoff`` (features must be computed before this filter)."""
    return df.where(F.col("timestamp") >= F.lit(cutoff))
