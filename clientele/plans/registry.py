"""Registered queries (one per SURVEY section 2 key) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver tables.
Output conventions shared with the oracle SQL: every column aliased, counts ``bigint``,
doubles rounded to 6 digits, arrays in long form ``(..., pos, value)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def long_form(df: DataFrame, keys: list[str], arr: str, value: str = "value",
              round_values: bool = True) -> DataFrame:
    """Explode an array column into ``keys + [pos, value]`` (pos 0-based)."""
    out = df.select(*keys, F.posexplode(arr).alias("pos", value))
    out = out.withColumn("pos", F.col("pos").cast("int"))
    if round_values:
        out = out.withColumn(value, r6(value))
    return out


# SQL fragment helpers ---------------------------------------------------------------------------

TYPE_ABBR = [("add_to_cart", "add"), ("product_buy", "buy"), ("remove_from_cart", "remove")]


def type_counts_sql(src: str, keys: list[str], pattern: str) -> str:
    cols = ", ".join(
        f"count(*) FILTER (WHERE event_type = '{t}') AS {pattern.format(a)}" for t, a in TYPE_ABBR)
    k = ", ".join(keys)
    return f"SELECT {k}, {cols} FROM {src} GROUP BY {k}"


def names(pattern: str) -> list[str]:
    return [pattern.format(a) for _, a in TYPE_ABBR]


QUERY_MODULES = ["q_basic", "q_features", "q_profile", "q_eval"]


def import_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for m in QUERY_MODULES:
        try:
            importlib.import_module(f"clientele.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"clientele.plans.{m}":
                raise
