"""Embedding table validation: cascades of checks, first failure per group.

All counts come from one aggregate over the embedding table plus one anti join against the
relevant clients; messages are assembled from that single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele import config as C


def embedding_stats(emb: DataFrame, relevant: DataFrame | None) -> dict:
    e = F.col("embedding")
    row = emb.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("client_id").alias("n_distinct"),
        F.count_if(e.isNull()).alias("n_null_emb"),
        F.max(F.size(e)).alias("max_width"),
        F.min(F.size(e)).alias("min_width"),
        F.count_if(F.exists(e, lambda x: F.isnan(x))).alias("n_nan"),
        F.count_if(F.exists(e, lambda x: (F.abs(x) == F.lit(float("inf"))))).alias("n_inf"),
        F.count_if(F.exists(e, lambda x: ~F.isnan(x) & (F.abs(x) > C.FLOAT16_MAX)
                            & (F.abs(x) != F.lit(float("inf"))))).alias("n_out_of_range"),
    ).first().asDict()
    if relevant is not None:
        ids = emb.select("client_id").distinct()
        r = relevant.select("client_id").distinct()
        row["n_relevant"] = r.count()
        row["n_missing"] = r.join(ids, "client_id", "left_anti").count()
    return row


def validate_client_ids(emb: DataFrame, stats: dict, check_relevant: bool = True) -> str | None:
    dtype = emb.schema["client_id"].dataType
    if not isinstance(dtype, T.LongType):
        return C.MSG_IDS_DTYPE.format(dtype=dtype.simpleString())
    if check_relevant and "n_relevant" in stats:
        same_len = stats["n"] == stats["n_relevant"]
        if not (same_len and stats["n_missing"] == 0 and stats["n_distinct"] == stats["n"]):
            return C.MSG_IDS_NOT_PERMUTATION
    return None


def validate_embeddings(emb: DataFrame, stats: dict, max_dim: int = C.MAX_EMBEDDING_DIM) -> str | None:
    et = emb.schema["embedding"].dataType
    if not isinstance(et, T.ArrayType) or not isinstance(et.elementType, (T.FloatType, T.DoubleType)):
        return C.MSG_EMB_DTYPE.format(dtype=et.simpleString())
    if (stats["max_width"] or 0) > max_dim:
        return C.MSG_EMB_DIM.format(limit=max_dim)
    if stats["n_out_of_range"]:
        return C.MSG_EMB_DTYPE.format(dtype="values outside the float16 range")
    if stats["n_nan"]:
        return C.MSG_EMB_NAN
    if stats["n_inf"]:
        return C.MSG_EMB_INF
    return None


def validate_consistency(stats: dict) -> str | None:
    if stats["n_null_emb"] or (stats["min_width"] is not None and stats["min_width"] != stats["max_width"]):
        return C.MSG_LENGTH
    return None


def validation_report(emb: DataFrame, relevant: DataFrame | None = None,
                      max_dim: int = C.MAX_EMBEDDING_DIM) -> DataFrame:
    """Ordered report ``position, check_group, message`` of the failed groups (empty = valid).

    Consistency runs only when the ids and the embeddings both pass, as in the cascade."""
    stats = embedding_stats(emb, relevant)
    ids = validate_client_ids(emb, stats, relevant is not None)
    vec = validate_embeddings(emb, stats, max_dim)
    cons = validate_consistency(stats) if ids is None and vec is None else None
    rows = [(g, m) for g, m in (("client_ids", ids), ("embeddings", vec), ("consistency", cons)) if m]
    spark: SparkSession = emb.sparkSession
    return spark.createDataFrame([(i + 1, g, m) for i, (g, m) in enumerate(rows)],
                                 "position int, check_group string, message string")
