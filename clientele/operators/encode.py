"""Temporal features, event encoders, client sequences, padding and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.scalars import event_type_onehot, iso_weekday, time_decay, whole_days_between
from clientele.operators.sessions import client_time_scan


def temporal_features(events: DataFrame, end=None) -> DataFrame:
    """hour, weekday (Mon=1..Sun=7), day, month and their [-1, 1] forms; ``weeks_diff`` =
    whole days to the last event / 7 (also as ``weeks_since_test_start``).

    The last event time is fitted once (one-row aggregate) and applied as a literal."""
    if end is None:
        end = events.agg(F.max("timestamp")).first()[0]
    ev = events.withColumn("_end", F.lit(end))
    ts = F.col("timestamp")
    weeks = whole_days_between(ts, F.col("_end")) / 7.0
    return (ev.withColumns({
        "hour": F.hour(ts), "weekday": iso_weekday(ts), "day": F.dayofmonth(ts),
        "month": F.month(ts)})
        .withColumns({
            "hour_norm": F.col("hour") / 23.0 * 2 - 1,
            "weekday_norm": F.col("weekday") / 6.0 * 2 - 1,
            "week_of_month_norm": F.col("day").cast("double") / 31.0 * 2 - 1,
            "weeks_diff": weeks, "weeks_since_test_start": weeks})
        .drop("_end"))


def temporal_features_unit(events: DataFrame, test_start) -> DataFrame:
    """Older form scaled to [0, 1] with a fixed end date."""
    ts = F.col("timestamp")
    weeks = whole_days_between(ts, F.lit(test_start)) / 7.0
    return (events.withColumns({
        "hour": F.hour(ts), "weekday": iso_weekday(ts), "day": F.dayofmonth(ts),
        "month": F.month(ts)})
        .withColumns({
            "hour_norm": F.col("hour") / 23.0, "weekday_norm": F.col("weekday") / 6.0,
            "week_of_month_norm": F.col("day").cast("double") / 31.0,
            "weeks_diff": weeks, "weeks_since_test_start": weeks}))


def _scalars(cols: list[str]):
    return F.array(*[F.col(c).cast("double") for c in cols])


def encode_product(df: DataFrame, norm: str = "norm") -> F.Column:
    """35 scalars + name vector."""
    return F.concat(_scalars(C.PRODUCT_SCALARS), F.col(norm).cast("array<double>"))


def encode_search(df: DataFrame, norm: str = "norm") -> F.Column:
    """13 scalars + query vector."""
    return F.concat(_scalars(C.SEARCH_SCALARS), F.col(norm).cast("array<double>"))


def encode_visit(df: DataFrame, weekly_cols: list[str]) -> F.Column:
    """8 scalars + weekly activity columns."""
    return _scalars(C.VISIT_SCALARS + weekly_cols)


def encode_event(df: DataFrame, weekly_cols: list[str], alpha: float = C.DECAY_ALPHA,
                 width: int = C.ENCODED_WIDTH, norm: str = "norm") -> DataFrame:
    """Add ``encoded``: one-hot(5) + time(3, null → 0) + payload by type, right-padded with
    -1 to ``width``, all multiplied by ``exp(-alpha · weeks_since_test_start)``."""
    t = F.col("event_type")
    cols = set(df.columns)

    def payload_or_empty(expr_fn, needed):
        if all(c in cols for c in needed):
            return expr_fn()
        return F.array().cast("array<double>")

    visit = payload_or_empty(lambda: encode_visit(df, weekly_cols), C.VISIT_SCALARS + weekly_cols)
    search = payload_or_empty(lambda: encode_search(df, norm), C.SEARCH_SCALARS + [norm])
    product = payload_or_empty(lambda: encode_product(df, norm), C.PRODUCT_SCALARS + [norm])
    payload = (F.when(t == C.PAGE_VISIT, visit).when(t == C.SEARCH_QUERY, search)
               .otherwise(product))
    time = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in C.TIME_FIELDS])
    full = F.concat(event_type_onehot(t).cast("array<double>"), time, payload)
    padded = F.concat(full, F.array_repeat(F.lit(C.PAD_VALUE),
                                           F.greatest(F.lit(width) - F.size(full), F.lit(0))))
    w = time_decay(F.coalesce(F.col("weeks_since_test_start").cast("double"), F.lit(0.0)), alpha)
    return df.withColumn("encoded", F.transform(padded, lambda x: x * w))


def client_sequences(events: DataFrame, as_array: bool = False,
                     bucket_s: int = 3600, heavy_rows: int | None = None) -> DataFrame:
    """Events per client in time order.

    Default: long form ``client_id, pos`` (0-based, time order) + the event columns — a
    heavy client stays spread over tasks (positions come from the two-level scan). With
    ``as_array=True`` one ``events`` list<struct> per client is built by
    ``array_sort(collect_list)`` — only for bounded client histories.
    """
    from clientele.operators.sessions import HEAVY_CLIENT_ROWS
    scanned = client_time_scan(events, bucket_s=bucket_s,
                               heavy_rows=HEAVY_CLIENT_ROWS if heavy_rows is None else heavy_rows)
    long = (scanned.withColumn("pos", (F.col("_rn") - 1).cast("int"))
            .drop("_rn", "_b", "prev_ts"))
    if not as_array:
        return long
    ev_cols = [c for c in long.columns if c not in ("client_id", "pos")]
    return (long.groupBy("client_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", *ev_cols))).alias("events")))


def pad_sequences(seq: DataFrame, vec_col: str, length: int | None = None,
                  pad_value: float = C.PAD_VALUE) -> DataFrame:
    """Long form (``client_id, pos, vec_col``) → every client gets steps ``0..L-1``; missing
    steps are rows of ``pad_value`` of the vector width. ``L`` = longest sequence unless
    given (a one-row aggregate). A client longer than ``L`` keeps all its steps: padding
    only adds rows, it never truncates a sequence.

    The steps are joined by a merge: Spark takes them for as small as the table of clients
    they are exploded from, and would send all of them through the driver."""
    r = seq.agg(F.max(F.size(vec_col)).alias("_w"), (F.max("pos") + 1).alias("_L")).first()
    width, n_steps = int(r["_w"] or 0), int(length if length is not None else (r["_L"] or 0))
    per_client = seq.groupBy("client_id").agg((F.max("pos") + 1).alias("_n"))
    steps = per_client.select(
        "client_id", F.lit(width).alias("_w"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(n_steps), F.col("_n")) - 1)).alias("pos"))
    j = steps.join(seq.select("client_id", "pos", vec_col).hint("merge"), ["client_id", "pos"], "left")
    return j.select("client_id", "pos", F.coalesce(
        F.col(vec_col).cast("array<double>"),
        F.array_repeat(F.lit(pad_value).cast("double"), F.col("_w"))).alias(vec_col))


def sequence_length(padded: DataFrame, vec_col: str, pad_value: float = C.PAD_VALUE) -> DataFrame:
    """Steps with any element different from the pad value, per client."""
    valid = F.exists(vec_col, lambda x: x != F.lit(pad_value))
    return padded.groupBy("client_id").agg(F.count_if(valid).cast("long").alias("length"))


def masked_mean_pool(padded: DataFrame, vec_col: str, pad_value: float = C.PAD_VALUE) -> DataFrame:
    """Mean over valid steps only, per client and vector position (long form
    ``client_id, pos, value``): partial aggregates, no per-client collect."""
    valid = padded.where(F.exists(vec_col, lambda x: x != F.lit(pad_value)))
    e = valid.select("client_id", F.posexplode(vec_col).alias("dim", "v"))
    return (e.groupBy("client_id", "dim").agg(F.avg("v").alias("value"))
            .withColumnRenamed("dim", "pos"))
