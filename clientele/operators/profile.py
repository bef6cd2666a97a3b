"""Aggregate baseline profile.

Per event type: total events and, for each lookback window × column × top value, the number
of the client's events with that value inside the window; searches give the mean query
vector. All of it is grouped aggregation: no loop over clients.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele import config as C
from clientele.functions.vectors import parse_vector_strict
from clientele.operators.joins import merge_event_features


def _unpivoted(columns: list[str]) -> str:
    return f"stack({len(columns)}, " + ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in columns) + ") AS (column_name, value)"


def top_values(events: DataFrame, columns: list[str], top_n: int = C.PROFILE_TOP_N) -> DataFrame:
    """Top-n most frequent values per column (ties by value ascending; null is no value):
    ``column_name, rank, value, count``. Bounded: ``top_n`` rows per column.

    One aggregate counts the values of all columns; each task passes on ``top_n`` rows a
    column at most (the rank filter limits the window's input before its shuffle)."""
    cnt = (events.selectExpr(_unpivoted(columns)).where("value IS NOT NULL")
           .groupBy("column_name", "value").agg(F.count(F.lit(1)).cast("long").alias("count")))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return (cnt.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= top_n)
            .select("column_name", "value", "count", "rank"))


def held_top_values(events: DataFrame, columns: list[str], top_n: int = C.PROFILE_TOP_N) -> tuple[DataFrame, int, object]:
    """:func:`top_values` as a table that is not computed again (``top_n`` rows a column go
    through the driver), its number of rows, and the latest timestamp."""
    tops = top_values(events, columns, top_n)
    rows = tops.collect()
    last = events.agg(F.max("timestamp")).first()[0]
    return events.sparkSession.createDataFrame(rows, tops.schema), len(rows), last


def stats_size(tops: DataFrame | None, n_windows: int) -> int:
    """Vector size: 1 + (sum of top-list sizes) · windows (one small action)."""
    total = 0 if tops is None else tops.count()
    return 1 + total * n_windows


def windowed_value_counts(events: DataFrame, columns: list[str], tops: DataFrame,
                          num_days: list[int] = C.PROFILE_NUM_DAYS,
                          max_date=None, size: int | None = None) -> DataFrame:
    """Per client ``features`` (array<double>): total, then per lookback (``ts >= max -
    days``, lower bound inclusive) × column × top value (rank order) the count.

    Columns are unpivoted and matched to the broadcast top values (bounded: top_n per
    column); one grouped aggregate with one ``count_if`` per lookback gives all counts.
    """
    if max_date is None:
        max_date = events.agg(F.max("timestamp")).first()[0]
    # the cast gives the time of no events (null) its type
    ev = events.withColumn("_max", F.lit(max_date).cast(events.schema["timestamp"].dataType))
    # column offsets inside one window block, from the top-list sizes
    # (windows over the top list itself: at most top_n rows per column, no join)
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    t = (tops.withColumn("_ord", order.cast("long"))
         .withColumn("_coff", F.count(F.lit(1)).over(
             Window.orderBy("_ord").rangeBetween(Window.unboundedPreceding, -1)))
         .withColumn("_block", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
         .select("column_name", "value", "rank", "_coff", "_block"))
    long = ev.selectExpr("client_id", "timestamp", "_max", _unpivoted(columns))
    matched = long.join(F.broadcast(t), ["column_name", "value"])
    since = [F.col("timestamp") >= F.col("_max") - F.make_dt_interval(F.lit(d)) for d in num_days]
    cnt = (matched.groupBy("client_id", "rank", "_coff", "_block")
           .agg(*[F.count_if(s).alias(f"_w{i}") for i, s in enumerate(since)]))
    entries = F.array(*[F.struct((F.lit(1) + F.lit(i) * F.col("_block") + F.col("_coff")
                                  + F.col("rank") - 1).cast("int").alias("pos"),
                                 F.col(f"_w{i}").cast("double").alias("v"))
                        for i in range(len(num_days))])
    per = cnt.select("client_id", F.explode(entries).alias("e")).select("client_id", "e.*")
    totals = events.groupBy("client_id").agg(F.count(F.lit(1)).cast("double").alias("_tot"))
    if size is None:
        size = stats_size(tops, len(num_days))
    dense = (per.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("_m"))
             .join(totals, "client_id", "right")
             .select("client_id", F.transform(
                 F.sequence(F.lit(0), F.lit(size - 1)),
                 lambda i: F.when(i == 0, F.col("_tot"))
                 .otherwise(F.coalesce(F.col("_m")[i], F.lit(0.0)))).alias("features")))
    return dense


def mean_query_vector(searches: DataFrame, query_col: str = "query") -> DataFrame:
    """Element-wise mean of a client's parsed query vectors: ``client_id, features``.

    Long form (client, pos) averages — a partial aggregate per position — then one bounded
    collect per client (vector width).
    """
    parsed = searches.select("client_id", F.posexplode(parse_vector_strict(query_col)).alias("pos", "v"))
    avg = parsed.groupBy("client_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return (avg.groupBy("client_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
            .select("client_id", F.transform("_s", lambda s: s["v"]).alias("features")))


# ---- calculator registry (2.14) -------------------------------------------------------------
# A calculator maps one event type's events to ``client_id, features`` and reports its size.
Calculator = Callable[[DataFrame], tuple[DataFrame, int]]
_CALCULATORS: dict[str, Calculator] = {}


def register_calculator(event_type: str, fn: Calculator) -> None:
    """Plug in a custom calculator for an event type (used by :func:`aggregate_profile`)."""
    _CALCULATORS[event_type] = fn


def unregister_calculator(event_type: str) -> None:
    _CALCULATORS.pop(event_type, None)


def stats_calculator(columns: list[str], num_days: list[int], top_n: int) -> Calculator:
    def calc(events: DataFrame) -> tuple[DataFrame, int]:
        tops, n, last = held_top_values(events, columns, top_n)
        size = 1 + n * len(num_days)
        return windowed_value_counts(events, columns, tops, num_days, last, size), size
    return calc


def query_calculator(width: int) -> Calculator:
    def calc(events: DataFrame) -> tuple[DataFrame, int]:
        return mean_query_vector(events), width
    return calc


def pandas_calculator(fn, schema_width: int) -> Calculator:
    """Wrap a per-client pandas function ``(pdf) -> list[float]`` as a calculator run by
    ``groupBy(client).applyInPandas``. A client's rows meet in one task: for bounded
    histories only; :func:`mergeable_calculator` spreads a client."""
    import pandas as pd

    def per_client(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"client_id": [int(pdf["client_id"].iloc[0])],
                             "features": [[float(x) for x in fn(pdf)]]})

    def calc(events: DataFrame) -> tuple[DataFrame, int]:
        out = events.groupBy("client_id").applyInPandas(
            per_client, "client_id long, features array<double>")
        return out, schema_width
    return calc


def mergeable_states(events: DataFrame, accumulate, merge, bucket_s: int) -> DataFrame:
    """``client_id, bucket, state``: the rows of a client and time bucket that lie in one
    task, folded into one state there. No event is shuffled."""
    import pandas as pd

    def fold(parts):
        for part in parts:
            held: dict = {}
            for key, rows in part.groupby(["client_id", "_bucket"], sort=False):
                state = [float(x) for x in accumulate(rows.drop(columns="_bucket"))]
                held[key] = merge(held[key], state) if key in held else state
            if held:
                yield pd.DataFrame([(*map(int, k), v) for k, v in held.items()], columns=["client_id", "bucket", "state"])

    b = events.withColumn("_bucket", F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / bucket_s))
    return b.mapInPandas(fold, "client_id long, bucket long, state array<double>")


def mergeable_calculator(accumulate, merge, finish, width: int, bucket_s: int = 86400) -> Calculator:
    """A plug-in calculator whose states can be merged, so that a client's events spread.

    ``accumulate(pdf) -> state`` (a list of numbers of any length) takes some of a client's
    events of one time bucket of ``bucket_s`` seconds, ``merge(a, b) -> state`` joins two
    states in any order, ``finish(state) -> features`` ends a client. Events are folded where
    they lie; the states are merged by (client, bucket) first, whose groups hold one state
    of each batch, and by client last, whose groups hold one state of each bucket.
    """
    import pandas as pd

    def merged(keys, last):
        def run(parts):
            key, state = None, None
            out = []

            def close():
                if key is not None:
                    out.append((*key, finish(state) if last else state))

            for part in parts:
                for *k, s in part[[*keys, "state"]].itertuples(index=False):
                    k, s = tuple(map(int, k)), [float(x) for x in s]
                    if k == key:
                        state = merge(state, s)
                    else:
                        close()
                        key, state = k, s
                if out:
                    yield pd.DataFrame(out, columns=[*keys, "features" if last else "state"])
                    out.clear()
            close()
            if out:
                yield pd.DataFrame(out, columns=[*keys, "features" if last else "state"])
        return run

    def calc(events: DataFrame) -> tuple[DataFrame, int]:
        st = mergeable_states(events, accumulate, merge, bucket_s)
        two = ["client_id", "bucket"]
        st = st.repartition(*two).sortWithinPartitions(*two).mapInPandas(
            merged(two, False), "client_id long, bucket long, state array<double>")
        out = st.repartition("client_id").sortWithinPartitions(*two).mapInPandas(
            merged(["client_id"], True), "client_id long, features array<double>")
        return out, width
    return calc


def aggregate_profile(events_of: dict[str, DataFrame], relevant: DataFrame,
                      num_days: list[int] = C.PROFILE_NUM_DAYS, top_n: int = C.PROFILE_TOP_N,
                      query_width: int = 16) -> DataFrame:
    """Per relevant client the concatenated per-type vectors (zeros for a missing type),
    in the fixed type order. ``events_of``: event type → events (with properties)."""
    parts = []
    for t, cols in C.EVENT_TYPE_TO_COLUMNS.items():
        ev = events_of[t].join(relevant.select("client_id"), "client_id", "left_semi")
        if t in _CALCULATORS:
            calc = _CALCULATORS[t]
        elif t == C.SEARCH_QUERY:
            calc = query_calculator(query_width)
        else:
            calc = stats_calculator(cols, num_days, top_n)
        feats, size = calc(ev)
        parts.append((feats, size))
    return merge_event_features(parts)
