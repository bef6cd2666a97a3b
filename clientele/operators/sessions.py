"""Gaps, length-capped sessions, the as-of session match and nearby-product counts (2.5, 2.3).

Sessions cap the *length* of a session, not the gap: gaps (whole seconds) are added to a
running total and a new session starts when total + gap would exceed the threshold, the
total restarting at 0. A gap above the threshold therefore always starts a session, so we
first cut "islands" at such gaps with built-in windows. An island whose summed gaps stay
within the threshold is one session and needs nothing else. Only longer islands run the
greedy split, streamed in time order through ``applyInPandas`` with O(1) state, one group
per island (not per client): a heavy client's islands spread over tasks.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele import config as C
from clientele.functions.scalars import add_seconds, whole_seconds_between


DEFAULT_BUCKET_S = 3600
# stands for a null client while sessions are built; no client has this id
NULL_CLIENT = -(2**63)
# clients with more rows than this are split into time buckets; lighter clients keep one
# bucket, so their window partition is bounded by this many rows
HEAVY_CLIENT_ROWS = 200_000
# islands with more rows than this use the parallel pointer-doubling split
HUGE_ISLAND_ROWS = 5_000_000


def time_bucket(ts, bucket_s: int = DEFAULT_BUCKET_S):
    """Fixed-width time bucket number of a timestamp."""
    from clientele.functions.scalars import micros_since_epoch
    return F.floor(micros_since_epoch(ts) / F.lit(bucket_s * 1_000_000)).cast("long")


def with_client_buckets(df: DataFrame, client_col: str, ts_col: str,
                        bucket_s: int = DEFAULT_BUCKET_S,
                        heavy_rows: int = HEAVY_CLIENT_ROWS) -> DataFrame:
    """Add ``_b``: 0 for clients with at most ``heavy_rows`` rows, the time bucket for
    heavier ones. Monotone in time within every client, so the two-level scans stay exact;
    a light client is one bounded window partition, a heavy one is split by time. The set
    of heavy clients is at most ``rows / heavy_rows`` long (joined, AQE decides broadcast).
    """
    heavy = (df.groupBy(client_col).agg(F.count(F.lit(1)).alias("_cnt"))
             .where(F.col("_cnt") > heavy_rows).select(client_col, F.lit(True).alias("_heavy")))
    heavy = heavy.withColumnRenamed(client_col, "_hc")
    return (df.join(heavy, F.col(client_col).eqNullSafe(F.col("_hc")), "left").drop("_hc")
            .withColumn("_b", F.when(F.col("_heavy"), time_bucket(ts_col, bucket_s))
                        .otherwise(F.lit(0).cast("long")))
            .drop("_heavy"))


def _join_stats(df: DataFrame, stats: DataFrame, client_col: str, how: str = "inner") -> DataFrame:
    """Join one row per (client, bucket); a null client is a client like any other."""
    stats = stats.withColumnRenamed(client_col, "_sc").withColumnRenamed("_b", "_sbk")
    return df.join(stats, F.col(client_col).eqNullSafe(F.col("_sc")) & (F.col("_b") == F.col("_sbk")), how).drop("_sc", "_sbk")


def client_time_scan(df: DataFrame, client_col: str = "client_id", ts_col: str = "timestamp",
                     bucket_s: int = DEFAULT_BUCKET_S,
                     heavy_rows: int = HEAVY_CLIENT_ROWS) -> DataFrame:
    """Add ``_b`` (time bucket), ``_rn`` (1-based position in the client's time order) and
    ``prev_ts`` (the client's previous event time).

    Two-level scan instead of one window per client: windows run per (client, bucket), and
    a small table with one row per (client, bucket) carries the count and last time of
    the earlier buckets. A client holding a third of all rows is spread over its buckets.
    Events at the same time are ordered by a hash of the whole row, so every window and
    every run sees one and the same order.
    """
    b = with_client_buckets(df, client_col, ts_col, bucket_s, heavy_rows)
    b = b.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    w = Window.partitionBy(client_col, "_b").orderBy(ts_col, "_tie")
    b = (b.withColumn("_rnb", F.row_number().over(w))
         .withColumn("_prevb", F.lag(ts_col).over(w)))
    ws = Window.partitionBy(client_col).orderBy("_b")
    stats = (b.groupBy(client_col, "_b")
             .agg(F.count(F.lit(1)).alias("_nb"), F.max(ts_col).alias("_maxb"))
             .withColumn("_off", F.coalesce(
                 F.sum("_nb").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_prevmax", F.lag("_maxb").over(ws))
             .select(client_col, "_b", "_off", "_prevmax"))
    return (_join_stats(b, stats, client_col)
            .withColumn("_rn", (F.col("_off") + F.col("_rnb")).cast("long"))
            .withColumn("prev_ts", F.coalesce("_prevb", "_prevmax"))
            .drop("_rnb", "_prevb", "_off", "_prevmax", "_tie"))


def bucketed_running(df: DataFrame, value: str, name: str, client_col: str,
                     ts_col: str, how: str = "sum") -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` in the client's time order, with the same
    two-level scheme (needs ``_b`` and ``_rn`` from :func:`client_time_scan`; the order is
    that of ``_rn``, so tied times keep their positions)."""
    agg = F.sum if how == "sum" else F.max
    w = (Window.partitionBy(client_col, "_b").orderBy("_rn")
         .rowsBetween(Window.unboundedPreceding, 0))
    ws = Window.partitionBy(client_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stats = (df.groupBy(client_col, "_b").agg(agg(value).alias("_sb"))
             .withColumn("_soff", agg("_sb").over(ws))
             .select(client_col, "_b", "_soff"))
    inner = agg(value).over(w)
    if how == "sum":
        combined = F.coalesce(F.col("_soff"), F.lit(0)) + F.col("_in")
    else:
        combined = F.greatest(F.coalesce(F.col("_soff"), F.col("_in")), F.col("_in"))
    return (_join_stats(df.withColumn("_in", inner), stats, client_col)
            .withColumn(name, combined.cast("long"))
            .drop("_in", "_soff"))


def prev_event_gap(df: DataFrame, client_col: str = "client_id",
                   ts_col: str = "timestamp", bucket_s: int = DEFAULT_BUCKET_S,
                   heavy_rows: int = HEAVY_CLIENT_ROWS) -> DataFrame:
    """Add ``prev_ts`` and ``gap_s`` (whole seconds, 0 for a client's first event)."""
    out = client_time_scan(df, client_col, ts_col, bucket_s, heavy_rows)
    return (out.withColumn("gap_s", F.when(F.col("prev_ts").isNull(), F.lit(0))
                           .otherwise(whole_seconds_between("prev_ts", ts_col)).cast("long"))
            .drop("_b", "_rn"))


_SPLIT_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("_rn", T.LongType()),
    T.StructField("_sstart", T.LongType()),
])


def _greedy_partition(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """Greedy split of every island in a partition sorted by (client, island, position).

    State carried across batches: the open island's key, its running total and the start
    position of its open session. Within an island, the next break is a binary search on
    the cumulative gaps (O(sessions · log rows)); a Python step is taken per island and
    per session, never per row.
    """
    key = None
    total = 0
    cur = 0
    last = None
    for b in batches:
        if b.empty:
            continue
        c = b["client_id"].to_numpy(dtype=np.int64)
        isl = b["_istart"].to_numpy(dtype=np.int64)
        rn = b["_rn"].to_numpy(dtype=np.int64)
        g = b["_g"].to_numpy(dtype=np.int64)
        n = len(b)
        order = np.lexsort((rn, isl, c))
        if np.any(order != np.arange(n)) or (last is not None and (c[0], isl[0], rn[0]) <= last):
            raise RuntimeError("island rows arrived out of order")
        last = (c[-1], isl[-1], rn[-1])
        change = np.ones(n, dtype=bool)
        change[1:] = (c[1:] != c[:-1]) | (isl[1:] != isl[:-1])
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n)
        out = np.empty(n, dtype=np.int64)
        for s0, e0 in zip(starts, ends):
            k = (int(c[s0]), int(isl[s0]))
            if k != key:
                key, total, cur = k, 0, int(rn[s0])
            cum = np.cumsum(g[s0:e0])
            m = e0 - s0
            start, base = 0, -total
            while start < m:
                end = int(np.searchsorted(cum, base + threshold, side="right"))
                out[s0 + start:s0 + min(end, m)] = cur
                if end >= m:
                    break
                cur = int(rn[s0 + end])
                base = int(cum[end])
                out[s0 + end] = cur
                start = end + 1
            total = int(cum[-1] - base)
        yield pd.DataFrame({"client_id": c, "_rn": rn, "_sstart": out})


def _parallel_island_split(base: DataFrame, huge: DataFrame, max_rows: int, client_col: str,
                           ts_col: str, threshold: int) -> DataFrame:
    """Exact greedy split of giant islands without a sequential pass.

    1. ``_c``: cumulative gap inside the island (bucketed running sum minus its value at the
       island start). 2. ``nxt(r)``: the first row with ``_c > _c[r] + threshold`` — the start
       of the next session if one starts at ``r`` — by an ordered forward scan over a union
       of rows and probes, two-level over value buckets of width ``threshold``. 3. Jump
       tables ``J_k = nxt^(2^k)`` by k self-joins (each checkpointed). 4. The session starts
       are the orbit of the island start under ``nxt``: expanded level by level from the
       highest jump down (``S ∪ J_k(S)``). 5. Each row takes the latest start at or before
       it (bucketed running max). Work O(rows · log rows), every step a partitioned join.
    """
    import math

    from clientele.session import materialize
    k_col = [client_col, "_istart"]
    rows = base.join(huge, k_col, "left_semi")
    rows = bucketed_running(rows, "_g", "_cc", client_col, ts_col, "sum")
    first = rows.where(F.col("_rn") == F.col("_istart")).select(*k_col, F.col("_cc").alias("_cc0"))
    rows = materialize(rows.join(first, k_col).select(
        *k_col, "_rn", ts_col, "_b", (F.col("_cc") - F.col("_cc0")).alias("_c")))

    # next session start if a session starts at r (null: none left in the island)
    pts = rows.select(*k_col, F.col("_c").cast("double").alias("_v"), F.lit(0).alias("_kind"),
                      F.col("_rn").alias("_j"), F.lit(None).cast("long").alias("_r"))
    prb = rows.select(*k_col, (F.col("_c") + F.lit(threshold)).cast("double").alias("_v"),
                      F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_j"),
                      F.col("_rn").alias("_r"))
    u = pts.unionByName(prb).withColumn("_vb", F.floor(F.col("_v") / F.lit(float(threshold))))
    w = (Window.partitionBy(*k_col, "_vb").orderBy("_v", "_kind", "_j")
         .rowsBetween(0, Window.unboundedFollowing))
    u = u.withColumn("_in", F.first("_j", ignorenulls=True).over(w))
    firsts = (u.groupBy(*k_col, "_vb")
              .agg(F.min(F.when(F.col("_kind") == 0, F.struct("_v", "_j"))).alias("_f"))
              .withColumn("_next", F.first(F.col("_f._j"), ignorenulls=True).over(
                  Window.partitionBy(*k_col).orderBy("_vb")
                  .rowsBetween(1, Window.unboundedFollowing)))
              .select(*k_col, "_vb", "_next"))
    jump = materialize(u.where(F.col("_kind") == 1).join(firsts, [*k_col, "_vb"], "left")
                       .select(*k_col, F.col("_r").alias("_node"),
                               F.coalesce("_in", "_next").alias("_to")))
    levels = [jump]
    for _ in range(max(1, math.ceil(math.log2(max_rows + 1)))):
        a = levels[-1].withColumnRenamed("_to", "_mid")
        b = levels[-1].select(*k_col, F.col("_node").alias("_mid"), F.col("_to").alias("_to2"))
        levels.append(materialize(a.join(b, [*k_col, "_mid"], "left")
                                  .select(*k_col, "_node", F.col("_to2").alias("_to"))))
    orbit = materialize(huge.select(*k_col, F.col("_istart").alias("_node")))
    for lvl in reversed(levels):
        step = (orbit.join(lvl, [*k_col, "_node"]).where(F.col("_to").isNotNull())
                .select(*k_col, F.col("_to").alias("_node")))
        orbit = materialize(orbit.unionByName(step).distinct())
    marked = (rows.join(orbit.select(*k_col, F.col("_node").alias("_rn"), F.lit(True).alias("_is")),
                        [*k_col, "_rn"], "left")
              .withColumn("_mk", F.when(F.col("_is"), F.col("_rn")).otherwise(F.lit(0).cast("long"))))
    out = bucketed_running(marked, "_mk", "_sstart", client_col, ts_col, "max")
    return out.select(F.col(client_col), "_rn", "_sstart")


def sessionize(df: DataFrame, threshold_s: int = C.SESSION_THRESHOLD_S,
               client_col: str = "client_id", ts_col: str = "timestamp",
               bucket_s: int = DEFAULT_BUCKET_S, heavy_rows: int = HEAVY_CLIENT_ROWS,
               huge_island_rows: int = HUGE_ISLAND_ROWS) -> DataFrame:
    """Add ``session``: the 1-based position (in the client's time order) of the first event
    of the row's session — a per-client session key that increases with time.

    Islands are keyed by the position of their first row (a bucketed running max), so a
    short island needs no further work; only rows of islands whose summed gaps exceed the
    threshold go through the streamed greedy split.
    """
    from clientele.session import materialize
    # a null client is a client of its own; the scanned base is written once, so that all
    # branches below see the same positions
    own, client_col = client_col, "_client"
    df = df.withColumn("_client", F.coalesce(F.col(own).cast("long"), F.lit(NULL_CLIENT)))
    base = materialize(client_time_scan(df, client_col, ts_col, bucket_s, heavy_rows))
    base = base.withColumn("gap_s", F.when(F.col("prev_ts").isNull(), F.lit(0))
                           .otherwise(whole_seconds_between("prev_ts", ts_col)).cast("long"))
    brk = (F.col("gap_s") > threshold_s) | (F.col("_rn") == 1)
    base = base.withColumn("_bstart", F.when(brk, F.col("_rn")).otherwise(F.lit(0)))
    base = bucketed_running(base, "_bstart", "_istart", client_col, ts_col, "max")
    # gap inside the island (the breaking gap starts it, total 0)
    base = base.withColumn("_g", F.when(brk, F.lit(0)).otherwise(F.col("gap_s")))
    # one row per island (small); materialized because it both decides the plan (are there
    # giant islands?) and feeds it
    islands = materialize(base.groupBy(client_col, "_istart").agg(
        F.sum("_g").alias("_span"), F.count(F.lit(1)).alias("_n")))
    long_islands = (islands.where((F.col("_span") > threshold_s) & (F.col("_n") <= huge_island_rows))
                    .select(client_col, "_istart"))

    rows = (base.join(long_islands, [client_col, "_istart"], "left_semi")
            .select(F.col(client_col).alias("client_id"), "_istart", "_rn", "_g"))

    def split_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _greedy_partition(batches, threshold_s)

    # islands hash-partitioned, each partition sorted by (client, island, position) and
    # streamed in Arrow batches: many islands per batch, a long island across batches
    split = (rows.repartition("client_id", "_istart")
             .sortWithinPartitions("client_id", "_istart", "_rn")
             .mapInPandas(split_islands, schema=_SPLIT_SCHEMA)
             .withColumnRenamed("client_id", client_col))
    # giant islands (more than huge_island_rows rows): exact parallel form, no single task
    huge = islands.where((F.col("_span") > threshold_s) & (F.col("_n") > huge_island_rows))
    max_n = huge.agg(F.max("_n")).first()[0]
    if max_n:
        par = _parallel_island_split(base, huge.select(client_col, "_istart"), int(max_n),
                                     client_col, ts_col, threshold_s)
        split = split.unionByName(par)
    out = (base.join(split, [client_col, "_rn"], "left")
           .withColumn("session", F.coalesce("_sstart", "_istart").cast("long")))
    return out.drop("_rn", "_bstart", "_istart", "_g", "_sstart", "prev_ts", "gap_s", "_b", "_client")


def number_sessions(sessions: DataFrame, client_col: str = "client_id") -> DataFrame:
    """Replace session keys by consecutive numbers 1, 2, ... per client (presentation).

    The keys are already ordered; numbering is a dense rank over the collapsed session
    table (one row per session, not per event) joined back."""
    keys = sessions.select(client_col, "session").distinct()
    num = keys.withColumn("_num", F.dense_rank().over(
        Window.partitionBy(client_col).orderBy("session")).cast("long"))
    num = num.withColumnRenamed(client_col, "_nc").withColumnRenamed("session", "_ns")
    return (sessions.join(num, F.col(client_col).eqNullSafe(F.col("_nc")) & (F.col("session") == F.col("_ns")))
            .drop("session", "_nc", "_ns").withColumnRenamed("_num", "session"))


def session_collapse(sessions: DataFrame, key: str, client_col: str = "client_id",
                     ts_col: str = "timestamp") -> DataFrame:
    """Per session: first key (by time), start, end and ``time_diff`` in whole seconds."""
    return (sessions.groupBy(client_col, "session")
            .agg(F.min_by(key, F.struct(ts_col, key)).alias(key),
                 F.min(ts_col).alias("session_start"),
                 F.max(ts_col).alias("session_end"))
            .withColumn("time_diff", whole_seconds_between("session_start", "session_end")))


def collapse(df: DataFrame, key: str, threshold_s: int = C.SESSION_THRESHOLD_S) -> DataFrame:
    """Sessionize then collapse: one row per session."""
    return session_collapse(sessionize(df, threshold_s), key)


def asof_session(events: DataFrame, sessions: DataFrame,
                 tolerance_s: int = C.ASOF_TOLERANCE_S, client_col: str = "client_id",
                 ts_col: str = "timestamp", carry: list[str] | None = None,
                 bucket_s: int = DEFAULT_BUCKET_S, heavy_rows: int = HEAVY_CLIENT_ROWS) -> DataFrame:
    """Backward as-of match of events to the latest session of the same client.

    A session matches an event when ``session_start <= ts`` and it is the latest such
    session; the match is kept only if ``ts <= session_start + time_diff + tolerance``.
    Implemented as one ordered pass: sessions and events are unioned and every event takes
    the last session seen before it (sessions sort first at equal times). No pairs of
    the two sides are formed. Returns the matched events with ``session_start``,
    ``session_end_ext`` and the ``carry`` columns of the session.
    """
    carry = carry or []
    s = (sessions.select(client_col, "session_start", "time_diff", *carry)
         .withColumn("session_end_ext",
                     add_seconds(add_seconds("session_start", F.col("time_diff")), tolerance_s)))
    ev_cols = [c for c in events.columns]
    marker = s.select(
        F.col(client_col), F.col("session_start").alias("_t"), F.lit(0).alias("_side"),
        F.struct(F.col("session_start"), F.col("session_end_ext"),
                 *[F.col(c) for c in carry]).alias("_sess"),
        F.lit(None).cast(T.StructType([T.StructField(c, events.schema[c].dataType)
                                       for c in ev_cols])).alias("_ev"))
    evs = events.select(
        F.col(client_col), F.col(ts_col).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(marker.schema["_sess"].dataType).alias("_sess"),
        F.struct(*[F.col(c) for c in ev_cols]).alias("_ev"))
    # two-level ordered pass: last session inside the (client, bucket), else the last
    # session of the client's earlier buckets from a one-row-per-bucket carry table
    both = with_client_buckets(marker.unionByName(evs), client_col, "_t", bucket_s, heavy_rows)
    w = (Window.partitionBy(client_col, "_b").orderBy("_t", "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_lastb", F.last("_sess", ignorenulls=True).over(w))
    is_s = F.col("_side") == 0
    ws = Window.partitionBy(client_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry_t = (both.groupBy(client_col, "_b")
               .agg(F.max_by(F.when(is_s, F.col("_sess")), F.when(is_s, F.col("_t"))).alias("_bl"))
               .withColumn("_carry", F.last("_bl", ignorenulls=True).over(ws))
               .select(client_col, "_b", "_carry"))
    both = (both.where(F.col("_side") == 1)
            .transform(lambda d: _join_stats(d, carry_t, client_col, "left"))
            .withColumn("_last", F.coalesce("_lastb", "_carry")))
    matched = (both.where(F.col("_last").isNotNull())
               .where(F.col("_t") <= F.col("_last.session_end_ext")))
    return matched.select("_ev.*", "_last.*")


def nearby_products(sessions: DataFrame, key: str, products: DataFrame,
                    top_skus: DataFrame, top_cats: DataFrame,
                    tolerance_s: int = C.ASOF_TOLERANCE_S) -> DataFrame:
    """Per session: ``num_events_nearby`` (int), ``has_top_sku``, ``has_top_category`` (tinyint).

    ``products``: ``client_id, timestamp, sku, category``. Top lists are bounded (k rows)
    and broadcast. Sessions without matches get 0.
    """
    sess = sessions.withColumn(
        "session_end_ext", add_seconds(add_seconds("session_start", F.col("time_diff")), tolerance_s))
    p = (products.select("client_id", "timestamp", "sku", "category")
         .join(F.broadcast(top_skus.select(F.col("sku"), F.lit(1).alias("_ts"))), "sku", "left")
         .join(F.broadcast(top_cats.select(F.col("category"), F.lit(1).alias("_tc"))), "category", "left")
         .withColumn("is_top_sku", F.coalesce("_ts", F.lit(0)).cast("tinyint"))
         .withColumn("is_top_category", F.coalesce("_tc", F.lit(0)).cast("tinyint"))
         .drop("_ts", "_tc"))
    m = asof_session(p, sess.select("client_id", "session_start", "time_diff", key),
                     tolerance_s=tolerance_s, carry=[key])
    counts = (m.groupBy("client_id", key, "session_start")
              .agg(F.count(F.lit(1)).cast("int").alias("num_events_nearby"),
                   F.max("is_top_sku").cast("tinyint").alias("has_top_sku"),
                   F.max("is_top_category").cast("tinyint").alias("has_top_category")))
    return (sess.join(counts, ["client_id", key, "session_start"], "left")
            .withColumn("num_events_nearby", F.coalesce("num_events_nearby", F.lit(0)).cast("int"))
            .withColumn("has_top_sku", F.coalesce("has_top_sku", F.lit(0)).cast("tinyint"))
            .withColumn("has_top_category", F.coalesce("has_top_category", F.lit(0)).cast("tinyint")))
