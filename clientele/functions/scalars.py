"""Scalar column expressions (math, time, guards). All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientele import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conversion_ratio(num, den) -> Column:
    """``num / den`` where x/0 → 1.0 and 0/0 → 0.0 (ANSI division would raise)."""
    n, d = _col(num), _col(den)
    return (F.when(d == 0, F.when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
            .otherwise(n.cast("double") / d.cast("double")))


def signed_log1p(w) -> Column:
    """``log1p(w)`` for w > 0, ``-log1p(|w|)`` for w < 0, 0 kept."""
    x = _col(w).cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def time_decay(weeks, alpha: float = C.DECAY_ALPHA) -> Column:
    return F.exp(F.lit(-alpha) * _col(weeks).cast("double"))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x).cast("double")))


def whole_seconds_between(start, end) -> Column:
    """Duration ``end - start`` in whole seconds, truncated toward zero.

    Wall-clock difference of the (time-zone-free) timestamps: independent of the session
    time zone, so a daylight-saving change never shifts a gap."""
    d = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return F.when(d >= 0, F.floor(d / 1000000)).otherwise(-F.floor(-d / 1000000)).cast("long")


EPOCH_NTZ = "1970-01-01 00:00:00"


def micros_since_epoch(ts) -> Column:
    """Microseconds from 1970-01-01 (wall clock, monotone, time-zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), _col(ts))


def whole_days_between(start, end) -> Column:
    """Duration in whole days, truncated toward zero."""
    secs = whole_seconds_between(start, end)
    return F.when(secs >= 0, F.floor(secs / 86400)).otherwise(-F.floor(-secs / 86400)).cast("long")


def add_seconds(ts, seconds) -> Column:
    q = F.lit(seconds) if isinstance(seconds, (int, float)) else _col(seconds)
    return F.timestamp_add("SECOND", q.cast("long"), _col(ts))


def iso_weekday(ts) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(_col(ts)) + 1


def event_type_onehot(event_type="event_type") -> Column:
    """5 slots: buy, add, remove, visit, everything else."""
    t = _col(event_type)
    slots = [(t == name).cast("int") for name in C.ONEHOT_ORDER]
    other = (~t.isin(*C.ONEHOT_ORDER) | t.isNull()).cast("int")
    return F.array(*[F.coalesce(s, F.lit(0)) for s in slots], other)


def ieee_ratio(num, den) -> Column:
    """IEEE division: 0/0 → NaN, x/0 → Inf (what a non-ANSI engine returns)."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return (F.when(d == 0, F.when(n == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
            .otherwise(n / d))
