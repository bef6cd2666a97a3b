"""Vector-text parsing and array helpers, all built-in Catalyst expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear form of the strict vector pattern: brackets around digits and spaces only.
STRICT_VECTOR_PATTERN = r"^\[[ 0-9]*\]$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tokens(text: Column) -> Column:
    inner = F.regexp_replace(text, r"[\[\]]", "")
    return F.filter(F.split(inner, " "), lambda s: s != F.lit(""))


def parse_vector_strict(text, raise_on_error: bool = True) -> Column:
    """``'[11 2 3]'`` → ``array<int>``.

    Text that is not brackets around digits and spaces raises (``raise_on_error``) or gives
    null. Empty brackets give an empty array.
    """
    t = _col(text)
    parsed = F.transform(_tokens(t), lambda s: s.cast("int"))
    ok = t.rlike(STRICT_VECTOR_PATTERN)
    if raise_on_error:
        bad = F.raise_error(F.concat(
            t, F.lit(" is incorrect form of string representation of vector")))
        return F.when(t.isNull(), F.lit(None)).when(ok, parsed).otherwise(bad)
    return F.when(ok, parsed)


def parse_vector_lenient(text) -> Column:
    """Accepts commas as separators; null when any element is not an integer."""
    t = _col(text)
    inner = F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", "")
    toks = F.filter(F.split(F.translate(inner, ",", " "), " "), lambda s: s != F.lit(""))
    vals = F.transform(toks, lambda s: s.try_cast("int"))
    any_bad = F.exists(vals, lambda v: v.isNull())
    return F.when(t.isNull(), F.lit(None)).when(any_bad, F.lit(None)).otherwise(vals)


def array_scale(arr, lo, hi) -> Column:
    """Elementwise map of ``arr`` from ``[lo, hi]`` to ``[-1, 1]``."""
    a = _col(arr)
    return F.transform(a, lambda x: (x.cast("double") - lo) / (hi - lo) * 2 - 1)


def dot(a, b) -> Column:
    """Dot product of two numeric arrays of equal length."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a, b) -> Column:
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def pad_array(arr, length: int, pad_value) -> Column:
    """Right-pad an array to ``length`` with ``pad_value`` (no truncation)."""
    a = _col(arr)
    n = F.greatest(F.lit(length) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(F.lit(pad_value).cast("double"), n))
