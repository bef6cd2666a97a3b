"""Fitted scaling. Fitting is one aggregate for all columns, collected as a
single row (bounded by construction); the transform applies the fitted values as literals,
so the plan never joins the data with its own statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele import config as C


def _clean(c: str):
    """NaN → null so min/max ignore it (Spark orders NaN above every number)."""
    return F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c).cast("double"))


def fit_minmax(df: DataFrame, columns: list[str], source: dict[str, F.Column]) -> dict[str, tuple]:
    """Fit: one aggregate for all columns, collected as a single row (bounded)."""
    r = df.agg(*[a for c in columns for a in (F.min(source[c]).alias(f"_mn_{c}"),
                                              F.max(source[c]).alias(f"_mx_{c}"))]).first()
    return {c: (r[f"_mn_{c}"], r[f"_mx_{c}"]) for c in columns}


def _minmax_apply(df: DataFrame, columns: list[str], source: dict[str, F.Column],
                  stats: dict[str, tuple] | None = None) -> DataFrame:
    """Transform with fitted literals: ``x · s + (-1 - min · s)``, ``s = 2 / (max - min)``
    (range 0 → 1, so a constant column maps to -1); NaN stays NaN."""
    stats = stats or fit_minmax(df, columns, source)
    out = {}
    for c in columns:
        mn, mx = stats[c]
        if mn is None:
            out[c] = F.lit(None).cast("double")
            continue
        rng = (mx - mn) or 1.0
        scale = 2.0 / rng
        scaled = source[c] * F.lit(scale) + F.lit(-1.0 - mn * scale)
        out[c] = F.when(F.isnan(F.col(c)), F.lit(float("nan"))).otherwise(scaled)
    return df.withColumns(out)


def scale_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column to [-1, 1] by its min and max; constant column → -1; NaN stays NaN."""
    return _minmax_apply(df, columns, {c: _clean(c) for c in columns})


def scale_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """``log1p`` then [-1, 1]."""
    src = {c: F.log1p(_clean(c)) for c in columns}
    return _minmax_apply(df, columns, src)


# ---- Yeo-Johnson ------------------------------------------------------------------------------

def yeo_johnson(x, lam):
    """Yeo-Johnson transform of column ``x`` with λ column/literal ``lam``."""
    pos = x >= 0
    lam_c = lam
    return (F.when(pos & (F.abs(lam_c) < 1e-12), F.log1p(x))
            .when(pos, (F.pow(x + 1, lam_c) - 1) / lam_c)
            .when(F.abs(lam_c - 2) < 1e-12, -F.log1p(-x))
            .otherwise(-(F.pow(-x + 1, 2 - lam_c) - 1) / (2 - lam_c)))


#: Rows of the histogram that a task transforms at once; widenings of a grid.
YEO_ROWS = 2048
MOST_WIDENINGS = 40


def _psi(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Yeo-Johnson transforms of values (rows) for each λ (columns)."""
    out = np.empty((len(x), len(lam)))
    up = x >= 0
    for rows, sign, power in ((up, 1.0, lam), (~up, -1.0, 2 - lam)):
        log = np.log1p(np.abs(x[rows]))[:, None]
        flat = np.abs(power) < 1e-12
        safe = np.where(flat, 1.0, power)
        with np.errstate(over="ignore"):
            out[rows] = sign * np.where(flat, log, (np.power(np.abs(x[rows])[:, None] + 1, safe) - 1) / safe)
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (n, mean, M2) of two sets of values joined, by column."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    share = b[0] / np.where(n > 0, n, 1)
    return np.stack([n, a[1] + off * share, a[2] + b[2] + off * off * a[0] * share])


def _loglik_grid(hist: DataFrame, columns: list[str], grids: dict[str, list[float]]) -> dict[str, float]:
    """Best λ per column on its grid, in one pass over the histogram: every task folds its
    rows into (n, mean, M2) for all grid points of a column, and the tasks' states are merged
    pairwise by column."""
    grids = {c: np.array(grids[c], float) for c in columns}

    def fold(parts):
        import pandas as pd
        held: dict[str, tuple[np.ndarray, float]] = {}
        for part in parts:
            for c, rows in part.groupby("column_name"):
                x, n = rows["x"].to_numpy(float), rows["n"].to_numpy(float)
                for i in range(0, len(x), YEO_ROWS):
                    xs, ns = x[i : i + YEO_ROWS], n[i : i + YEO_ROWS, None]
                    psi = _psi(xs, grids[c])
                    total = ns.sum()
                    # from the first row, so that equal values have no variance at all
                    mean = psi[0] + (ns * (psi - psi[0])).sum(axis=0) / total
                    state = np.stack([np.full(len(mean), total), mean, (ns * (psi - mean) ** 2).sum(axis=0)])
                    logs = float((ns[:, 0] * np.sign(xs) * np.log1p(np.abs(xs))).sum())
                    held[c] = (_merged(held[c][0], state), held[c][1] + logs) if c in held else (state, logs)
        if held:
            yield pd.DataFrame([(c, st.ravel(), logs) for c, (st, logs) in held.items()], columns=["column_name", "state", "logs"])

    def merge(parts):
        import pandas as pd
        held: dict[str, tuple[np.ndarray, float]] = {}
        for part in parts:
            for c, st, logs in zip(part["column_name"], part["state"], part["logs"]):
                st = np.asarray(st, float).reshape(3, -1)
                held[c] = (_merged(held[c][0], st), held[c][1] + logs) if c in held else (st, logs)
        if held:
            yield pd.DataFrame([(c, st.ravel(), logs) for c, (st, logs) in held.items()], columns=["column_name", "state", "logs"])

    schema = "column_name string, state array<double>, logs double"
    rows = hist.where(F.col("column_name").isin(columns)).mapInPandas(fold, schema)
    best: dict[str, float] = {}
    for r in rows.repartition("column_name").mapInPandas(merge, schema).collect():  # one row per column
        lam = grids[r["column_name"]]
        n, _, m2 = np.array(r["state"]).reshape(3, -1)
        with np.errstate(all="ignore"):
            ll = -n / 2 * np.log(m2 / n) + (lam - 1) * r["logs"]
        fine = np.flatnonzero((m2 > 0) & np.isfinite(ll))
        if len(fine):
            best[r["column_name"]] = float(lam[min(fine, key=lambda i: (-ll[i], abs(lam[i])))])
    return {c: best.get(c, 1.0) for c in columns}


def fit_yeo_lambdas(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Maximum-likelihood λ per column (Yeo & Johnson 2000).

    Each column is reduced to a histogram of distinct values (counts), which is written once;
    then λ is searched on a grid of quarters and refined to thousandths. While the best point
    lies on the edge of its grid, the grid moves there with twice the step, and then the step
    is halved down to a quarter again, so λ has no bounds (after ``MOST_WIDENINGS`` widenings
    the edge is taken: a span beyond 1e12). Every round is one pass for all columns. NaN and
    null values are ignored; a constant column has λ = 1.
    """
    from clientele.session import materialize
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    hist = materialize(df.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, x)")
                       .where(F.col("x").isNotNull() & ~F.isnan("x"))
                       .groupBy("column_name", "x").agg(F.count(F.lit(1)).cast("double").alias("n")))
    grids = {c: [k / 4 for k in range(-16, 17)] for c in columns}
    steps = dict.fromkeys(columns, 0.25)
    best = _loglik_grid(hist, columns, grids)
    for _ in range(MOST_WIDENINGS):
        edge = [c for c in columns if best[c] in (grids[c][0], grids[c][-1])]
        if not edge:
            break
        for c in edge:
            steps[c] *= 2
            middle = round(best[c] / steps[c])
            grids[c] = [(middle + k) * steps[c] for k in range(-16, 17)]
        best |= _loglik_grid(hist, edge, grids)
    while wide := [c for c in columns if steps[c] > 0.25]:
        for c in wide:
            steps[c] /= 2
            grids[c] = [best[c] + k * steps[c] for k in range(-2, 3)]
        best |= _loglik_grid(hist, wide, grids)
    for step in (0.025, 0.001):
        width = step * 10
        grids = {c: list(np.round(np.arange(best[c] - width, best[c] + width + step / 2, step), 6))
                 for c in columns}
        best = _loglik_grid(hist, columns, grids)
    return best


def scale_yeo(df: DataFrame, columns: list[str], lambdas: dict[str, float] | None = None) -> DataFrame:
    """Yeo-Johnson with fitted λ, then [-1, 1] (standardizing first is affine and cancels)."""
    lambdas = lambdas or fit_yeo_lambdas(df, columns)
    src = {c: yeo_johnson(_clean(c), F.lit(lambdas[c])) for c in columns}
    return _minmax_apply(df, columns, src)


def scale_columns(df: DataFrame, columns: list[str], transform: str | None) -> DataFrame:
    if not columns:
        return df
    if transform == "log":
        return scale_log(df, columns)
    if transform == "yeo":
        return scale_yeo(df, columns)
    return scale_minmax(df, columns)


SCALE_GROUPS = {
    "product": (C.PRODUCT_COUNT_COLUMNS, C.PRODUCT_CR_COLUMNS, C.PRODUCT_ENTROPY_COLUMNS),
    "query": (C.QUERY_COUNT_COLUMNS, ["time_diff"], C.QUERY_ENTROPY_COLUMNS),
    "visit": (C.URL_COUNT_COLUMNS, ["time_diff"], C.URL_ENTROPY_COLUMNS),
}


def scale_groups(df: DataFrame, kind: str, normalizer: str = "yeo") -> DataFrame:
    """Counts by ``normalizer`` (yeo or minmax), rates/price/time_diff plain, entropies log."""
    counts, plain, ents = SCALE_GROUPS[kind]
    df = scale_columns(df, counts, normalizer)
    df = scale_columns(df, plain, None)
    return scale_columns(df, ents, "log")


def vector_minmax(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: global min and max over all elements (no explode)."""
    return df.agg(F.min(F.array_min(col)).cast("double").alias("min_val"),
                  F.max(F.array_max(col)).cast("double").alias("max_val"))


def scale_vectors(df: DataFrame, col: str = "embedding", out: str = "norm") -> DataFrame:
    """Vector column to [-1, 1] by the global min and max of its elements (fitted once)."""
    r = vector_minmax(df, col).first()
    mn, mx = r["min_val"], r["max_val"]
    rng = (mx - mn) if mn is not None and mx != mn else 1.0
    return df.withColumn(out, F.transform(col, lambda x: (x.cast("double") - F.lit(mn)) /
                                          F.lit(rng) * 2 - 1))


# ---- legacy variants ------------------------------------------------------------------------------

def max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """null → 0, ``x / (max + 1e-9)``."""
    r = df.agg(*[F.max(c).cast("double").alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) /
                           F.lit((r[c] or 0.0) + 1e-9) for c in columns})


def time_diff_max_scale(df: DataFrame, col: str = "time_diff") -> DataFrame:
    mx = df.agg(F.max(col).cast("double")).first()[0]
    return df.withColumn(col, F.col(col).cast("double") / F.lit(mx))


def entropy_norm(df: DataFrame, pairs: list[tuple[str, str]], eps: float = 1e-9) -> DataFrame:
    """Legacy: entropy column / log2(n distinct of the other side's key).

    ``pairs``: (entropy column, key column whose distinct count is the ceiling)."""
    import math
    keys = sorted({k for _, k in pairs})
    r = df.agg(*[F.count_distinct(k).alias(k) for k in keys]).first()
    lg = {k: math.log2(r[k]) if r[k] else float("-inf") for k in keys}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(lg[k] + eps)
                           for c, k in pairs})


def cap_weekly(df: DataFrame, columns: list[str], max_val: float = C.CAP_WEEKLY_MAX) -> DataFrame:
    """Legacy: weekly count / 600, capped at 1."""
    return df.withColumns({c: F.least(F.col(c).cast("double") / max_val, F.lit(1.0)) for c in columns})


def vector_max_norm(df: DataFrame, col: str = "embedding", out: str = "norm") -> DataFrame:
    """Legacy: vector / global max element."""
    mx = df.agg(F.max(F.array_max(col)).cast("double")).first()[0]
    return df.withColumn(out, F.transform(col, lambda x: x.cast("double") / F.lit(mx)))
