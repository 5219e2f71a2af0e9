"""F-01 and W-06 .. W-09: naive forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from telespan.model import METRICS
from telespan.operators.forecasts import to_long
from telespan.operators.layout import CHUNK_ROWS, chunk_window, drop_halo, lookup, split_chunks

MOVING_WINDOW = 5
SEASON = 24
OLS_LAGS = 3


def persistence(x: str, w: WindowSpec) -> Column:
    """W-06"""
    return F.coalesce(F.lag(x).over(w), F.col(x))


def moving_average(x: str, w: WindowSpec) -> Column:
    """W-07"""
    return F.coalesce(F.avg(x).over(w.rowsBetween(-MOVING_WINDOW, -1)), F.col(x))


def seasonal_naive(x: str, w: WindowSpec) -> Column:
    """W-08"""
    return F.coalesce(F.lag(x, SEASON).over(w), F.lag(x).over(w), F.col(x))


# F-01: method name -> (look-back, forecast of a column over a window).
BASELINES: dict[str, tuple[int, Callable[[str, WindowSpec], Column]]] = {
    "Persistence": (1, persistence),
    "Moving Average": (MOVING_WINDOW, moving_average),
    "Seasonal Naive": (SEASON, seasonal_naive),
}


def register(name: str, look_back: int, forecast: Callable[[str, WindowSpec], Column]) -> None:
    """Add a bounded baseline under a new name."""
    BASELINES[name] = (look_back, forecast)


def suffix(method: str) -> str:
    return "__" + method.lower().replace(" ", "_")


def add_baselines(df: DataFrame, methods: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One column per metric and method, all on one shuffle and one sort."""
    methods = methods or list(BASELINES)
    look_back = max(BASELINES[m][0] for m in methods)
    spec = chunk_window()
    columns = {f"{x}{suffix(m)}": BASELINES[m][1](x, spec) for m in methods for x in METRICS}
    return drop_halo(split_chunks(df, look_back, chunk_rows).withColumns(columns), chunk_rows)


def long_forecasts(wide: DataFrame, methods: list[str], keep: list[str] | None = None) -> DataFrame:
    """U-03: stacked forecasts ``(series_id, row_idx, method, metric, actual, predicted)``.

    One generator per row replaces a union of scans.
    """
    keep = keep or []
    entries = F.array(
        *[
            F.struct(
                F.lit(method).alias("method"),
                F.lit(x).alias("metric"),
                F.col(x).alias("actual"),
                F.col(f"{x}{suffix(method)}").cast("double").alias("predicted"),
            )
            for method in methods
            for x in METRICS
        ]
    )
    return wide.select("series_id", "row_idx", *keep, F.inline(entries))


# ---- W-09: least squares on three lags of three metrics ----


def _lag_columns(df: DataFrame, chunk_rows: int) -> tuple[DataFrame, list[str]]:
    spec = chunk_window()
    names = {f"_x{i}_{m}": F.lag(m, OLS_LAGS - i).over(spec) for i in range(OLS_LAGS) for m in METRICS}
    return drop_halo(split_chunks(df, OLS_LAGS, chunk_rows).withColumns(names), chunk_rows), list(names)


def _solve(batches):
    """F-04: one row per series holding covariances; never raw rows."""
    for pdf in batches:
        coefficients, means = [], []
        for _, row in pdf.iterrows():
            k = len(row["_mx"])
            # Series with equal spread share one tolerance; pinv drops constant inputs.
            cxx = np.asarray(row["_cxx"], dtype=float).reshape(k, k)
            cxy = np.asarray(row["_cxy"], dtype=float).reshape(k, len(METRICS))
            spread = np.sqrt(np.where(np.diag(cxx) > 0, np.diag(cxx), 1.0))
            beta = np.linalg.pinv(cxx / np.outer(spread, spread), rcond=1e-12) @ (cxy / spread[:, None])
            beta = beta / spread[:, None]
            coefficients.append(beta.T.ravel().tolist())
            means.append((np.asarray(row["_my"]) - beta.T @ np.asarray(row["_mx"])).tolist())
        yield pd.DataFrame({"series_id": pdf["series_id"], "_beta": coefficients, "_intercept": means})


def fit_linear(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Coefficients per series from mergeable covariance aggregates and a 9x9 solve."""
    lagged, xs = _lag_columns(df, chunk_rows)
    rows = lagged.filter(F.col("row_idx") >= OLS_LAGS)
    pairs = {(a, b): F.covar_pop(a, b) for i, a in enumerate(xs) for b in xs[i:]}
    cross = {(a, m): F.covar_pop(a, m) for a in xs for m in METRICS}
    stats = rows.groupBy("series_id").agg(
        F.array(*[F.avg(c) for c in xs]).alias("_mx"),
        F.array(*[F.avg(c) for c in METRICS]).alias("_my"),
        F.array(*[pairs[(a, b)] if (a, b) in pairs else pairs[(b, a)] for a in xs for b in xs]).alias("_cxx"),
        F.array(*[cross[(a, m)] for a in xs for m in METRICS]).alias("_cxy"),
    )
    return stats.mapInPandas(_solve, "series_id string, _beta array<double>, _intercept array<double>")


def linear_regression(
    df: DataFrame, fit_on: DataFrame | None = None, method: str = "Linear Regression", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """W-09: adds one column per metric. Rows without three lags keep the actual value.

    ``fit_on`` is the training part. Without it the fit is in-sample, as in the
    reference, for comparison only.
    """
    coefficients = fit_linear(fit_on if fit_on is not None else df, chunk_rows)
    lagged, xs = _lag_columns(df, chunk_rows)
    joined = lookup(lagged, coefficients, ["series_id"], "left")
    out = {}
    for j, m in enumerate(METRICS):
        terms = F.get("_intercept", F.lit(j))
        for i, x in enumerate(xs):
            terms = terms + F.get("_beta", F.lit(j * len(xs) + i)) * F.col(x)
        out[f"{m}{suffix(method)}"] = F.when(F.col("row_idx") >= OLS_LAGS, terms).otherwise(F.col(m))
    return joined.withColumns(out).drop("_beta", "_intercept", *xs)
