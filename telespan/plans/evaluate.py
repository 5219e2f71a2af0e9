"""The evaluation path: positioned telemetry to scored forecasts, in one pass over each part."""

from __future__ import annotations

from pyspark.sql import DataFrame

from telespan.operators import baselines as B
from telespan.operators import evaluation as E
from telespan.operators import forecasts as C

NAIVE = ["Persistence", "Moving Average", "Seasonal Naive"]


def test_forecasts(rows: DataFrame, methods: list[str] = NAIVE, linear: str | None = None) -> DataFrame:
    """Forecasts of the test part. ``linear`` is ``train`` (fit before the test part) or ``in_sample``."""
    test = C.split_test(rows)
    wide = B.add_baselines(test, methods)
    if linear:
        wide = B.linear_regression(wide, C.split_train(rows) if linear == "train" else None)
        methods = [*methods, "Linear Regression"]
    return B.long_forecasts(wide, methods)


def test_columns(rows: DataFrame, methods: list[str] = NAIVE) -> DataFrame:
    """The test part with its forecasts as columns."""
    return B.add_baselines(C.split_test(rows), methods)


def validation_columns(rows: DataFrame, methods: list[str] = NAIVE) -> DataFrame:
    return B.add_baselines(C.split_validation(rows), methods)


def validation_forecasts(rows: DataFrame, methods: list[str] = NAIVE) -> DataFrame:
    return B.long_forecasts(B.add_baselines(C.split_validation(rows), methods), methods)


def score_naive(rows: DataFrame, q: float = 0.90) -> DataFrame:
    """Errors, guarded spike scores and quality of the naive methods on the test part."""
    thresholds = E.quantile_thresholds(C.split_train(rows), q)
    return E.score(test_forecasts(rows), thresholds)


test_forecasts.__test__ = test_columns.__test__ = False
