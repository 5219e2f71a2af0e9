"""Quality scores over already aggregated errors and spike counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from telespan.functions.scalar import log_ratio_score


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def precision(tp: Column, fp: Column) -> Column:
    return tp / F.greatest(tp + fp, F.lit(1))


def recall(tp: Column, fn: Column) -> Column:
    return tp / F.greatest(tp + fn, F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return 2.0 * p * r / F.greatest(p + r, F.lit(1e-9))


def range_error_score(mae: Column, rmse: Column, data_range: Column) -> Column:
    return 0.55 * unit(1.0 - mae / data_range) + 0.45 * unit(1.0 - rmse / data_range)


def spike_score(
    actual_spikes: Column, predicted_spikes: Column, p: Column, r: Column, f: Column, rows: Column
) -> Column:
    return (
        F.when(actual_spikes > 0, 0.5 * f + 0.25 * p + 0.25 * r)
        .when(predicted_spikes == 0, 1.0)
        .otherwise(unit(1.0 - predicted_spikes / F.greatest(rows, F.lit(1))))
    )


def report_quality(error_score: Column, spike: Column) -> Column:
    """A-11: the score reports use. A metric without a spike row scores 0.5 there."""
    return 100.0 * unit(0.55 * error_score + 0.45 * F.coalesce(spike, F.lit(0.5)))


def log_ratio_quality(
    model_mae: Column, baseline_mae: Column, r2: Column, f: Column, actual_spikes: Column, predicted_spikes: Column
) -> Column:
    """A-12: the score calibration maximizes."""
    error = 0.55 * log_ratio_score(model_mae, baseline_mae) + 0.45 * unit(r2)
    quiet = F.when(predicted_spikes < 5, 1.0).otherwise(unit(1.0 - predicted_spikes / 20.0))
    return 100.0 * (0.60 * error + 0.40 * F.when(actual_spikes == 0, quiet).otherwise(unit(f)))
