"""Lag, rolling and calendar features; sequence windows; oversampling; standardization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telespan.functions import scalar as S
from telespan.model import METRICS
from telespan.operators.forecasts import to_long
from telespan.operators.layout import CHUNK_ROWS, chunk_window, drop_halo, lookup, split_chunks, windowed

ROLL_WINDOWS = (3, 6, 12, 24)
CALENDAR_FEATURES = ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_weekend"]


def feature_names(look_back: int) -> list[str]:
    names = list(CALENDAR_FEATURES)
    for m in METRICS:
        names += [f"{m}_lag_{i}" for i in range(1, look_back + 1)]
        for n in ROLL_WINDOWS:
            if n <= look_back:
                names += [f"{m}_roll_mean_{n}", f"{m}_roll_std_{n}", f"{m}_roll_max_{n}"]
        names.append(f"{m}_delta_1")
    return names


def add_features(
    df: DataFrame, look_back: int = 24, keep_partial: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """W-01, W-02, W-03, P-05, P-06: features of the rows before each row, never of the row itself.

    One window call per metric gathers the previous values in an array, newest
    first; lags and the rolling mean and maximum index or fold that array. So
    116 columns cost three array frames and twelve deviations on one sort, and
    generated code stays small. Rows without a full look-back are dropped
    unless ``keep_partial``.
    """
    spec = chunk_window()
    before = spec.rowsBetween(-look_back, -1)
    chunked = split_chunks(df, max(look_back, 2), chunk_rows)
    gathered = drop_halo(
        chunked.withColumns(
            {
                **{f"_{m}": F.reverse(F.collect_list(m).over(before)) for m in METRICS},
                **{
                    f"{m}_roll_std_{n}": F.when(
                        F.count(m).over(spec.rowsBetween(-n, -1)) == n, F.stddev_samp(m).over(spec.rowsBetween(-n, -1))
                    )
                    for m in METRICS
                    for n in ROLL_WINDOWS
                    if n <= look_back
                },
            }
        ),
        chunk_rows,
    )
    if not keep_partial:
        gathered = gathered.filter(F.size(f"_{METRICS[0]}") == look_back)
    columns: dict[str, Column] = {**S.calendar(), "is_weekend": S.is_weekend()}
    for m in METRICS:
        past = F.col(f"_{m}")
        for i in range(look_back):
            columns[f"{m}_lag_{i + 1}"] = F.get(past, F.lit(i))
        for n in ROLL_WINDOWS:
            if n > look_back:
                continue
            last_n = F.slice(past, 1, n)
            full = F.size(past) >= n
            columns[f"{m}_roll_mean_{n}"] = F.when(
                full, F.aggregate(F.reverse(last_n), F.lit(0.0), lambda a, x: a + x) / n
            )
            columns[f"{m}_roll_max_{n}"] = F.when(full, F.array_max(last_n))
        columns[f"{m}_delta_1"] = F.get(past, F.lit(0)) - F.get(past, F.lit(1))
    std = [c for c in gathered.columns if "_roll_std_" in c]
    base = [c for c in gathered.columns if c not in std and not c.startswith("_")]
    named = {**columns, **{c: F.col(c) for c in std}}
    return gathered.select(*base, *[named[c].alias(c) for c in feature_names(look_back)])


def sequences(df: DataFrame, length: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-10: ``length`` previous rows (oldest first) with the row itself as target."""
    row = F.struct(*METRICS)
    out = windowed(
        df,
        {"window": lambda w: F.collect_list(row).over(w.rowsBetween(-length, -1))},
        length,
        chunk_rows=chunk_rows,
    )
    return out.filter(F.size("window") == length).withColumn("seq_idx", F.col("row_idx") - length)


def oversample(df: DataFrame, spike: Column, repeats: int = 3) -> DataFrame:
    """U-01 / U-02: each spike row ``repeats`` more times, in one pass and without a union."""
    copies = F.when(spike, F.lit(1 + repeats)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def instance_weight(metric: str, multiplier: float, threshold: Column, spike_weight: float = 4.0) -> Column:
    """M-08"""
    return S.spike_weight_factor(F.lit(float(multiplier)), F.col(metric) > threshold, spike_weight)


def target_scaler(df: DataFrame, key: str = "series_id") -> DataFrame:
    """M-01: mean and population deviation per series and metric; a constant metric scales by 1."""
    return (
        to_long(df)
        .groupBy(key, "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))
        .drop("std")
    )


def window_scaler(df: DataFrame, length: int, sequences_used: Column, key: str = "series_id") -> DataFrame:
    """M-01 for inputs: statistics over flattened overlapping windows.

    A row at position i lies in ``min(i, last) - max(0, i - length + 1) + 1`` of
    the windows that start at 0..last, so a weighted mean replaces the windows.
    """
    i, last = F.col("row_idx"), sequences_used - 1
    weight = F.greatest(F.least(i, last) - F.greatest(i - (length - 1), F.lit(0)) + 1, F.lit(0))
    rows = to_long(df.withColumn("_w", weight).filter(F.col("_w") > 0))
    means = rows.groupBy(key, "metric").agg(
        F.sum("_w").alias("weight"), (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("mean")
    )
    centred = lookup(rows, means, [key, "metric"])
    var = centred.groupBy(key, "metric", "mean", "weight").agg(
        (F.sum(F.col("_w") * F.pow(F.col("value") - F.col("mean"), F.lit(2))) / F.first("weight")).alias("_var")
    )
    return var.select(
        key, "metric", "weight", "mean", F.when(F.col("_var") > 0, F.sqrt("_var")).otherwise(F.lit(1.0)).alias("scale")
    )


def standardize(df: DataFrame, scaler: DataFrame, key: str = "series_id") -> DataFrame:
    """Long-form values to z-scores; the scaler has one row per series and metric."""
    return (
        lookup(to_long(df), scaler.select(key, "metric", "mean", "scale"), [key, "metric"])
        .withColumn("z", (F.col("value") - F.col("mean")) / F.col("scale"))
        .drop("mean", "scale")
    )
