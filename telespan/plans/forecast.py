"""M-12, M-13: forecasts beyond the last row of every series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from telespan.functions import scalar as S
from telespan.model import METRICS
from telespan.operators.features import CALENDAR_FEATURES, ROLL_WINDOWS, feature_names
from telespan.operators.report import sampling_step
from telespan.scratch import materialize

STEPS_PER_TABLE = 8


def last_state(rows: DataFrame, length: int) -> DataFrame:
    """One row per series: last time and the last ``length`` values per metric, newest first.

    Only those rows leave the scan, so a long series adds ``length`` rows to the shuffle.
    """
    tail = rows.filter(F.col("row_idx") >= F.col("n_rows") - length)
    newest_first = F.sort_array(F.collect_list(F.struct("row_idx", *METRICS)), asc=False)
    return (
        tail.groupBy("series_id")
        .agg(newest_first.alias("_h"), F.max("timestamp").alias("last_time"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == length)
        .select(
            "series_id",
            "last_time",
            *[F.transform("_h", (lambda m: lambda r: r[m])(m)).alias(f"h_{m}") for m in METRICS],
        )
    )


def future_times(rows: DataFrame, steps: int) -> DataFrame:
    """M-13: the next times of each series at its own sampling step."""
    last = rows.groupBy("series_id").agg(F.max("timestamp").alias("last_time"))
    return (
        last.join(sampling_step(rows), "series_id")
        .withColumn("step_no", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .select("series_id", "step_no", advance(F.col("last_time"), F.col("step_no")).alias("timestamp"))
    )


def advance(last: Column, steps: Column) -> Column:
    return last + F.make_interval(secs=(F.col("step_seconds") * steps).cast("decimal(18,6)"))


def next_features(look_back: int) -> dict[str, Column]:
    """Features of the row after the state, so step 1 predicts the next row."""
    out = {**S.calendar("timestamp"), "is_weekend": S.is_weekend("timestamp")}
    for m in METRICS:
        past = F.col(f"h_{m}")
        for i in range(look_back):
            out[f"{m}_lag_{i + 1}"] = F.get(past, F.lit(i))
        for n in ROLL_WINDOWS:
            if n > look_back:
                continue
            last_n = F.slice(past, 1, n)
            mean = F.aggregate(last_n, F.lit(0.0), lambda a, x: a + x) / n
            out[f"{m}_roll_mean_{n}"] = mean
            out[f"{m}_roll_max_{n}"] = F.array_max(last_n)
            spread = F.aggregate(F.transform(last_n, (lambda mu: lambda x: (x - mu) * (x - mu))(mean)), F.lit(0.0), lambda a, x: a + x)
            out[f"{m}_roll_std_{n}"] = F.sqrt(spread / (n - 1))
        out[f"{m}_delta_1"] = F.get(past, F.lit(0)) - F.get(past, F.lit(1))
    return out


def recursive_forecast(rows: DataFrame, models: dict[str, Model], look_back: int, steps: int) -> DataFrame:
    """M-12: ``steps`` forecasts per series, each fed back as the newest value.

    The state is one row per series, whatever its length. Every step is one
    distributed transform; after a few steps the state is written out, which
    keeps plans short and lets a lost executor restart from the table. Linear
    models need no transform: all steps of a series run where its row is.
    """
    length = max(look_back, max(w for w in ROLL_WINDOWS if w <= look_back))
    state = last_state(rows, length).join(sampling_step(rows), "series_id")
    if all(isinstance(models[m], LinearRegressionModel) for m in METRICS):
        return materialize(_linear_steps(state, models, look_back, steps), "forecast-steps")
    state = state.withColumn("done", F.array().cast("array<struct<step_no:int,timestamp:timestamp_ntz,traffic_mbps:double,latency_ms:double,packet_loss_pct:double>>"))
    assemble = VectorAssembler(inputCols=feature_names(look_back), outputCol="features")
    kept = ["series_id", "last_time", "step_seconds", "done", *[f"h_{m}" for m in METRICS]]
    for step in range(1, steps + 1):
        state = state.withColumn("timestamp", advance(F.col("last_time"), F.lit(step)))
        state = assemble.transform(state.withColumns(next_features(look_back))).select(*kept, "timestamp", "features")
        for m in METRICS:
            state = models[m].transform(state)
        made = F.struct(
            F.lit(step).alias("step_no"), "timestamp", *[S.clip(f"predicted_{m}").alias(m) for m in METRICS]
        )
        state = state.withColumns(
            {
                "done": F.concat("done", F.array(made)),
                **{
                    f"h_{m}": F.slice(F.concat(F.array(S.clip(f"predicted_{m}")), f"h_{m}"), 1, length) for m in METRICS
                },
            }
        ).select(*kept)
        if step % STEPS_PER_TABLE == 0 and step < steps:
            state = materialize(state, "forecast-state")
    return state.select("series_id", F.inline("done"))


def _linear_steps(state: DataFrame, models: dict[str, Model], look_back: int, steps: int) -> DataFrame:
    """All steps of a batch of series at once, by the coefficients of the models."""
    slopes = np.column_stack([models[m].coefficients.toArray() for m in METRICS])
    intercepts = np.array([models[m].intercept for m in METRICS])
    windows = [w for w in ROLL_WINDOWS if w <= look_back]
    past = [f"h_{m}" for m in METRICS]
    times = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: advance(F.col("last_time"), i))
    calendar = lambda t: F.struct(*[c.alias(n) for n, c in (S.calendar(t) | {"is_weekend": S.is_weekend(t)}).items()])
    ready = state.select("series_id", times.alias("times"), *past).withColumn("calendar", F.transform("times", calendar))

    def features(values: np.ndarray, day: np.ndarray) -> np.ndarray:
        """As :func:`next_features`, in the order of ``feature_names``; ``values`` by series, metric and age."""
        columns = [day]
        for k in range(len(METRICS)):
            lags = values[:, k]
            columns.append(lags[:, :look_back])
            for w in windows:
                last = lags[:, :w]
                columns += [last.mean(axis=1)[:, None], last.std(axis=1, ddof=1)[:, None], last.max(axis=1)[:, None]]
            columns.append((lags[:, 0] - lags[:, 1])[:, None])
        return np.hstack(columns)

    def ran(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = lambda c: batch.column(c).flatten()
            values = np.stack([flat(c).to_numpy(zero_copy_only=False).reshape(n, -1) for c in past], axis=1)
            days = flat("calendar")
            days = np.column_stack([days.field(c).to_numpy(zero_copy_only=False) for c in CALENDAR_FEATURES]).reshape(n, steps, -1)
            out = np.empty((n, steps, len(METRICS)))
            for i in range(steps):
                x = features(values, days[:, i])
                if np.isnan(x).any():
                    raise ValueError("a feature of the next row has no value")
                out[:, i] = np.maximum(x @ slopes + intercepts, 0.0)
                values = np.concatenate([out[:, i, :, None], values[:, :, :-1]], axis=2)
            series = batch.column("series_id").take(pa.array(np.repeat(np.arange(n), steps)))
            numbers = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n))
            found = [pa.array(out[:, :, k].ravel()) for k in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([series, numbers, flat("times"), *found], ["series_id", "step_no", "timestamp", *METRICS])

    return ready.mapInArrow(ran, "series_id string, step_no int, timestamp timestamp_ntz, " + ", ".join(f"{m} double" for m in METRICS))


def with_bands(forecast: DataFrame, residual_std: DataFrame | None = None) -> DataFrame:
    """A-31 at forecast time: from stored widths (one column per metric), else a tenth of the mean forecast."""
    if residual_std is None:
        residual_std = forecast.groupBy("series_id").agg(*[(F.avg(F.abs(m)) * 0.10).alias(f"_{m}") for m in METRICS])
    out = forecast.join(residual_std, "series_id")
    bands = {}
    for m in METRICS:
        bands[f"{m}_lower_95"] = F.greatest(F.lit(0.0), F.col(m) - 1.96 * F.col(f"_{m}"))
        bands[f"{m}_upper_95"] = F.col(m) + 1.96 * F.col(f"_{m}")
    return out.withColumns(bands).drop(*[f"_{m}" for m in METRICS])
