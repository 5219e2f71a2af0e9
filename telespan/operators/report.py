"""Tables behind the reports: A-25 .. A-29, W-15, P-25."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telespan.functions.scalar import any_spike, epoch_seconds
from telespan.model import METRIC_ROLES, METRICS, metric_lookup
from telespan.operators.evaluation import KEYS
from telespan.operators.forecasts import to_long
from telespan.operators.layout import lookup, windowed
from telespan.operators.quantile import exact_quantile

DEFAULT_STEP_SECONDS = 3600


def sampling_step(df: DataFrame) -> DataFrame:
    """W-15: the most frequent gap of a series, smallest on ties; one hour when there is none."""
    gaps = windowed(
        df, {"gap": lambda w: epoch_seconds("timestamp") - F.lag(epoch_seconds("timestamp")).over(w)}, 1
    )
    counted = gaps.groupBy("series_id", "gap").agg(F.count("gap").alias("_n"))
    return counted.groupBy("series_id").agg(
        F.coalesce(
            F.max_by("gap", F.when(F.col("gap").isNotNull(), F.struct("_n", -F.col("gap")))),
            F.lit(DEFAULT_STEP_SECONDS),
        ).alias("step_seconds")
    )


def wide_thresholds(thresholds: DataFrame) -> DataFrame:
    """One threshold column per metric: three rows per series become one."""
    return thresholds.groupBy("series_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("threshold"))).alias(f"{m}_threshold") for m in METRICS]
    )


def spike_rows(df: DataFrame, thresholds: DataFrame, only_spikes: bool = True) -> DataFrame:
    """P-16, P-17, P-25: flags per metric and for any metric, positions kept."""
    out = lookup(df, wide_thresholds(thresholds), ["series_id"])
    pairs = [(F.col(m), F.col(f"{m}_threshold")) for m in METRICS]
    out = out.withColumns(
        {**{f"{m}_spike": F.col(m) > F.col(f"{m}_threshold") for m in METRICS}, "any_spike": any_spike(pairs)}
    )
    return out.filter("any_spike") if only_spikes else out


def predicted_spikes(forecasts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """P-25: positions where a forecast passes its threshold."""
    t = thresholds.select("series_id", "metric", "threshold")
    return lookup(forecasts, t, ["series_id", "metric"]).filter(F.col("predicted") > F.col("threshold"))


def correlations(df: DataFrame) -> DataFrame:
    """A-25: three pairs in one aggregate, cheaper than a matrix; undefined pairs count as 0."""
    pairs = {
        "traffic_latency": ("traffic_mbps", "latency_ms"),
        "traffic_loss": ("traffic_mbps", "packet_loss_pct"),
        "latency_loss": ("latency_ms", "packet_loss_pct"),
    }
    agg = df.groupBy("series_id").agg(
        *[F.coalesce(F.nanvl(F.corr(a, b), F.lit(None)), F.lit(0.0)).alias(n) for n, (a, b) in pairs.items()]
    )
    return agg.withColumn("max_abs", F.greatest(*[F.abs(n) for n in pairs]))


def describe(df: DataFrame) -> DataFrame:
    """A-26 with exact quartiles."""
    rows = to_long(df).select("series_id", "row_idx", "metric", "value")
    out = rows.groupBy("series_id", "metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    for name, q in (("q25", 0.25), ("q50", 0.50), ("q75", 0.75)):
        out = out.join(exact_quantile(rows, ["series_id", "metric"], "value", q, name), ["series_id", "metric"])
    return out


def feature_relevance(df: DataFrame) -> DataFrame:
    """A-27"""
    return (
        to_long(df)
        .groupBy("series_id", "metric")
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
        .withColumn("role", metric_lookup(METRIC_ROLES))
    )


def _histogram(errors: DataFrame, bins: int) -> DataFrame:
    """Equal-width counts; the maximum falls in the last bin. The extent is a small per-key table."""
    extent = errors.groupBy(*KEYS).agg(F.min("error").alias("_lo"), F.max("error").alias("_hi"), F.count("error").alias("n"))
    # A single value gets a unit-wide range around it, as numpy does.
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    placed = lookup(errors, extent.select(*KEYS, lo.alias("_lo"), hi.alias("_hi"), "n"), KEYS)
    # Rounding keeps values on a bin edge in the upper bin whatever the last bits of the division are.
    position = F.round((F.col("error") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins), 9)
    bucket = F.least(F.floor(position), F.lit(bins - 1)).cast("int")
    return placed.groupBy(*KEYS, "_lo", "_hi", "n", bucket.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def error_histogram(forecasts: DataFrame, bins: int = 30) -> DataFrame:
    """A-28, raw errors; empty bins are left out."""
    errors = forecasts.select(*KEYS, "row_idx", (F.col("predicted") - F.col("actual")).alias("error"))
    return _histogram(errors, bins).select(*KEYS, "bin", "rows")


def normalized_errors(forecasts: DataFrame) -> DataFrame:
    std = forecasts.groupBy(*KEYS).agg(F.greatest(F.stddev_pop("actual"), F.lit(1e-9)).alias("_std"))
    return lookup(forecasts, std, KEYS).select(*KEYS, "row_idx", ((F.col("predicted") - F.col("actual")) / F.col("_std")).alias("error"))


def error_density(forecasts: DataFrame, bins: int = 24) -> DataFrame:
    """A-28, errors over the deviation of the actual values, as a density."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    return _histogram(normalized_errors(forecasts), bins).select(
        *KEYS, "bin", (F.col("rows") / (F.col("n") * width)).alias("density")
    )


def error_limit(forecasts: DataFrame, q: float = 0.95) -> DataFrame:
    """A-28: axis limit, at least 0.1, over all metrics of a method."""
    errors = normalized_errors(forecasts).select("series_id", "method", "row_idx", F.abs("error").alias("error"))
    return exact_quantile(errors, ["series_id", "method"], "error", q, "error_limit").withColumn(
        "error_limit", F.greatest("error_limit", F.lit(0.1))
    )


def spike_summary(forecasts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A-29"""
    error = F.col("predicted") - F.col("actual")
    joined = lookup(forecasts, thresholds.select("series_id", "metric", "threshold"), ["series_id", "metric"])
    return joined.groupBy(*KEYS, "threshold").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        F.count_if(F.col("predicted") > F.col("threshold")).alias("spikes"),
    )
