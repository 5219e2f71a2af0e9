"""A-21 .. A-23: is a method better than persistence?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telespan.functions.stats import student_t_p
from telespan.model import METRICS
from telespan.operators.baselines import suffix
from telespan.operators.layout import CHUNK_ROWS, lookup, windowed

ZERO = 1e-8  # absolute tolerance below which paired differences count as equal


def paired_errors(forecasts: DataFrame, method: str, baseline: str = "Persistence") -> DataFrame:
    """Both error columns of one position, side by side (J-01), of forecasts that are rows of one table.

    Where both are columns of one table, :func:`paired_columns` needs no shuffle.
    """

    def of(name):
        return F.max(F.when(F.col("method") == name, F.col("actual") - F.col("predicted")))

    return (
        forecasts.filter(F.col("method").isin(method, baseline))
        .groupBy("series_id", "metric", "row_idx")
        .agg(of(method).alias("e_model"), of(baseline).alias("e_base"))
    )


def paired_columns(wide: DataFrame, method: str, baseline: str = "Persistence") -> DataFrame:
    """As :func:`paired_errors`, from a table with one forecast column per metric and method: one row in, three out."""
    entries = F.array(
        *[
            F.struct(
                F.lit(x).alias("metric"),
                (F.col(x) - F.col(f"{x}{suffix(method)}")).alias("e_model"),
                (F.col(x) - F.col(f"{x}{suffix(baseline)}")).alias("e_base"),
            )
            for x in METRICS
        ]
    )
    return wide.select("series_id", "row_idx", "n_rows", F.inline(entries))


def _loss_difference(power: int) -> Column:
    return F.pow(F.abs("e_model"), F.lit(power)) - F.pow(F.abs("e_base"), F.lit(power))


def _dm_statistic(mean: str, variance: str, h: int) -> tuple[Column, Column]:
    """Statistic with the small-sample correction, and whether it is defined."""
    n, usable = F.col("n"), F.coalesce(F.col(variance) > 0, F.lit(False))
    correction = F.sqrt(F.greatest((n + 1 - 2 * h + (h * (h - 1)) / n) / n, F.lit(0.0)))
    statistic = F.col(mean) / F.sqrt(F.when(usable, F.col(variance)) / n) * correction
    return F.when(usable, statistic).otherwise(F.lit(0.0)), usable


def diebold_mariano(pairs: DataFrame, h: int = 1, power: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A-21 with ``h - 1`` lag terms and the small-sample correction.

    Lags look back at most ``h - 1`` rows, so they run over chunks too. Without
    lags the test is one aggregate. A series needs two rows.
    """
    rows = pairs.withColumn("d", _loss_difference(power)).drop("e_model", "e_base")
    if h > 1:
        if "n_rows" not in rows.columns:
            sizes = rows.groupBy("series_id", "metric").agg(F.count(F.lit(1)).alias("n_rows"))
            rows = lookup(rows, sizes, ["series_id", "metric"])
        lags = {f"d{k}": (lambda k: lambda w: F.lag("d", k).over(w))(k) for k in range(1, h)}
        rows = windowed(rows, lags, h - 1, ["series_id", "metric"], chunk_rows)
    variance = F.var_pop("d")
    for k in range(1, h):
        variance = variance + F.coalesce(2.0 * (1.0 - k / h) * F.covar_pop("d", f"d{k}"), F.lit(0.0))
    stats = rows.groupBy("series_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("_mean"), variance.alias("_var")
    )
    statistic, usable = _dm_statistic("_mean", "_var", h)
    return stats.filter(F.col("n") >= 2).select(
        "series_id", "metric", "n", statistic.alias("dm_stat"), usable.alias("_usable")
    )


def _t_sums() -> list[Column]:
    diff = F.abs("e_model") - F.abs("e_base")
    return [F.avg(diff).alias("_t_mean"), F.stddev_samp(diff).alias("_t_std"), F.max(F.abs(diff)).alias("_t_top")]


def _t_statistic() -> tuple[Column, Column]:
    usable = F.coalesce((F.col("_t_top") > ZERO) & (F.col("_t_std") > 0), F.lit(False))
    statistic = F.col("_t_mean") / (F.when(usable, F.col("_t_std")) / F.sqrt("n"))
    return F.when(usable, statistic).otherwise(F.lit(0.0)), usable


def paired_t_test(pairs: DataFrame) -> DataFrame:
    """A-22 on absolute errors; equal errors give 0."""
    stats = pairs.groupBy("series_id", "metric").agg(F.count(F.lit(1)).alias("n"), *_t_sums())
    statistic, usable = _t_statistic()
    return stats.select("series_id", "metric", "n", statistic.alias("t_stat"), usable.alias("_usable"))


def with_p_value(stats: DataFrame, statistic: str, name: str) -> DataFrame:
    """F-03: p = 1 where the statistic is undefined."""
    p = student_t_p(F.when(F.col("_usable"), F.col(statistic)), F.col("n") - 1)
    return stats.withColumn(name, p).drop("_usable")


def significance(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A-23 per series and metric: both tests from one aggregate over the paired errors."""
    d = _loss_difference(2)
    stats = pairs.groupBy("series_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("_mean"), F.var_pop(d).alias("_var"), *_t_sums()
    )
    (dm, dm_usable), (t, t_usable) = _dm_statistic("_mean", "_var", 1), _t_statistic()
    degrees = F.col("n") - 1
    tested = (
        stats.filter(F.col("n") >= 2)
        .withColumns({"_dm": dm, "_t": t, "_dm_usable": dm_usable, "_t_usable": t_usable})
        .withColumns(
            {
                "_dm_p": student_t_p(F.when(F.col("_dm_usable"), F.col("_dm")), degrees),
                "_t_p": student_t_p(F.when(F.col("_t_usable"), F.col("_t")), degrees),
            }
        )
    )
    return tested.select(
        "series_id",
        F.col("metric").alias("feature"),
        F.col("_dm").alias("diebold_mariano_stat"),
        F.col("_dm_p").alias("diebold_mariano_p_value"),
        (F.col("_dm_p") < alpha).cast("int").alias("dm_significant"),
        F.col("_t").alias("paired_t_stat"),
        F.col("_t_p").alias("paired_t_p_value"),
        (F.col("_t_p") < alpha).cast("int").alias("t_significant"),
    )
