"""A-24, A-25, P-20, P-21: a profile per series and the settings it suggests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telespan.functions import scalar as S
from telespan.model import METRIC_WEIGHTS, METRICS
from telespan.operators.layout import CHUNK_ROWS, lookup, windowed
from telespan.operators.quantile import exact_quantile

MIN_ROWS = 120
CORRELATION_LIMIT = 0.95


def profile_series(
    rows: DataFrame, train_ratio: float = 0.70, test_ratio: float = 0.82, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """All series in one job: one windowed pass, one quantile, one small count.

    Series under 120 rows are left out; :func:`telespan.sources.telemetry.rejected` lists them.
    """
    n, at = F.col("n_rows"), F.col("row_idx")
    train = F.greatest(F.lit(10), F.least(n - 2, F.floor(n * F.lit(train_ratio))))
    val_end = F.greatest(train + 2, F.least(n, F.floor(n * F.lit(test_ratio))))
    previous = {f"_{m}": (lambda m: lambda w: F.lag(m).over(w))(m) for m in METRICS}
    usable = (
        windowed(rows.filter(n >= MIN_ROWS), previous, 1, chunk_rows=chunk_rows)
        .withColumn("_train", at < train)
        .withColumn("_val", (at >= train) & (at < val_end))
    )
    threshold = exact_quantile(usable.filter("_train"), ["series_id"], "traffic_mbps", 0.90, "_threshold")
    spike = F.col("_train") & (F.col("traffic_mbps") > F.col("_threshold"))
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
    sums = (
        lookup(usable, threshold, ["series_id"])
        .groupBy("series_id", "n_rows")
        .agg(
            F.count_if("_train").alias("train_rows_est"),
            F.avg(F.when(F.col("_train"), F.col("traffic_mbps"))).alias("_mean"),
            *[
                F.stddev_pop(F.when(F.col("_train"), F.col(m))).alias(name)
                for m, name in zip(METRICS, ("traffic_std", "latency_std", "loss_std"))
            ],
            (F.count_if(spike) / F.count_if("_train")).alias("traffic_spike_rate"),
            *[F.avg(F.when(F.col("_val"), F.abs(F.col(m) - F.col(f"_{m}")))).alias(f"_mae_{m}") for m in METRICS],
            *[F.coalesce(F.nanvl(F.abs(F.corr(a, b)), F.lit(None)), F.lit(0.0)).alias(f"_r_{a}_{b}") for a, b in pairs],
        )
    )
    cv = F.col("traffic_std") / F.greatest("_mean", F.lit(1e-9))
    sequence = F.least(F.lit(96), F.greatest(F.lit(24), F.floor(n * F.lit(0.05))))
    weighted = sum((F.lit(METRIC_WEIGHTS[m]) * F.col(f"_mae_{m}") for m in METRICS), F.lit(0.0))
    strongest = F.greatest(*[F.col(f"_r_{a}_{b}") for a, b in pairs])
    trainer = (
        F.when((n >= 400) & (strongest > CORRELATION_LIMIT), "gb_only")
        .when((n < 400) | (weighted < 0.5), "gb_only")
        .when(cv > 0.6, "hybrid_aggressive")
        .otherwise("hybrid")
    )
    return sums.select(
        "series_id",
        n.alias("rows"),
        n.alias("usable_rows"),
        "train_rows_est",
        "traffic_std",
        "latency_std",
        "loss_std",
        "traffic_spike_rate",
        F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(f"_mae_{m}"))]).alias("persistence_mae"),
        S.volatility_class(cv).alias("volatility"),
        sequence.alias("recommended_sequence_length"),
        F.least(F.lit(24), F.greatest(F.lit(4), F.floor(sequence / 2))).alias("recommended_lookback"),
        F.when(F.col("traffic_spike_rate") < 0.05, 0.85).otherwise(0.90).alias("recommended_spike_quantile"),
        trainer.alias("recommended_trainer"),
        F.when(n < 1000, 40).otherwise(60).alias("recommended_epochs"),
    )


def with_fingerprint(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn(
        "data_fingerprint",
        S.fingerprint(
            F.col("usable_rows"), F.col("volatility"), F.col("traffic_spike_rate"), F.col("traffic_std")
        ),
    )
