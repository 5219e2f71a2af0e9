"""Data model: metric names, fixed weights, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Metric names, their weights in overall scores, their units.
METRICS = ["traffic_mbps", "latency_ms", "packet_loss_pct"]
METRIC_WEIGHTS = {"traffic_mbps": 0.50, "latency_ms": 0.25, "packet_loss_pct": 0.25}
METRIC_UNITS = {"traffic_mbps": "Mbps", "latency_ms": "ms", "packet_loss_pct": "%"}
METRIC_ROLES = {
    "traffic_mbps": "primary load signal",
    "latency_ms": "delay under load",
    "packet_loss_pct": "congestion signal",
}
SPIKE_MULTIPLIERS = {"traffic_mbps": 1.0, "latency_ms": 1.8, "packet_loss_pct": 2.5}

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("traffic_mbps", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("packet_loss_pct", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

FLOW_LOG_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Flow Bytes/s", T.DoubleType()),
        T.StructField("Flow Duration", T.DoubleType()),
        T.StructField("PSH Flag Count", T.IntegerType()),
        T.StructField("RST Flag Count", T.IntegerType()),
    ]
)

FLOW_COUNT_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("l_ipn", T.StringType()),
        T.StructField("r_asn", T.LongType()),
        T.StructField("f", T.StringType()),
    ]
)

COUNTER_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("node", T.StringType()),
        T.StructField("iface", T.StringType()),
        T.StructField("rx_bytes", T.LongType()),
        T.StructField("tx_bytes", T.LongType()),
    ]
)

PROBE_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("node", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)

PER_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("model_mae", T.DoubleType()),
        T.StructField("baseline_mae", T.DoubleType()),
        T.StructField("mae_improvement_pct", T.DoubleType()),
        T.StructField("model_rmse", T.DoubleType()),
        T.StructField("baseline_rmse", T.DoubleType()),
        T.StructField("model_r2", T.DoubleType()),
        T.StructField("quality_pct", T.DoubleType()),
    ]
)

EXPERIENCE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("data_fingerprint", T.StringType()),
        T.StructField(
            "profile",
            T.StructType(
                [
                    T.StructField("usable_rows", T.LongType()),
                    T.StructField("volatility", T.StringType()),
                    T.StructField("traffic_spike_rate", T.DoubleType()),
                    T.StructField("traffic_std", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("candidate_args", T.ArrayType(T.StringType())),
        T.StructField("quality_pct", T.DoubleType()),
        T.StructField("gates_passed", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("per_feature", T.ArrayType(PER_METRIC_SCHEMA)),
        T.StructField("traffic_spike_f1", T.DoubleType()),
        T.StructField("mae_improvement_pct", T.DoubleType()),
        T.StructField("run_dir", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

RUN_SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField(
            "overall",
            T.StructType(
                [
                    T.StructField("normalized_quality_pct", T.DoubleType()),
                    T.StructField("mae_improvement_vs_persistence_pct", T.DoubleType()),
                    T.StructField("final_training_loss", T.DoubleType()),
                    T.StructField("epochs", T.LongType()),
                    T.StructField("rows", T.LongType()),
                    T.StructField("test_samples", T.LongType()),
                ]
            ),
        ),
        T.StructField("per_feature", T.ArrayType(PER_METRIC_SCHEMA)),
        T.StructField("gates_passed", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("benchmark", T.StructType([T.StructField("artifact", T.StringType())])),
    ]
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P-01: fail on the driver, before any job, when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def metric_lookup(values: dict[str, float | str], metric: Column | str = "metric") -> Column:
    """A per-metric constant as a CASE expression: no join for a three-row dimension."""
    metric = F.col(metric) if isinstance(metric, str) else metric
    expr = None
    for name, value in values.items():
        expr = F.when(metric == name, F.lit(value)) if expr is None else expr.when(metric == name, F.lit(value))
    return expr


def metric_weight(metric: Column | str = "metric") -> Column:
    return metric_lookup(METRIC_WEIGHTS, metric)
