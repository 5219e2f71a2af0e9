"""SRC-07 / SRC-08: interface counters and ping texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telespan.functions.scalar import round3
from telespan.operators.layout import index_rows, windowed

# Counted interfaces, the node probes are aimed at, ping text patterns.
INTERFACES = ["eth1", "eth2", "eth3", "eth4", "eth5"]
REFERENCE_NODE_SUFFIX = "spine1"
LOSS_PATTERN = r"(\d+(?:\.\d+)?)%\s*packet loss"
RTT_PATTERN = r"(?:rtt|round-trip).*?=\s*([\d.]+)/([\d.]+)/"


def parse_interface_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Counter listing, one line per interface, to rows. Received bytes come first, sent bytes ninth."""
    line = df.withColumn("_line", F.explode(F.split(text, "\n"))).filter(F.col("_line").contains(":"))
    parts = F.filter(F.split(F.element_at(F.split("_line", ":", 2), 2), r"\s+"), lambda p: p != "")
    rows = line.withColumn("_p", parts).filter(F.size("_p") >= 16)
    return rows.select(
        *[c for c in df.columns if c != text],
        F.trim(F.element_at(F.split("_line", ":", 2), 1)).alias("iface"),
        F.col("_p")[0].try_cast("bigint").alias("rx_bytes"),
        F.col("_p")[8].try_cast("bigint").alias("tx_bytes"),
    )


def node_totals(df: DataFrame) -> DataFrame:
    """Bytes over the counted interfaces, per node and sample time."""
    return (
        df.filter(F.col("iface").isin(INTERFACES))
        .groupBy("node", "ts")
        .agg(F.sum(F.col("rx_bytes") + F.col("tx_bytes")).alias("total"))
        .filter(F.col("total").isNotNull())
    )


def traffic_rate(df: DataFrame, interval_seconds: int) -> DataFrame:
    """SRC-07: the last known total of a node is its base; a reset counts as 0; nodes are summed."""
    ordered = index_rows(node_totals(df), ["node"], ["ts"], "counters")
    delta = windowed(
        ordered,
        {"delta": lambda w: F.greatest(F.lit(0), F.col("total") - F.coalesce(F.lag("total").over(w), F.col("total")))},
        1,
        keys=["node"],
    )
    mbps = F.sum("delta") * 8 / F.greatest(F.lit(1.0), F.lit(interval_seconds * 1_000_000.0))
    return delta.groupBy(F.col("ts").alias("timestamp")).agg(round3(mbps).alias("traffic_mbps"))


def parse_probe(df: DataFrame) -> DataFrame:
    """Average round trip and loss of a ping text; NULL where the text has none."""
    return df.withColumns(
        {
            "avg_rtt": F.nullif(F.regexp_extract("output", RTT_PATTERN, 2), F.lit("")).try_cast("double"),
            "loss_pct": F.nullif(F.regexp_extract("output", LOSS_PATTERN, 1), F.lit("")).try_cast("double"),
        }
    )


def probe_means(df: DataFrame) -> DataFrame:
    """SRC-08: means over all nodes but the reference node; 0.0 when no probe answered."""
    return (
        parse_probe(df.filter(~F.col("node").endswith(REFERENCE_NODE_SUFFIX)))
        .groupBy(F.col("ts").alias("timestamp"))
        .agg(
            F.coalesce(F.avg("avg_rtt"), F.lit(0.0)).alias("latency_ms"),
            F.coalesce(F.avg("loss_pct"), F.lit(0.0)).alias("packet_loss_pct"),
        )
    )


def live_telemetry(counters: DataFrame, probes: DataFrame, interval_seconds: int) -> DataFrame:
    """Counters and probes of the same sample times as one telemetry table."""
    return (
        traffic_rate(counters, interval_seconds)
        .join(probe_means(probes), "timestamp", "left")
        .select(
            "timestamp",
            "traffic_mbps",
            round3(F.coalesce("latency_ms", F.lit(0.0))).alias("latency_ms"),
            round3(F.coalesce("packet_loss_pct", F.lit(0.0))).alias("packet_loss_pct"),
        )
    )
