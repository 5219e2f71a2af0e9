"""Streams over the given files, run to the end of what is there: ST-01 .. ST-05, SNK-04."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from catalog.base import query, r8, table, user_flows
from catalog.ingest import USER_FLOWS
from telespan.functions import scalar as S
from telespan.operators.quantile import exact_quantile
from telespan.scratch import scratch_path
from telespan.sources import flows
from telespan.streaming import live

BINS = """, b AS (SELECT series_id, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, sum(rate) / 1e6 AS traffic_mbps, avg(duration) AS latency_ms,
  100.0 * (count(*) FILTER (psh) + count(*) FILTER (rst)) / count(*) AS packet_loss_pct FROM user_flows GROUP BY 1, 2),
closed AS (SELECT * FROM b WHERE ts + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"""
EPOCH = "CAST(epoch(ts) AS BIGINT)"


class _Streamed:
    """Reads a table as a stream where a view builder expects ``spark.read``."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @property
    def read(self):
        return self

    def parquet(self, path):
        name = path.rsplit("/", 1)[1]
        return live.read_files(self.spark, self.sf, self.spark.read.parquet(path).schema, name)


def finished(spark, stream, label):
    """Run a stream over the present files into a folder and read the folder."""
    path = scratch_path(spark, label)
    run = live.append_telemetry(stream, path, scratch_path(spark, f"{label}-checkpoint"))
    run.awaitTermination()
    if n := live.dropped_rows(run):
        logging.getLogger(__name__).warning("%s: %d partial bins came after theirs had closed", label, n)
    return spark.read.schema(stream.schema).parquet(path)


def whole(spark, tracked, closing, label):
    """Run a stream over the present files to its end, with the rows that wait; late rows are counted."""
    out, late = live.finish(tracked, closing, scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint"))
    if n := late.count():
        logging.getLogger(__name__).warning("%s: %d rows came too late and are in the table of late rows", label, n)
    return out


def closed_bins(spark, sf):
    return live.flow_bins(user_flows(_Streamed(spark, sf), sf), 60)


@query("st01_snk04_streaming_bins", f"WITH {USER_FLOWS}{BINS} SELECT series_id, {EPOCH} AS timestamp, round(traffic_mbps, 8) AS traffic_mbps, round(latency_ms, 8) AS latency_ms, round(packet_loss_pct, 8) AS packet_loss_pct FROM closed")
def _(spark, sf):
    out = finished(spark, closed_bins(spark, sf), "bins")
    return r8(out.withColumn("timestamp", S.epoch_seconds("timestamp")))


@query(
    "st02_streaming_counter_rates",
    """WITH m AS (SELECT 'n' || (user_id % 16) AS node, ts, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN CAST(floor(value * 1000) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS total FROM events)
SELECT node, CAST(epoch_us(ts) AS BIGINT) AS ts_us, CAST(greatest(0, total - coalesce(lag(total) OVER (PARTITION BY node ORDER BY ts), total)) AS BIGINT) AS delta FROM m""",
)
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    messages = table(_Streamed(spark, sf), sf, "events").select(
        F.concat(F.lit("n"), (F.col("user_id") % 16).cast("string")).alias("node"),
        "ts",
        F.array(
            F.struct(
                F.concat(F.lit("eth"), (F.col("event_id") % 7).cast("string")).alias("iface"),
                F.floor(F.col("value") * 1000).alias("rx_bytes"),
                F.get_json_object("props", "$.k").try_cast("bigint").alias("tx_bytes"),
            )
        ).alias("interfaces"),
    )
    out = whole(spark, live.tracked_rates(live.node_samples(messages)), live.closing_rates, "rates")
    return out.select("node", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("ts_us"), "delta")


@query(
    "st03_streaming_alerts",
    f"WITH {USER_FLOWS}{BINS}, t AS (SELECT series_id, quantile_cont(traffic_mbps, 0.9) AS threshold FROM b GROUP BY 1) SELECT series_id, {EPOCH} AS timestamp, round(traffic_mbps, 8) AS traffic_mbps, round(threshold, 8) AS threshold FROM closed JOIN t USING (series_id) WHERE traffic_mbps > threshold",
)
def _(spark, sf):
    bins = flows.bin_flow_log(user_flows(spark, sf), 60)
    thresholds = exact_quantile(bins, ["series_id"], "traffic_mbps", 0.90)
    out = finished(spark, live.spike_alerts(closed_bins(spark, sf), thresholds), "alerts")
    return r8(out.select("series_id", S.epoch_seconds("timestamp").alias("timestamp"), "traffic_mbps", "threshold"))


@query(
    "st04_streaming_persistence",
    f"""WITH {USER_FLOWS}{BINS}, p AS (SELECT *, coalesce(lag(traffic_mbps) OVER w, traffic_mbps) AS predicted, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, {EPOCH} AS timestamp, round(predicted, 8) AS predicted, n, round(avg(abs(traffic_mbps - predicted)) OVER (PARTITION BY series_id ORDER BY ts), 8) AS running_mae FROM p""",
)
def _(spark, sf):
    """The stream reads a folder of telemetry, as an ingestion stream would write it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path = scratch_path(spark, "telemetry")
    bins = flows.bin_flow_log(user_flows(spark, sf), 60)
    bins.write.parquet(path)
    out = whole(spark, live.tracked_persistence(live.read_files(spark, path, bins.schema)), live.closing_persistence, "running")
    return r8(
        out.select("series_id", S.epoch_seconds(F.col("timestamp").cast("timestamp_ntz")).alias("timestamp"), "predicted", "n", "running_mae")
    )


RECORDS = """WITH r AS (SELECT event_id AS seq, event_type AS candidate_id, 'f' || (user_id % 23) AS data_fingerprint,
  CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS volatility, value AS quality_pct FROM events)"""


def refreshed(spark, sf):
    """The folder of partial policies of a stream of records."""
    records = table(_Streamed(spark, sf), sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("candidate_id"),
        F.concat(F.lit("f"), (F.col("user_id") % 23).cast("string")).alias("data_fingerprint"),
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("user_id") % 3 + 1).cast("int")).alias("volatility"),
        F.col("value").alias("quality_pct"),
    )
    partials = scratch_path(spark, "partials")
    live.refresh_policy(records, scratch_path(spark, "log"), partials, scratch_path(spark, "policy-checkpoint")).awaitTermination()
    return partials


@query("st05_policy_refresh", RECORDS + "SELECT candidate_id, round(avg(quality_pct), 8) AS mean_quality, count(*) AS attempts FROM r GROUP BY 1")
def _(spark, sf):
    return r8(live.current_policy(spark, refreshed(spark, sf)))


def group_sql(by):
    return RECORDS + f"SELECT {by}, arg_max(candidate_id, {{q: quality_pct, s: -seq}}) AS best_candidate, round(avg(quality_pct), 8) AS mean_quality, count(*) AS count FROM r GROUP BY 1"


@query("st05_fingerprint_refresh", group_sql("data_fingerprint"))
def _(spark, sf):
    return r8(live.current_group_policy(spark, refreshed(spark, sf), "data_fingerprint"))


@query("st05_volatility_refresh", group_sql("volatility"))
def _(spark, sf):
    return r8(live.current_group_policy(spark, refreshed(spark, sf), "volatility"))
