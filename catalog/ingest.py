"""Scans and ingestion: SRC-*, P-01 .. P-15, A-01 .. A-03, A-36, SNK-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAY, LINKS, LINK_FLOWS, drawn, flow_counts, link_flows, link_telemetry, query, r8, table, user_flows
from telespan.functions import scalar as S
from telespan.operators.layout import index_rows
from telespan.sources import counters, flows, telemetry, writers

EPOCH = "CAST(epoch(ts) AS BIGINT)"


def stamped(df, name="timestamp"):
    return df.withColumn(name, S.epoch_seconds(name))


RAW = """
raw AS (
  SELECT 'p' || l_suppkey AS series_id,
         CASE WHEN l_linenumber = 7 THEN 'not a time' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS txt,
         CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 AND l_tax > 0.04 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS traffic_mbps,
         l_discount AS latency_ms, l_tax AS packet_loss_pct, l_orderkey, l_linenumber FROM lineitem),
usable AS (
  SELECT *, try_cast(txt AS TIMESTAMP) AS ts FROM raw
  WHERE try_cast(txt AS TIMESTAMP) IS NOT NULL AND traffic_mbps IS NOT NULL AND NOT isnan(traffic_mbps))"""


def raw_telemetry(spark, sf):
    """Telemetry with unreadable times, nulls and NaN, made from line items."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("series_id"),
        F.when(F.col("l_linenumber") == 7, "not a time")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("timestamp"),
        F.when(F.col("l_linenumber") == 6, F.lit(None))
        .when((F.col("l_linenumber") == 5) & (F.col("l_tax") > 0.04), F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
        .alias("traffic_mbps"),
        F.col("l_discount").alias("latency_ms"),
        F.col("l_tax").alias("packet_loss_pct"),
        "l_orderkey",
        "l_linenumber",
    )


@query(
    "src01_telemetry_scan",
    f"""WITH {RAW},
enough AS (SELECT series_id FROM usable GROUP BY 1 HAVING count(*) >= 390)
SELECT series_id, {EPOCH} AS timestamp, l_orderkey, l_linenumber, traffic_mbps, latency_ms, packet_loss_pct, CAST(hour(ts) AS INT) AS hour,
       CAST(isodow(ts) - 1 AS INT) AS day_of_week, round(sin(2*pi()*hour(ts)/24), 8) AS hour_sin, round(cos(2*pi()*hour(ts)/24), 8) AS hour_cos,
       round(sin(2*pi()*(isodow(ts)-1)/7), 8) + 0.0 AS weekday_sin, round(cos(2*pi()*(isodow(ts)-1)/7), 8) AS weekday_cos
FROM usable SEMI JOIN enough USING (series_id)""",
)
def _(spark, sf):
    out = telemetry.scan(raw_telemetry(spark, sf), min_rows=390)
    return r8(stamped(out))


@query(
    "src02_telemetry_clean",
    f"""WITH {RAW} SELECT series_id, {EPOCH} AS timestamp, l_orderkey, l_linenumber, traffic_mbps, latency_ms, packet_loss_pct FROM usable""",
)
def _(spark, sf):
    return stamped(telemetry.clean(raw_telemetry(spark, sf)))


@query(
    "p26_rejected_series",
    f"WITH {RAW} SELECT series_id, count(*) AS n_rows FROM usable GROUP BY 1 HAVING count(*) < 390",
)
def _(spark, sf):
    return telemetry.rejected(raw_telemetry(spark, sf), min_rows=390)


@query(
    "a36_cleaning_counts",
    f"""WITH {RAW}
SELECT series_id, count(*) AS rows_read, count(*) FILTER (traffic_mbps IS NOT NULL AND NOT isnan(traffic_mbps)) AS rows_with_metrics,
       count(*) FILTER (traffic_mbps IS NOT NULL AND NOT isnan(traffic_mbps) AND try_cast(txt AS TIMESTAMP) IS NOT NULL) AS rows_usable,
       round(count(*) FILTER (traffic_mbps IS NOT NULL AND NOT isnan(traffic_mbps) AND try_cast(txt AS TIMESTAMP) IS NOT NULL) / count(*), 8) AS usable_rate
FROM raw GROUP BY 1""",
)
def _(spark, sf):
    return r8(telemetry.quality_counts(raw_telemetry(spark, sf)))


@query(
    "t01_row_positions",
    f"WITH {LINKS} SELECT series_id, {EPOCH} AS timestamp, row_idx, n_rows FROM tele",
)
def _(spark, sf):
    out = index_rows(link_telemetry(spark, sf), ["series_id"], ["timestamp"], "links")
    return stamped(out.select("series_id", "timestamp", "row_idx", "n_rows"))


# ---- flow logs ----

USER_FLOWS = """
user_flows AS (
  SELECT 's' || (user_id % 8) AS series_id, ts, value * 1e6 AS rate, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS duration,
         event_type = 'error' AS psh, event_type = 'signup' AS rst FROM events)"""


def bins(source, minutes, series="series_id"):
    return f"""
SELECT {series} AS series_id, CAST(epoch(time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS timestamp,
       round(sum(rate) / 1e6, 8) AS traffic_mbps, round(avg(duration), 8) AS latency_ms,
       round(100.0 * (count(*) FILTER (psh) + count(*) FILTER (rst)) / count(*), 8) AS packet_loss_pct
FROM {source} GROUP BY 1, 2"""


@query("src04_flow_log_minutes", f"WITH {USER_FLOWS} {bins('user_flows', 1)}")
def _(spark, sf):
    return r8(stamped(flows.bin_flow_log(user_flows(spark, sf), 1)))


@query("a03_flow_log_hours", f"WITH {USER_FLOWS} {bins('user_flows', 60)}")
def _(spark, sf):
    return r8(stamped(flows.bin_flow_log(user_flows(spark, sf), 60)))


@query(
    "a03_flow_log_single_series",
    "WITH " + USER_FLOWS + bins("user_flows", 60, "'all'"),
)
def _(spark, sf):
    return r8(stamped(flows.bin_flow_log(user_flows(spark, sf, None), 60)))


@query("a03_link_days", f"WITH {LINK_FLOWS} {bins('link_flows', DAY)}")
def _(spark, sf):
    return r8(stamped(link_telemetry(spark, sf)))


@query(
    "a03_bits_and_clip",
    f"""WITH {LINK_FLOWS}
SELECT series_id, {EPOCH} AS timestamp, round(traffic_mbps, 8) AS traffic_mbps, round(latency_ms, 8) AS latency_ms, packet_loss_pct FROM (
  SELECT series_id, date_trunc('hour', ts) AS ts, 8 * sum(rate) / 1e6 AS traffic_mbps, avg(duration) AS latency_ms,
         round(least(100, 100.0 * (count(*) FILTER (psh) + count(*) FILTER (rst)) / count(*)), 8) AS packet_loss_pct
  FROM link_flows GROUP BY ALL)""",
)
def _(spark, sf):
    out = flows.bin_flow_log(link_flows(spark, sf), 60, bits=True, clip_loss=True)
    return r8(stamped(out))


@query(
    "p03_p04_coercion",
    """SELECT count(*) AS n, count(try_cast(txt AS TIMESTAMP)) AS times, count(try_cast(num AS DOUBLE)) FILTER (isfinite(try_cast(num AS DOUBLE))) AS numbers,
  round(sum(CASE WHEN isfinite(try_cast(num AS DOUBLE)) THEN try_cast(num AS DOUBLE) END), 2) AS total FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'x' || event_type ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt,
         CASE event_type WHEN 'error' THEN 'bad' WHEN 'click' THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS num FROM events)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    num = (
        F.when(F.col("event_type") == "error", "bad")
        .when(F.col("event_type") == "click", "Infinity")
        .otherwise(F.col("value").cast("string"))
    )
    return e.select(S.parse_timestamp(txt).alias("t"), S.parse_number(num).alias("x")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("t").alias("times"),
        F.count("x").alias("numbers"),
        F.round(F.sum("x"), 2).alias("total"),
    )


@query(
    "src05_first_rows",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events ORDER BY events.ts, event_id LIMIT 500",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    return stamped(telemetry.first_rows(rows, 500, ["ts", "event_id"]), "ts")


@query(
    "src05_seeded_sample",
    f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events ORDER BY {drawn(42, 'event_id')}, event_id LIMIT 500",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    return stamped(telemetry.sample_rows(rows, 500, ["event_id"], seed=42), "ts")


# ---- flow counts ----

PROFILE = """
profile AS (
  SELECT l_suppkey AS l_ipn, l_shipdate AS date, l_linenumber AS r_asn, sum(l_quantity) AS f FROM lineitem GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY l_ipn ORDER BY date, r_asn) - 1 AS tie,
         row_number() OVER (PARTITION BY l_ipn, date ORDER BY r_asn) - 1 AS offset_min,
         (f - min(f) OVER (PARTITION BY l_ipn)) / nullif(max(f) OVER (PARTITION BY l_ipn) - min(f) OVER (PARTITION BY l_ipn), 0) AS n0 FROM profile),
mapped AS (
  SELECT CAST(l_ipn AS VARCHAR) AS series_id, date + to_minutes(offset_min) AS ts, tie, coalesce(n0, 0) AS n, 10.0 + 140.0 * coalesce(n0, 0) AS traffic FROM placed),
high AS (SELECT series_id, quantile_cont(traffic, 0.88) AS h FROM mapped GROUP BY 1),
counts AS (
  SELECT series_id, ts, tie, round_even(traffic * 1000, 0) / 1000 AS traffic_mbps,
         round_even(greatest(0.5, 2.0 + n * 14.0) * 1000, 0) / 1000 AS latency_ms,
         round_even(CASE WHEN traffic > h THEN least(100, 0.2 + 2.3 * n) ELSE 0 END * 1000, 0) / 1000 AS packet_loss_pct
  FROM mapped JOIN high USING (series_id))"""


@query(
    "a01_flow_sums",
    "SELECT l_suppkey AS l_ipn, CAST(epoch(l_shipdate) AS BIGINT) AS date, CAST(l_linenumber AS BIGINT) AS r_asn, sum(l_quantity) AS f FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    return stamped(flows.sum_flows(flows.clean_flow_counts(flow_counts(spark, sf))), "date")


@query("a02_u04_workstations", "SELECT l_suppkey AS l_ipn, count(*) AS rows FROM lineitem GROUP BY 1")
def _(spark, sf):
    return flows.workstations(flow_counts(spark, sf))


@query(
    "a02_most_active",
    "SELECT l_suppkey AS l_ipn FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 1",
)
def _(spark, sf):
    return flows.most_active(flow_counts(spark, sf))


@query(
    "src03_flow_counts",
    f"""WITH {PROFILE} SELECT series_id, {EPOCH} AS timestamp, tie, traffic_mbps, latency_ms, packet_loss_pct,
  'flow-converted:l_ipn=' || series_id AS source FROM counts""",
)
def _(spark, sf):
    return stamped(flows.telemetry_from_counts(flow_counts(spark, sf)))


@query(
    "src03_most_active",
    f"""WITH {PROFILE} SELECT series_id, {EPOCH} AS timestamp, tie, traffic_mbps, latency_ms, packet_loss_pct,
  'flow-converted:auto_most_active_l_ipn=' || series_id AS source FROM counts
  WHERE series_id = (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 1)""",
)
def _(spark, sf):
    return stamped(flows.telemetry_from_counts(flow_counts(spark, sf), only="most_active"))


@query(
    "w04_deltas",
    f"""WITH {PROFILE}
SELECT series_id, tie, round_even(coalesce(traffic_mbps - lag(traffic_mbps) OVER w, 0) * 1000, 0) / 1000 + 0.0 AS traffic_delta,
       round_even(coalesce(latency_ms - lag(latency_ms) OVER w, 0) * 1000, 0) / 1000 + 0.0 AS latency_delta
FROM counts WINDOW w AS (PARTITION BY series_id ORDER BY ts, tie)""",
)
def _(spark, sf):
    out = flows.with_deltas(flows.telemetry_from_counts(flow_counts(spark, sf)))
    return out.select(
        "series_id",
        "tie",
        (F.col("traffic_delta") + 0.0).alias("traffic_delta"),
        (F.col("latency_delta") + 0.0).alias("latency_delta"),
    )


SLICED = f"""numbered AS (
  SELECT l_suppkey AS l_ipn, l_shipdate AS date, l_linenumber AS r_asn, sum(l_quantity) AS f FROM lineitem GROUP BY ALL),
starts AS (
  SELECT *, row_number() OVER (PARTITION BY l_ipn ORDER BY date, r_asn) - 1 AS place,
         {drawn(11, 'l_ipn')} % (greatest(count(*) OVER (PARTITION BY l_ipn) - 100, 0) + 1) AS start FROM numbered),
profile AS (SELECT l_ipn, date, r_asn, f FROM starts WHERE place >= start AND place < start + 100),
placed AS""" + PROFILE.split("placed AS", 1)[1]


@query(
    "w13_contiguous_slice",
    f"""WITH {SLICED} SELECT series_id, {EPOCH} AS timestamp, tie, traffic_mbps, latency_ms, packet_loss_pct,
  'flow-converted:l_ipn=' || series_id AS source FROM counts""",
)
def _(spark, sf):
    return stamped(flows.telemetry_from_counts(flow_counts(spark, sf), rows=100, seed=11))


@query(
    "snk05_threshold_sidecar",
    f"""WITH {PROFILE}, long AS (
  SELECT series_id, 'traffic_mbps' AS metric, traffic_mbps AS v FROM counts UNION ALL
  SELECT series_id, 'latency_ms', latency_ms FROM counts UNION ALL SELECT series_id, 'packet_loss_pct', packet_loss_pct FROM counts)
SELECT series_id, metric, round(quantile_cont(v, 0.9), 8) AS threshold, 0.9::DOUBLE AS quantile FROM long GROUP BY ALL""",
)
def _(spark, sf):
    return r8(flows.spike_threshold_sidecar(flows.telemetry_from_counts(flow_counts(spark, sf))))


# ---- counters and probes ----

COUNTERS = """
counters AS (
  SELECT ts, 'n' || (user_id % 16) AS node, 'eth' || (event_id % 7) AS iface, CAST(floor(value * 1000) AS BIGINT) AS rx,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tx FROM events)"""


def counter_rows(spark, sf):
    """Counters sampled at minute marks, with resets and an interface that is not counted."""
    return table(spark, sf, "events").select(
        "ts",
        F.concat(F.lit("n"), (F.col("user_id") % 16).cast("string")).alias("node"),
        F.concat(F.lit("eth"), (F.col("event_id") % 7).cast("string")).alias("iface"),
        F.floor(F.col("value") * 1000).alias("rx_bytes"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("tx_bytes"),
    )


@query(
    "src07_counter_rates",
    f"""WITH {COUNTERS},
sampled AS (SELECT node, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, sum(rx + tx) AS total
            FROM counters WHERE iface IN ('eth1','eth2','eth3','eth4','eth5') GROUP BY ALL),
deltas AS (SELECT ts, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY node ORDER BY ts), total)) AS d FROM sampled)
SELECT {EPOCH} AS timestamp, round_even(sum(d) * 8 / (1800 * 1000000.0) * 1000, 0) / 1000 AS traffic_mbps FROM deltas GROUP BY 1""",
)
def _(spark, sf):
    sampled = counter_rows(spark, sf).withColumn("ts", S.floor_minutes("ts", 30))
    return stamped(counters.traffic_rate(sampled, interval_seconds=1800))


PROBES = """
probes AS (
  SELECT ts, CASE WHEN user_id % 16 = 0 THEN 'lab-spine1' ELSE 'lab-leaf' || (user_id % 16) END AS node,
    CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN '5 packets transmitted, 0 received, 100% packet loss, time 4ms'
      ELSE '5 packets transmitted, 4 received, ' || (event_id % 50) || '.5% packet loss, time 4ms' || chr(10) ||
           CASE WHEN event_id % 2 = 0 THEN 'rtt min/avg/max/mdev = ' ELSE 'round-trip min/avg/max = ' END ||
           '0.5/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.25/90.1/0.3 ms' END AS output FROM events)"""


def probe_rows(spark, sf):
    """Ping texts in both formats, with total loss and empty output."""
    value = F.floor("value").cast("string")
    text = F.concat(
        F.lit("5 packets transmitted, 4 received, "),
        (F.col("event_id") % 50).cast("string"),
        F.lit(".5% packet loss, time 4ms\n"),
        F.when(F.col("event_id") % 2 == 0, "rtt min/avg/max/mdev = ").otherwise("round-trip min/avg/max = "),
        F.lit("0.5/"),
        value,
        F.lit(".25/90.1/0.3 ms"),
    )
    return table(spark, sf, "events").select(
        S.floor_minutes("ts", 60).alias("ts"),
        F.when(F.col("user_id") % 16 == 0, "lab-spine1")
        .otherwise(F.concat(F.lit("lab-leaf"), (F.col("user_id") % 16).cast("string")))
        .alias("node"),
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "click", "5 packets transmitted, 0 received, 100% packet loss, time 4ms")
        .otherwise(text)
        .alias("output"),
    )


@query(
    "src08_ping_probes",
    f"""WITH {PROBES}, parsed AS (
  SELECT date_trunc('hour', ts) AS ts, node,
    try_cast(nullif(regexp_extract(output, '(\\d+(?:\\.\\d+)?)%\\s*packet loss', 1), '') AS DOUBLE) AS loss,
    try_cast(nullif(regexp_extract(output, '(?:rtt|round-trip).*?=\\s*([\\d.]+)/([\\d.]+)/', 2), '') AS DOUBLE) AS rtt FROM probes)
SELECT {EPOCH} AS timestamp, round(coalesce(avg(rtt), 0), 3) AS latency_ms, round(coalesce(avg(loss), 0), 3) AS packet_loss_pct
FROM parsed WHERE NOT ends_with(node, 'spine1') GROUP BY 1""",
)
def _(spark, sf):
    out = counters.probe_means(probe_rows(spark, sf))
    return stamped(out).select(
        "timestamp",
        F.round("latency_ms", 3).alias("latency_ms"),
        F.round("packet_loss_pct", 3).alias("packet_loss_pct"),
    )


# ---- writers ----


@query(
    "snk01_forecast_table",
    f"""WITH {LINKS} SELECT series_id, row_idx, 'r1' AS run_id, CASE WHEN row_idx < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split,
  round(traffic_mbps, 8) AS traffic_mbps FROM tele""",
)
def _(spark, sf):
    rows = index_rows(link_telemetry(spark, sf), ["series_id"], ["timestamp"], "links").select(
        "series_id",
        "row_idx",
        F.lit("r1").alias("run_id"),
        F.when(F.col("row_idx") < F.floor(F.col("n_rows") * F.lit(0.8)), "train").otherwise("test").alias("split"),
        "traffic_mbps",
    )
    return r8(writers.write_partitioned(rows, ["run_id", "split"], "forecasts"))


@query(
    "snk03_append_log",
    "SELECT event_id AS seq, event_type AS candidate_id, round(value, 8) AS quality_pct FROM events",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("candidate_id"), F.col("value").alias("quality_pct")
    )
    path = writers.scratch_path(spark, "log")
    for part in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        writers.append_json(rows.filter(part), path)
    return r8(spark.read.schema(rows.schema).json(path))
