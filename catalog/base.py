"""Registration, the views every query starts from, and their SQL text.

Views (see README): ``links`` bins ``lineitem`` as a flow log, one series per
supplier; ``users`` bins ``events`` per group of users; ``counts`` turns
``lineitem`` flow counts into telemetry. All grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from telespan.operators.layout import index_rows
from telespan.sources import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 1440


# Added before rounding to 8 places: means of decimal data often end exactly on a tie, where the
# last bit of a sum, which depends on its order, would decide.
NUDGE = 1.3e-10


def drawn(seed: int, *key: str) -> str:
    """``scalar.draw`` in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 15) AS BIGINT)"


def off_ties(sql: str) -> str:
    """``round(x, 8)`` to ``round(x + NUDGE, 8)`` in SQL text."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        body = off_ties(sql[j + 6 : k - 1])
        if body.endswith(", 8"):
            body = f"({body[:-3]}) + {NUDGE}, 8"
        out += sql[i:j] + f"round({body})"
        i = k
    return out + sql[i:]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = off_ties(sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r8(df: DataFrame) -> DataFrame:
    """Round doubles for comparison between engines; summation order differs in the last bits."""
    return df.select(
        *[
            (F.round(F.col(n) + NUDGE, 8) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def link_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a flow log: one series per supplier."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("series_id"),
        F.col("l_shipdate").alias("Timestamp"),
        (F.floor("l_extendedprice") * 1000.0).alias("Flow Bytes/s"),
        F.col("l_quantity").alias("Flow Duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("PSH Flag Count"),
        (F.col("l_tax") > 0.055).cast("int").alias("RST Flag Count"),
    )


def user_flows(spark: SparkSession, sf: str, series: str | None = "s") -> DataFrame:
    """Events as a flow log: eight groups of users, or one series for all."""
    sid = F.lit("all") if series is None else F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string"))
    return table(spark, sf, "events").select(
        sid.alias("series_id"),
        F.col("ts").alias("Timestamp"),
        (F.col("value") * 1e6).alias("Flow Bytes/s"),
        F.get_json_object("props", "$.k").try_cast("double").alias("Flow Duration"),
        (F.col("event_type") == "error").cast("int").alias("PSH Flag Count"),
        (F.col("event_type") == "signup").cast("int").alias("RST Flag Count"),
    )


def link_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return flows.bin_flow_log(link_flows(spark, sf), DAY)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned daily telemetry per supplier."""
    return index_rows(link_telemetry(spark, sf), ["series_id"], ["timestamp"], "links")


def flow_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("l_ipn"),
        F.col("l_linenumber").cast("bigint").alias("r_asn"),
        F.col("l_quantity").alias("f"),
    )


# ---- the same views as SQL common table expressions ----

LINK_FLOWS = """
link_flows AS (
  SELECT 'p' || l_suppkey AS series_id, l_shipdate AS ts, floor(l_extendedprice) * 1000.0 AS rate,
         l_quantity AS duration, l_returnflag = 'R' AS psh, l_tax > 0.055 AS rst
  FROM lineitem)"""

LINKS = LINK_FLOWS + """,
link_bins AS (
  SELECT series_id, date_trunc('day', ts) AS ts, sum(rate) / 1e6 AS traffic_mbps, avg(duration) AS latency_ms,
         100.0 * (count(*) FILTER (psh) + count(*) FILTER (rst)) / count(*) AS packet_loss_pct
  FROM link_flows GROUP BY ALL),
tele AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS row_idx,
         count(*) OVER (PARTITION BY series_id) AS n_rows
  FROM link_bins)"""

# Tabular split: the last fifth is the test part, the last 15 % before it the validation part.
SPLITS = LINKS + """,
bounds AS (
  SELECT series_id, n_rows, test_start, greatest(1, least(test_start - 1, CAST(floor(test_start * 0.85) AS BIGINT))) AS val_start
  FROM (SELECT DISTINCT series_id, n_rows,
               greatest(2, least(n_rows - 1, CAST(floor(n_rows * 0.8) AS BIGINT))) AS test_start FROM tele)),
train AS (SELECT t.* FROM tele t JOIN bounds b USING (series_id) WHERE row_idx < test_start),
val AS (SELECT t.* REPLACE (row_idx - val_start AS row_idx) FROM tele t JOIN bounds b USING (series_id)
        WHERE row_idx >= val_start AND row_idx < test_start),
test AS (SELECT t.* REPLACE (row_idx - test_start AS row_idx) FROM tele t JOIN bounds b USING (series_id)
         WHERE row_idx >= test_start)"""


def melt(source: str, name: str, value: str = "value") -> str:
    """Metric columns of a CTE to rows."""
    parts = [
        f"SELECT series_id, row_idx, '{m}' AS metric, {m} AS {value} FROM {source}"
        for m in ("traffic_mbps", "latency_ms", "packet_loss_pct")
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def forecast_ctes(part: str, out: str = "fc") -> str:
    """Naive forecasts of a part, in long form."""
    return f"""
{melt(part, part + '_long', 'actual')},
{out} AS (
  SELECT series_id, row_idx, metric, method, actual, predicted FROM (
    SELECT *, coalesce(lag(actual) OVER w, actual) AS p,
           coalesce(avg(actual) OVER (PARTITION BY series_id, metric ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), actual) AS m,
           coalesce(lag(actual, 24) OVER w, lag(actual) OVER w, actual) AS s
    FROM {part}_long WINDOW w AS (PARTITION BY series_id, metric ORDER BY row_idx))
  CROSS JOIN LATERAL (VALUES ('Persistence', p), ('Moving Average', m), ('Seasonal Naive', s)) v(method, predicted))"""


THRESHOLDS = melt("train", "train_long") + """,
thr AS (SELECT series_id, metric, quantile_cont(value, 0.9) AS threshold FROM train_long GROUP BY ALL)"""

# Errors, guarded spike counts and report quality per series, method and metric.
SCORED = "WITH " + SPLITS + "," + forecast_ctes("test") + "," + THRESHOLDS + """,
sums AS (
  SELECT series_id, method, metric, threshold, count(*) AS n, avg(abs(predicted - actual)) AS mae,
         sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, var_pop(actual) AS v,
         max(actual) - min(actual) AS spread,
         count(*) FILTER (actual > threshold AND predicted > threshold) AS tp0,
         count(*) FILTER (actual <= threshold AND predicted > threshold) AS fp0,
         count(*) FILTER (actual > threshold AND predicted <= threshold) AS fn0,
         count(*) FILTER (actual > threshold * 1.05 AND predicted > threshold * 1.05) AS tp1,
         count(*) FILTER (actual <= threshold * 1.05 AND predicted > threshold * 1.05) AS fp1,
         count(*) FILTER (actual > threshold * 1.05 AND predicted <= threshold * 1.05) AS fn1
  FROM fc JOIN thr USING (series_id, metric) GROUP BY ALL),
guarded AS (
  SELECT *, metric = 'traffic_mbps' AND tp0 + fn0 > 0 AND tp0 + fp0 > 2 * (tp0 + fn0) AS g FROM sums),
picked AS (
  SELECT *, CASE WHEN g THEN tp1 ELSE tp0 END AS tp, CASE WHEN g THEN fp1 ELSE fp0 END AS fp,
         CASE WHEN g THEN fn1 ELSE fn0 END AS fn, greatest(spread, 1e-9) AS data_range,
         CASE WHEN spread > 0 THEN 1 - rmse * rmse / v ELSE 0.0 END AS r2 FROM guarded),
rates AS (
  SELECT *, tp + fn AS actual_spikes, tp + fp AS predicted_spikes, tp / greatest(tp + fp, 1) AS p,
         tp / greatest(tp + fn, 1) AS r FROM picked),
scored0 AS (
  SELECT *, 2 * p * r / greatest(p + r, 1e-9) AS f1,
         greatest(0, least(1, 1 - mae / data_range)) AS nmae, greatest(0, least(1, 1 - rmse / data_range)) AS nrmse
  FROM rates),
scored AS (
  SELECT *, 100 * greatest(0, least(1, 0.55 * (0.55 * nmae + 0.45 * nrmse) + 0.45 *
           CASE WHEN actual_spikes > 0 THEN 0.5 * f1 + 0.25 * p + 0.25 * r WHEN predicted_spikes = 0 THEN 1.0
                ELSE greatest(0, least(1, 1 - predicted_spikes / greatest(n, 1))) END)) AS quality_pct,
         CASE metric WHEN 'traffic_mbps' THEN 0.5 ELSE 0.25 END AS weight,
         CASE metric WHEN 'traffic_mbps' THEN 0 WHEN 'latency_ms' THEN 1 ELSE 2 END AS metric_no
  FROM scored0),
compared AS (
  SELECT *, base_mae AS baseline_mae, 100 * (base_mae - mae) / greatest(base_mae, 1e-9) AS gain FROM (
    SELECT *, max(mae) FILTER (method = 'Persistence') OVER (PARTITION BY series_id, metric) AS base_mae,
           max(rmse) FILTER (method = 'Persistence') OVER (PARTITION BY series_id, metric) AS baseline_rmse
    FROM scored)),
per_method AS (
  SELECT series_id, method, sum(weight * quality_pct) / sum(weight) AS quality_pct, avg(gain) AS mae_improvement_pct,
         avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2, bool_and(gain > 0) AS beats,
         max(f1) FILTER (metric = 'traffic_mbps') AS traffic_f1,
         max(predicted_spikes) FILTER (metric = 'traffic_mbps') AS traffic_spikes, min(r2) AS min_r2
  FROM compared GROUP BY ALL),
gated AS (
  SELECT series_id, method, quality_pct, mae_improvement_pct, quality_pct >= 90 AS quality_ge_90,
         mae_improvement_pct >= 15 AS mae_improvement_ge_15, beats AS beats_persistence_each_feature_mae,
         traffic_f1 >= 0.5 AS traffic_spike_f1_ge_0_50, traffic_spikes >= 5 AS traffic_predicted_spikes_ge_5,
         quality_pct > max(quality_pct) FILTER (method = 'Persistence') OVER (PARTITION BY series_id) AS model_quality_gt_persistence,
         min_r2 >= -0.1 AS all_features_r2_ge_neg_0_1
  FROM per_method)
"""
