"""Evaluation and significance: A-04 .. A-23, A-28 .. A-31, A-37, A-38, P-18, P-19, J-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SCORED, SPLITS, THRESHOLDS, forecast_ctes, links, melt, query, r8
from telespan.operators import evaluation as E
from telespan.operators import forecasts as C
from telespan.operators import report as R
from telespan.operators import significance as G
from telespan.plans import evaluate as V

FORECASTS = "WITH " + SPLITS + "," + forecast_ctes("test")
WITH_THR = FORECASTS + "," + THRESHOLDS
ABS = "abs(predicted - actual)"
SQ = "(predicted - actual) * (predicted - actual)"


@query("a04_quantile_thresholds", f"WITH {SPLITS},{THRESHOLDS} SELECT series_id, metric, round(threshold, 8) AS threshold, 'training_quantile_0.90' AS threshold_source FROM thr")
def _(spark, sf):
    return r8(E.quantile_thresholds(C.split_train(links(spark, sf))))


@query("a05_spread_thresholds", f"WITH {SPLITS},{melt('train', 'l')} SELECT series_id, metric, round(avg(value) + 1.2 * stddev_pop(value), 8) AS threshold FROM l GROUP BY ALL")
def _(spark, sf):
    return r8(E.spread_thresholds(C.split_train(links(spark, sf)), 1.2))


@query(
    "j06_saved_thresholds",
    f"""WITH {SPLITS},{THRESHOLDS}, l2 AS (SELECT series_id, avg(traffic_mbps) + stddev_pop(traffic_mbps) AS t FROM train GROUP BY 1)
SELECT series_id, metric, round(CASE WHEN metric = 'traffic_mbps' THEN t ELSE threshold END, 8) AS threshold,
  CASE WHEN metric = 'traffic_mbps' THEN 'training_metrics' ELSE 'training_quantile_0.90' END AS threshold_source FROM thr JOIN l2 USING (series_id)""",
)
def _(spark, sf):
    train = C.split_train(links(spark, sf))
    saved = E.spread_thresholds(train, 1.0).filter(F.col("metric") == "traffic_mbps")
    return r8(E.prefer_saved(E.quantile_thresholds(train), saved))


@query("u03_stacked_forecasts", FORECASTS + "SELECT series_id, row_idx, method, metric, round(actual, 8) AS actual, round(predicted, 8) AS predicted FROM fc")
def _(spark, sf):
    return r8(V.test_forecasts(links(spark, sf)))


@query(
    "j01_align_by_position",
    FORECASTS + f"""SELECT a.series_id, a.metric, count(*) AS n, round(avg(abs(a.actual - p.predicted)), 8) AS mae
FROM test_long a JOIN fc p ON a.series_id = p.series_id AND a.row_idx = p.row_idx AND a.metric = p.metric WHERE p.method = 'Moving Average' GROUP BY ALL""",
)
def _(spark, sf):
    rows = links(spark, sf)
    actual = C.to_long(C.split_test(rows), "actual").select("series_id", "row_idx", "metric", "actual")
    predicted = V.test_forecasts(rows, ["Moving Average"]).drop("actual", "method")
    joined = actual.join(predicted, ["series_id", "row_idx", "metric"])
    return r8(
        joined.groupBy("series_id", "metric").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")
        )
    )


@query(
    "a06_regression_metrics",
    SCORED + """SELECT series_id, method, metric, n, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(r2, 8) AS r2, round(data_range, 8) AS data_range,
  round(nmae, 8) AS normalized_mae, round(nrmse, 8) AS normalized_rmse FROM scored""",
)
def _(spark, sf):
    return r8(E.regression_metrics(V.test_forecasts(links(spark, sf))))


@query(
    "a07_spike_scores",
    SCORED + """SELECT series_id, method, metric, round(threshold, 8) AS threshold, tp0 + fn0 AS actual_spikes, tp0 + fp0 AS predicted_spikes,
  round(tp0 / greatest(tp0 + fp0, 1), 8) AS precision, round(tp0 / greatest(tp0 + fn0, 1), 8) AS recall,
  round(2 * (tp0 / greatest(tp0 + fp0, 1)) * (tp0 / greatest(tp0 + fn0, 1)) / greatest(tp0 / greatest(tp0 + fp0, 1) + tp0 / greatest(tp0 + fn0, 1), 1e-9), 8) AS f1 FROM sums""",
)
def _(spark, sf):
    rows = links(spark, sf)
    return r8(E.spike_scores(V.test_forecasts(rows), E.quantile_thresholds(C.split_train(rows))))


@query(
    "a08_spike_analysis",
    SCORED + """SELECT series_id, method, metric, round(CASE WHEN g THEN threshold * 1.05 ELSE threshold END, 8) AS threshold,
  'training_quantile_0.90' || CASE WHEN g THEN '_precision_guard' ELSE '' END AS threshold_source, actual_spikes, predicted_spikes,
  round(p, 8) AS precision, round(r, 8) AS recall, round(f1, 8) AS f1 FROM scored""",
)
def _(spark, sf):
    rows = links(spark, sf)
    return r8(E.spike_analysis(V.test_forecasts(rows), E.quantile_thresholds(C.split_train(rows))))


@query(
    "a09_macro_spike_f1",
    FORECASTS + f""",{melt('train', 'l')}, t AS (SELECT series_id, metric, avg(value) + 1.2 * stddev_pop(value) AS threshold FROM l GROUP BY ALL),
c AS (SELECT series_id, method, metric, count(*) FILTER (actual > threshold AND predicted > threshold) AS tp, count(*) FILTER (actual <= threshold AND predicted > threshold) AS fp,
  count(*) FILTER (actual > threshold AND predicted <= threshold) AS fn FROM fc JOIN t USING (series_id, metric) GROUP BY ALL),
q AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)
SELECT series_id, method, round(avg(2 * p * r / greatest(p + r, 1e-9)), 8) AS spike_f1 FROM q GROUP BY ALL""",
)
def _(spark, sf):
    rows = links(spark, sf)
    return r8(E.macro_spike_f1(V.test_forecasts(rows), C.split_train(rows)))


@query("a10_weighted_mae", SCORED + "SELECT series_id, method, round(sum(weight * mae), 8) AS weighted_mae FROM scored GROUP BY ALL")
def _(spark, sf):
    return r8(E.weighted_mae(E.regression_metrics(V.test_forecasts(links(spark, sf)))))


@query(
    "a11_j05_report_quality",
    SCORED + """SELECT series_id, method, metric, round(CASE WHEN metric = 'latency_ms' AND method = 'Seasonal Naive'
  THEN 100 * greatest(0, least(1, 0.55 * (0.55 * nmae + 0.45 * nrmse) + 0.45 * 0.5)) ELSE quality_pct END, 8) AS quality_pct FROM scored""",
)
def _(spark, sf):
    """Spike rows of one method and metric are left out, to show the optional lookup."""
    rows = links(spark, sf)
    fc = V.test_forecasts(rows)
    spikes = E.spike_analysis(fc, E.quantile_thresholds(C.split_train(rows))).filter(
        ~((F.col("metric") == "latency_ms") & (F.col("method") == "Seasonal Naive"))
    )
    return r8(E.metric_quality(E.regression_metrics(fc), spikes).select(*E.KEYS, "quality_pct"))


@query(
    "a12_log_ratio_quality",
    SCORED + """SELECT series_id, method, round(sum(weight * q) / sum(weight), 8) AS quality_pct FROM (SELECT *, 100 * (0.6 * (0.55 * greatest(0, least(1, log2(greatest(base_mae, 1e-9) / greatest(mae, 1e-9)))) + 0.45 * greatest(0, least(1, r2)))
  + 0.4 * CASE WHEN actual_spikes > 0 THEN greatest(0, least(1, f1)) WHEN predicted_spikes < 5 THEN 1.0 ELSE greatest(0, least(1, 1 - predicted_spikes / 20.0)) END) AS q FROM compared) GROUP BY ALL""",
)
def _(spark, sf):
    return r8(E.weighted_quality(E.log_ratio_quality(V.score_naive(links(spark, sf)))))


@query(
    "a13_model_vs_baseline",
    SCORED + """SELECT series_id, method, metric, CASE metric WHEN 'traffic_mbps' THEN 'Mbps' WHEN 'latency_ms' THEN 'ms' ELSE '%' END AS unit, round(mae, 8) AS model_mae, round(baseline_mae, 8) AS baseline_mae,
  round(gain, 8) + 0.0 AS mae_improvement_pct, round(rmse, 8) AS model_rmse, round(baseline_rmse, 8) AS baseline_rmse, round(r2, 8) AS model_r2, round(quality_pct, 8) AS quality_pct FROM compared""",
)
def _(spark, sf):
    return r8(E.compare_with_baseline(V.score_naive(links(spark, sf))))


@query("a14_method_comparison", SCORED + "SELECT series_id, method, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(r2, 8) AS r2, round(quality_pct, 8) AS quality_pct FROM per_method")
def _(spark, sf):
    return r8(E.compare_methods(V.score_naive(links(spark, sf))))


@query("a15_gates", SCORED + "SELECT * EXCLUDE (all_features_r2_ge_neg_0_1) REPLACE (round(quality_pct, 8) AS quality_pct, round(mae_improvement_pct, 8) + 0.0 AS mae_improvement_pct) FROM gated")
def _(spark, sf):
    return r8(E.gates(V.score_naive(links(spark, sf))))


@query("a16_gates_with_r2", SCORED + "SELECT * REPLACE (round(quality_pct, 8) AS quality_pct, round(mae_improvement_pct, 8) + 0.0 AS mae_improvement_pct) FROM gated")
def _(spark, sf):
    return r8(E.gates(V.score_naive(links(spark, sf)), with_r2=True))


@query(
    "a17_verdict",
    SCORED + """SELECT series_id, method, round(quality_pct, 8) AS quality_pct, quality_ge_90 AND mae_improvement_ge_15 AND beats_persistence_each_feature_mae
  AND traffic_spike_f1_ge_0_50 AND traffic_predicted_spikes_ge_5 AND model_quality_gt_persistence AND quality_pct >= 60 AS passed FROM gated""",
)
def _(spark, sf):
    return r8(E.verdict(E.gates(V.score_naive(links(spark, sf))), 60.0))


@query(
    "a18_false_safe_rate",
    FORECASTS + """, t AS (SELECT series_id, quantile_cont(actual, 0.9) AS threshold FROM test_long WHERE metric = 'traffic_mbps' GROUP BY 1)
SELECT series_id, method, count(*) FILTER (actual > threshold) AS peaks,
  round(coalesce(count(*) FILTER (actual > threshold AND predicted <= threshold) / nullif(count(*) FILTER (actual > threshold), 0), 0), 8) AS false_safe_rate
FROM fc JOIN t USING (series_id) WHERE metric = 'traffic_mbps' GROUP BY ALL""",
)
def _(spark, sf):
    return r8(E.false_safe_rate(V.test_forecasts(links(spark, sf))))


@query(
    "a19_diagnosis",
    SCORED + """, w AS (SELECT series_id, method, arg_min(metric, (round(quality_pct, 9), metric_no)) AS metric, arg_min(gain, (round(quality_pct, 9), metric_no)) AS gain, arg_min(r2, (round(quality_pct, 9), metric_no)) AS r2 FROM compared GROUP BY ALL),
d AS (SELECT w.series_id, w.method, CASE WHEN NOT traffic_spike_f1_ge_0_50 THEN 'traffic_mbps' ELSE metric END AS bottleneck_feature,
  CASE WHEN NOT traffic_spike_f1_ge_0_50 THEN 'low_traffic_spike_f1' WHEN gain <= 0 THEN 'does_not_beat_persistence_mae' WHEN r2 < 0.1 THEN 'low_r2' ELSE 'low_quality' END AS bottleneck_reason, quality_pct FROM w JOIN gated USING (series_id, method))
SELECT series_id, method, bottleneck_feature, bottleneck_reason, CASE WHEN bottleneck_reason IN ('does_not_beat_persistence_mae', 'low_traffic_spike_f1') THEN 'gb_spike' ELSE 'hybrid_aggressive' END AS suggested_candidate, round(quality_pct, 8) AS quality FROM d""",
)
def _(spark, sf):
    scored = V.score_naive(links(spark, sf))
    return r8(E.diagnose(E.compare_with_baseline(scored), E.gates(scored)))


@query(
    "a20_normalized_mse",
    FORECASTS + f"""SELECT series_id, method, round(avg(x), 8) AS normalized_mse FROM (SELECT series_id, method, metric, avg({SQ}) / pow(greatest(stddev_pop(actual), 1e-9), 2) AS x FROM fc GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, sf):
    return r8(E.normalized_mse(V.test_forecasts(links(spark, sf))))


@query(
    "p18_spike_weighted_error",
    WITH_THR + f""", t AS (SELECT *, CASE metric WHEN 'traffic_mbps' THEN 1.0 WHEN 'latency_ms' THEN 1.8 ELSE 2.5 END AS m FROM fc JOIN thr USING (series_id, metric)),
s AS (SELECT series_id, method, row_idx, sum({SQ} * (1 + pow({ABS}, 0.3)) * m * (1 + 4.0 * CAST(actual > threshold AS INT) * m)) AS x FROM t GROUP BY ALL)
SELECT series_id, method, round(avg(x), 4) AS weighted_loss FROM s GROUP BY ALL""",
)
def _(spark, sf):
    rows = links(spark, sf)
    thr = E.quantile_thresholds(C.split_train(rows))
    out = E.spike_weighted_error(V.test_forecasts(rows), thr, focal_gamma=0.3)
    return out.withColumn("weighted_loss", F.round("weighted_loss", 4))


@query(
    "p19_a38_whole_table_errors",
    FORECASTS + f"""SELECT method, round(avg({SQ}), 5) AS test_mse, round(avg({ABS}), 5) AS test_mae, round(avg(2 * {ABS} / greatest(abs(actual) + abs(predicted), 1e-9)), 5) AS test_smape FROM fc GROUP BY 1""",
)
def _(spark, sf):
    out = E.whole_table_errors(V.test_forecasts(links(spark, sf)))
    return out.select("method", *[F.round(c, 5).alias(c) for c in ("test_mse", "test_mae", "test_smape")])


@query(
    "a30_residual_band",
    FORECASTS + "," + forecast_ctes("val", "vfc") + """, s AS (SELECT series_id, method, metric, stddev_pop(actual - predicted) AS sd FROM vfc GROUP BY ALL)
SELECT series_id, method, metric, row_idx, round(greatest(0, predicted - 1.96 * sd), 8) AS lower_95, round(predicted + 1.96 * sd, 8) AS upper_95 FROM fc JOIN s USING (series_id, method, metric)""",
)
def _(spark, sf):
    """The band comes from validation errors, as it must be known before the test part."""
    rows = links(spark, sf)
    fc = V.test_forecasts(rows)
    return r8(E.residual_band(fc, E.residual_std(V.validation_forecasts(rows))).select(*E.KEYS, "row_idx", "lower_95", "upper_95"))


@query(
    "a31_band_width",
    FORECASTS + "," + forecast_ctes("val", "vfc") + f""", s AS (SELECT series_id, method, metric, stddev_pop(actual - predicted) AS sd FROM vfc GROUP BY ALL),
b AS (SELECT series_id, method, metric, avg(predicted + 1.96 * sd - greatest(0, predicted - 1.96 * sd)) / 3.92 AS stored FROM fc JOIN s USING (series_id, method, metric) WHERE method = 'Persistence' GROUP BY ALL),
f AS (SELECT series_id, method, metric, avg(abs(predicted)) * 0.1 AS fallback FROM fc GROUP BY ALL)
SELECT series_id, method, metric, round(coalesce(stored, fallback), 8) AS residual_std FROM f LEFT JOIN b USING (series_id, method, metric)""",
)
def _(spark, sf):
    rows = links(spark, sf)
    fc = V.test_forecasts(rows)
    spread = E.residual_std(V.validation_forecasts(rows, ["Persistence"]))
    return r8(E.band_std(fc, E.residual_band(fc.filter(F.col("method") == "Persistence"), spread)))


@query(
    "a37_overall_report",
    SCORED + """, losses AS (SELECT series_id, 'Moving Average' AS method, row_idx AS epoch, traffic_mbps AS mse_loss FROM val),
last AS (SELECT series_id, method, arg_max(mse_loss, epoch) AS l, count(*) AS e FROM losses GROUP BY ALL)
SELECT series_id, method, round(quality_pct, 8) AS normalized_quality_pct, round(mae_improvement_pct, 8) + 0.0 AS mae_improvement_vs_persistence_pct, round(coalesce(l, 0), 8) AS final_training_loss,
  coalesce(e, 0) AS epochs, n_rows AS rows, n_rows - test_start AS test_samples FROM per_method LEFT JOIN last USING (series_id, method) JOIN bounds USING (series_id)""",
)
def _(spark, sf):
    rows = links(spark, sf)
    losses = C.split_validation(rows).select(
        "series_id",
        F.lit("Moving Average").alias("method"),
        F.col("row_idx").alias("epoch"),
        F.col("traffic_mbps").alias("mse_loss"),
    )
    _, test = C.tabular_bounds(F.col("n_rows"))
    sizes = rows.groupBy("series_id", "n_rows").agg(F.count(F.lit(1)).alias("rows")).select(
        "series_id", "rows", (F.col("n_rows") - test).alias("test_samples")
    )
    return r8(E.overall_report(V.score_naive(rows), losses, sizes))


# ---- report tables ----

HIST = """, ext AS (SELECT series_id, method, metric, min(error) AS lo, max(error) AS hi, count(*) AS n FROM errors GROUP BY ALL),
ext2 AS (SELECT * REPLACE (CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS lo, CASE WHEN hi > lo THEN hi ELSE hi + 0.5 END AS hi) FROM ext),
binned AS (SELECT series_id, method, metric, lo, hi, n, CAST(least(floor(round((error - lo) / ((hi - lo) / {bins}), 9)), {bins} - 1) AS INT) AS bin, count(*) AS rows FROM errors JOIN ext2 USING (series_id, method, metric) GROUP BY ALL)"""
NORMALIZED = """, sd AS (SELECT series_id, method, metric, greatest(stddev_pop(actual), 1e-9) AS s FROM fc GROUP BY ALL),
errors AS (SELECT series_id, method, metric, (predicted - actual) / s AS error FROM fc JOIN sd USING (series_id, method, metric))"""


@query(
    "a28_error_histogram",
    FORECASTS + ", errors AS (SELECT series_id, method, metric, predicted - actual AS error FROM fc WHERE method <> 'Moving Average')" + HIST.format(bins=30) + "SELECT series_id, method, metric, bin, rows FROM binned",
)
def _(spark, sf):
    return R.error_histogram(V.test_forecasts(links(spark, sf), ["Persistence", "Seasonal Naive"]))


@query("a28_error_density", FORECASTS + NORMALIZED + HIST.format(bins=24) + "SELECT method, metric, count(*) AS bins, round(sum(rows / (n * (hi - lo) / 24) * (hi - lo) / 24), 8) AS area FROM binned GROUP BY ALL")
def _(spark, sf):
    fc = V.test_forecasts(links(spark, sf))
    width = R.normalized_errors(fc).groupBy(*E.KEYS).agg(((F.max("error") - F.min("error")) / 24).alias("w"))
    out = R.error_density(fc).join(width, E.KEYS)
    return r8(out.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("density") * F.col("w")).alias("area")))


@query("a28_error_limit", FORECASTS + NORMALIZED + "SELECT series_id, method, round(greatest(quantile_cont(abs(error), 0.95), 0.1), 8) AS error_limit FROM errors GROUP BY ALL")
def _(spark, sf):
    return r8(R.error_limit(V.test_forecasts(links(spark, sf))))


@query(
    "a29_spike_summary",
    WITH_THR + f"SELECT series_id, method, metric, round(threshold, 8) AS threshold, round(avg({ABS}), 8) AS mae, round(avg(predicted - actual), 8) + 0.0 AS bias, count(*) FILTER (predicted > threshold) AS spikes FROM fc JOIN thr USING (series_id, metric) GROUP BY series_id, method, metric, threshold",
)
def _(spark, sf):
    rows = links(spark, sf)
    return r8(R.spike_summary(V.test_forecasts(rows), E.quantile_thresholds(C.split_train(rows))))


@query("p25_predicted_spikes", WITH_THR + "SELECT series_id, method, metric, row_idx FROM fc JOIN thr USING (series_id, metric) WHERE predicted > threshold")
def _(spark, sf):
    rows = links(spark, sf)
    out = R.predicted_spikes(V.test_forecasts(rows), E.quantile_thresholds(C.split_train(rows)))
    return out.select(*E.KEYS, "row_idx")


# ---- significance ----


def moving_average_pairs(spark, sf):
    """Errors of the moving average and of persistence in the test part."""
    return G.paired_columns(V.test_columns(links(spark, sf), ["Persistence", "Moving Average"]), "Moving Average")


PAIRED = FORECASTS + """, pair AS (
  SELECT series_id, metric, row_idx, max(abs(actual - predicted)) FILTER (method = 'Moving Average') AS e1, max(abs(actual - predicted)) FILTER (method = 'Persistence') AS e2 FROM fc GROUP BY ALL)"""


@query(
    "a21_diebold_mariano",
    PAIRED + """, d AS (SELECT *, e1 * e1 - e2 * e2 AS d FROM pair),
l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY series_id, metric ORDER BY row_idx)),
g AS (SELECT series_id, metric, count(*) AS n, avg(d) AS m, var_pop(d) + 2 * (1 - 1 / 3.0) * covar_pop(d, d1) + 2 * (1 - 2 / 3.0) * covar_pop(d, d2) AS v FROM l GROUP BY ALL)
SELECT series_id, metric, n, round(CASE WHEN v > 0 THEN m / sqrt(v / n) * sqrt((n + 1 - 6 + 6.0 / n) / n) ELSE 0 END, 8) AS dm_stat FROM g""",
)
def _(spark, sf):
    return r8(G.diebold_mariano(moving_average_pairs(spark, sf), h=3).select("series_id", "metric", "n", "dm_stat"))


@query(
    "a22_paired_t_test",
    PAIRED + """, g AS (SELECT series_id, metric, count(*) AS n, avg(e1 - e2) AS m, stddev_samp(e1 - e2) AS s, max(abs(e1 - e2)) AS top FROM pair GROUP BY ALL)
SELECT series_id, metric, n, round(CASE WHEN top > 1e-8 AND s > 0 THEN m / (s / sqrt(n)) ELSE 0 END, 8) AS t_stat FROM g""",
)
def _(spark, sf):
    return r8(G.paired_t_test(moving_average_pairs(spark, sf)).select("series_id", "metric", "n", "t_stat"))


# Two-sided Student-t p-values: the continued fraction of the incomplete beta function, term by term.
P_VALUES = """, s AS (SELECT *, n - 1.0 AS df, CASE WHEN v > 0 THEN dm / sqrt(v / n) * sqrt((n - 1.0) / n) ELSE 0 END AS dm_stat, coalesce(v > 0, false) AS dm_ok,
  CASE WHEN top > 1e-8 AND sd > 0 THEN m / (sd / sqrt(n)) ELSE 0 END AS t_stat, coalesce(top > 1e-8 AND sd > 0, false) AS t_ok FROM g WHERE n >= 2),
x AS (SELECT series_id, metric, kind, df / 2 AS h, t * t / (df + t * t) AS y, df / (df + t * t) AS x FROM (
  SELECT series_id, metric, df, 'dm' AS kind, dm_stat AS t FROM s WHERE dm_ok UNION ALL SELECT series_id, metric, df, 't', t_stat FROM s WHERE t_ok) WHERE t != 0),
z AS (SELECT *, x > (h + 1) / (h + 2.5) AS swap FROM x),
o AS (SELECT series_id, metric, kind, swap, CASE WHEN swap THEN 0.5 ELSE h END AS a, CASE WHEN swap THEN h ELSE 0.5 END AS b, CASE WHEN swap THEN y ELSE x END AS x,
  exp(h * ln(x) + 0.5 * ln(y) + lgamma(h + 0.5) - lgamma(h) - lgamma(0.5)) AS front FROM z),
f AS (SELECT *, 2 AS k, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS value FROM o
  UNION ALL
  SELECT series_id, metric, kind, swap, a, b, x, front, k + 1, 1 + u / c, 1 / (1 + u * d), value * (1 + u / c) / (1 + u * d)
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN (k // 2) * (b - k // 2) ELSE -(a + k // 2) * (a + b + k // 2) END * x / ((a + k - 1) * (a + k)) AS u FROM f WHERE k < 130)),
p AS (SELECT series_id, metric, kind, CASE WHEN swap THEN 1 - front * value / 0.5 ELSE front * value / a END AS p FROM f WHERE k = 130)
SELECT s.series_id, s.metric AS feature, round(dm_stat, 8) AS diebold_mariano_stat, round(coalesce(d.p, 1), 8) AS diebold_mariano_p_value, CAST(coalesce(d.p, 1) < 0.05 AS INT) AS dm_significant,
  round(t_stat, 8) AS paired_t_stat, round(coalesce(t.p, 1), 8) AS paired_t_p_value, CAST(coalesce(t.p, 1) < 0.05 AS INT) AS t_significant
FROM s LEFT JOIN p d ON d.series_id = s.series_id AND d.metric = s.metric AND d.kind = 'dm' LEFT JOIN p t ON t.series_id = s.series_id AND t.metric = s.metric AND t.kind = 't'"""


@query(
    "a23_f03_significance",
    PAIRED.replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT series_id, metric, count(*) AS n, avg(e1 * e1 - e2 * e2) AS dm, var_pop(e1 * e1 - e2 * e2) AS v,
  avg(e1 - e2) AS m, stddev_samp(e1 - e2) AS sd, max(abs(e1 - e2)) AS top FROM pair GROUP BY ALL)""" + P_VALUES,
)
def _(spark, sf):
    return r8(G.significance(moving_average_pairs(spark, sf)))
