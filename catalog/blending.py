"""Blend, calibrate, stack, specialists: J-02, J-10, M-05 .. M-10, M-13, M-14, P-23."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import LINKS, SCORED, SPLITS, THRESHOLDS, forecast_ctes, links, query, r8
from telespan.functions import scalar as S
from telespan.model import METRICS
from telespan.operators import blend as L
from telespan.operators import evaluation as E
from telespan.operators import forecasts as C
from telespan.plans import blend as LP
from telespan.plans import evaluate as V
from telespan.plans import forecast as FP
from telespan.scratch import materialize

METHODS = ["Persistence", "Moving Average", "Seasonal Naive"]

SIDE = """, {p}side AS (SELECT series_id, metric, row_idx, any_value(actual) AS actual, max(predicted) FILTER (method = 'Moving Average') AS first,
  max(predicted) FILTER (method = 'Seasonal Naive') AS second, max(predicted) FILTER (method = 'Persistence') AS persistence FROM {p}fc GROUP BY ALL)"""
BOTH = "WITH " + SPLITS + "," + forecast_ctes("val", "vfc") + "," + forecast_ctes("test") + "," + THRESHOLDS + SIDE.format(p="v") + SIDE.format(p="")
SPIKES = "count(*) FILTER (actual > threshold AND p > threshold) AS tp, count(*) FILTER (actual <= threshold AND p > threshold) AS fp, count(*) FILTER (actual > threshold AND p <= threshold) AS fn"
F1 = "(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9))"

M05 = f""", lim AS (SELECT series_id, metric, quantile_cont(actual, 0.9) AS threshold, stddev_pop(actual) AS sd FROM vside GROUP BY ALL),
g5 AS (SELECT series_id, metric, i, sd, avg(abs(p - actual)) AS mae, {SPIKES} FROM (
  SELECT v.*, threshold, sd, i, i / 40.0::DOUBLE * first + (1.0 - i / 40.0::DOUBLE) * second AS p FROM vside v JOIN lim USING (series_id, metric), range(0, 41) r(i)) GROUP BY ALL),
w5 AS (SELECT series_id, metric, arg_min(i, (round(mae + 0.2 * sd * (1 - {F1}), 9), i)) / 40.0::DOUBLE AS first_weight FROM g5 GROUP BY ALL)"""
M06 = """, g6 AS (SELECT series_id, metric, i, avg(abs(i * 5 / 100.0::DOUBLE * persistence + (1.0 - i * 5 / 100.0::DOUBLE) * first - actual)) AS mae FROM vside, range(0, 20) r(i) GROUP BY ALL),
w6 AS (SELECT series_id, metric, arg_min(i, (round(mae, 9), i)) * 5 / 100.0::DOUBLE AS persistence_weight FROM g6 GROUP BY ALL)"""
M07 = f""", b7 AS (SELECT series_id, metric, greatest(stddev_pop(actual), 1e-9) AS sd, avg(abs(actual - persistence)) AS base FROM vside GROUP BY ALL),
g7 AS (SELECT series_id, metric, g, sd, base, avg(abs(actual - p)) AS mae, {SPIKES} FROM (
  SELECT v.*, threshold, sd, base, g, ((85 + 5 * (g // 30)) / 100.0::DOUBLE * first + ((g // 6) % 5 - 2) * 0.05::DOUBLE * sd + (g % 6) / 10.0::DOUBLE * persistence) / (1.0 + (g % 6) / 10.0::DOUBLE) AS p
  FROM vside v JOIN thr USING (series_id, metric) JOIN b7 USING (series_id, metric), range(0, 210) r(g)) GROUP BY ALL),
s7 AS (SELECT *, 100 * (0.6 * 0.55 * greatest(0, least(1, log2(greatest(base, 1e-9) / greatest(mae, 1e-9)))) + 0.4 * CASE WHEN tp + fn > 0 THEN greatest(0, least(1, {F1})) WHEN tp + fp < 5 THEN 1.0 ELSE greatest(0, least(1, 1 - (tp + fp) / 20.0)) END)
  - CASE WHEN metric = 'traffic_mbps' THEN CASE WHEN tp + fp < 5 THEN 10 ELSE 0 END + CASE WHEN tp + fn > 0 AND tp + fp > 1.3 * (tp + fn) THEN 15.0 * ((tp + fp) / greatest(tp + fn, 1) - 1.3) ELSE 0 END ELSE 0 END AS score FROM g7),
w7 AS (SELECT series_id, metric, any_value(sd) AS sd, arg_max(g, (round(score, 9), -g)) AS g FROM s7 GROUP BY ALL),
c7 AS (SELECT series_id, metric, (85 + 5 * (g // 30)) / 100.0::DOUBLE AS scale, ((g // 6) % 5 - 2) * 0.05::DOUBLE * sd AS bias, (g % 6) / 10.0::DOUBLE AS persistence_weight FROM w7)"""


BLENDED = ", {b} AS (SELECT v.*, first_weight * first + (1.0 - first_weight) * second AS predicted FROM {side} v JOIN w5 USING (series_id, metric))"
MIXED = ", {m} AS (SELECT v.* REPLACE (persistence_weight * persistence + (1.0 - persistence_weight) * predicted AS predicted) FROM {b} v JOIN w6 USING (series_id, metric))"
SCALED = ", {c} AS (SELECT v.* REPLACE (greatest(0, (scale * predicted + bias + persistence_weight * persistence) / (1 + persistence_weight)) AS predicted) FROM {m} v JOIN c7 USING (series_id, metric))"
# Each step is tuned on the validation part as the step before left it.
IN_ORDER = (
    BOTH + M05 + BLENDED.format(b="vb", side="vside") + M06.replace("vside", "vb").replace("* first", "* predicted")
    + BLENDED.format(b="tb", side="side") + MIXED.format(m="vm", b="vb") + MIXED.format(m="tm", b="tb")
)
CHAIN = (
    M07.replace("vside", "vm").replace("* first", "* predicted") + SCALED.format(c="vc", m="vm") + SCALED.format(c="tc", m="tm")
    + ", vs AS (SELECT series_id, metric, stddev_pop(actual - predicted) AS sd FROM vc GROUP BY ALL)"
)


NAMES = {"first": "Moving Average", "second": "Seasonal Naive", "persistence": "Persistence"}


def side(columns):
    return LP.columns_side_by_side(columns, NAMES)


def validation(rows):
    return side(V.validation_columns(rows))


@query("m05_j10_two_learner_weights", BOTH + M05 + "SELECT series_id, metric, round(first_weight, 8) AS first_weight, round(1.0::DOUBLE - first_weight, 8) AS second_weight FROM w5")
def _(spark, sf):
    return r8(L.two_learner_weights(validation(links(spark, sf))))


@query("m06_persistence_weights", BOTH + M06 + "SELECT * FROM w6")
def _(spark, sf):
    return r8(L.persistence_weights(validation(links(spark, sf)).withColumnRenamed("first", "predicted")))


def calibrated(spark, sf):
    rows = links(spark, sf)
    thr = E.quantile_thresholds(C.split_train(rows))
    return rows, L.calibration(validation(rows).withColumnRenamed("first", "predicted"), thr)


@query("m07_calibration", BOTH + M07 + "SELECT series_id, metric, scale, round(bias, 8) + 0.0 AS bias, persistence_weight FROM c7")
def _(spark, sf):
    return r8(calibrated(spark, sf)[1])


@query(
    "m07b_calibrated_forecasts",
    BOTH + M07 + "SELECT series_id, metric, row_idx, round(greatest(0, (scale * first + bias + persistence_weight * persistence) / (1 + persistence_weight)), 8) AS predicted FROM side JOIN c7 USING (series_id, metric)",
)
def _(spark, sf):
    rows, params = calibrated(spark, sf)
    out = L.apply_calibration(side(V.test_columns(rows)).withColumnRenamed("first", "predicted"), params)
    return r8(out.select("series_id", "metric", "row_idx", "predicted"))


@query(
    "m14_blended_forecasts",
    IN_ORDER + "SELECT series_id, metric, row_idx, round(greatest(0, predicted), 8) AS predicted FROM tm",
)
def _(spark, sf):
    """Persistence is weighed against the blend it is mixed with."""
    rows = links(spark, sf)
    val = validation(rows)
    first = materialize(L.two_learner_weights(val), "w5")
    second = L.persistence_weights(L.blend_two(val, first))
    out = L.mix_persistence(L.blend_two(side(V.test_columns(rows)), first), second)
    return r8(out.select("series_id", "metric", "row_idx", "predicted"))


@query(
    "m05_m06_m07_tuned_chain",
    IN_ORDER + CHAIN + """SELECT series_id, metric, row_idx, round(actual, 8) AS actual, round(predicted, 8) AS predicted,
  round(greatest(0, predicted - 1.96 * sd), 8) AS lower_95, round(predicted + 1.96 * sd, 8) AS upper_95 FROM tc JOIN vs USING (series_id, metric)""",
)
def _(spark, sf):
    """The whole chain in the order it is applied: each step is tuned on the output of the one before."""
    rows = links(spark, sf)
    thr = E.quantile_thresholds(C.split_train(rows))
    return r8(LP.tune_and_apply(validation(rows), side(V.test_columns(rows)), thr))


@query(
    "p23_spike_lift",
    BOTH + """SELECT series_id, metric, row_idx, round(CASE WHEN first > threshold * n THEN greatest(first, threshold * l) ELSE first END, 8) AS predicted FROM side JOIN thr USING (series_id, metric)
JOIN (VALUES ('traffic_mbps', 1.0::DOUBLE, 1.05::DOUBLE), ('latency_ms', 0.9, 1.01), ('packet_loss_pct', 0.95, 1.05)) f(metric, n, l) USING (metric)""",
)
def _(spark, sf):
    rows = links(spark, sf)
    fc = side(V.test_columns(rows)).withColumnRenamed("first", "predicted")
    near = dict(zip(METRICS, (1.0, 0.9, 0.95)))
    lift = dict(zip(METRICS, (1.05, 1.01, 1.05)))
    out = L.lift_spikes(fc, E.quantile_thresholds(C.split_train(rows)), near, lift)
    return r8(out.select("series_id", "metric", "row_idx", "predicted"))


# ---- stacking: one run lacks its oldest rows, so tails must be aligned ----

RUNS = BOTH + """, vr AS (SELECT * FROM vfc WHERE NOT (method = 'Seasonal Naive' AND row_idx < 7)), tr AS (SELECT * FROM fc WHERE NOT (method = 'Seasonal Naive' AND row_idx < 7)),
vt AS (SELECT *, max(row_idx) OVER (PARTITION BY series_id, method, metric) - row_idx AS tail_idx FROM vr), tt AS (SELECT *, max(row_idx) OVER (PARTITION BY series_id, method, metric) - row_idx AS tail_idx FROM tr),
va AS (SELECT series_id, metric, tail_idx, max(actual) FILTER (method = 'Persistence') AS actual, max(predicted) FILTER (method = 'Persistence') AS p0, max(predicted) FILTER (method = 'Moving Average') AS p1, max(predicted) FILTER (method = 'Seasonal Naive') AS p2 FROM vt GROUP BY ALL HAVING count(*) = 3),
ta AS (SELECT series_id, metric, tail_idx, max(actual) FILTER (method = 'Persistence') AS actual, max(predicted) FILTER (method = 'Persistence') AS p0, max(predicted) FILTER (method = 'Moving Average') AS p1, max(predicted) FILTER (method = 'Seasonal Naive') AS p2 FROM tt GROUP BY ALL HAVING count(*) = 3)"""
# Every run alone, all alike, and 3,000 draws: the same vectors as L.weight_vectors.
STACKED = RUNS + """, draws AS MATERIALIZED (
  SELECT k, i, -ln((CAST(('0x' || substr(md5('7:' || k || ':' || i), 1, 8))::UBIGINT AS DOUBLE) + 1) / 4294967296.0::DOUBLE) AS e FROM range(3000) a(k), range(3) b(i)),
vectors AS MATERIALIZED (
  SELECT k + 4 AS k, max(e) FILTER (i = 0) / sum(e) AS w0, max(e) FILTER (i = 1) / sum(e) AS w1, max(e) FILTER (i = 2) / sum(e) AS w2 FROM draws GROUP BY k
  UNION ALL SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0, 1, 0), (2, 0, 0, 1), (3, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE))),
ls AS (SELECT series_id, metric, k, w0, w1, w2, avg(abs(w0 * p0 + w1 * p1 + w2 * p2 - actual)) AS mae FROM va, vectors GROUP BY ALL),
sw AS (SELECT series_id, metric, arg_min(w0, (round(mae, 9), k)) AS w0, arg_min(w1, (round(mae, 9), k)) AS w1, arg_min(w2, (round(mae, 9), k)) AS w2, min(mae) AS val_mae FROM ls GROUP BY ALL)"""


def runs_of(spark, sf):
    rows = links(spark, sf)
    short = (F.col("method") == "Seasonal Naive") & (F.col("row_idx") < 7)
    return V.validation_forecasts(rows).filter(~short), V.test_forecasts(rows).filter(~short)


@query("j02_tail_alignment", RUNS + "SELECT series_id, metric, tail_idx, round(actual, 8) AS actual, round(p0, 8) AS p0, round(p1, 8) AS p1, round(p2, 8) AS p2 FROM ta")
def _(spark, sf):
    return r8(L.align_tails(runs_of(spark, sf)[1], METHODS))


@query("m09_stacking_weights", STACKED + "SELECT series_id, metric, round(w0, 8) AS w0, round(w1, 8) AS w1, round(w2, 8) AS w2, round(val_mae, 8) AS val_mae FROM sw")
def _(spark, sf):
    return r8(L.stacking_weights(runs_of(spark, sf)[0], METHODS))


@query("m09_stacked_forecasts", STACKED + "SELECT series_id, metric, tail_idx, round(actual, 8) AS actual, round(w0 * p0 + w1 * p1 + w2 * p2, 8) AS predicted FROM ta JOIN sw USING (series_id, metric)")
def _(spark, sf):
    val, test = runs_of(spark, sf)
    return r8(L.stack(test, L.stacking_weights(val, METHODS), METHODS))


@query(
    "m09_best_run",
    RUNS + "SELECT series_id, arg_min(method, (round(s, 9), method)) AS best_run FROM (SELECT series_id, method, sum(CASE metric WHEN 'traffic_mbps' THEN 0.5 ELSE 0.25 END * mae) AS s FROM (SELECT series_id, method, metric, avg(abs(predicted - actual)) AS mae FROM vr GROUP BY ALL) GROUP BY ALL) GROUP BY 1",
)
def _(spark, sf):
    return L.best_stacked_run(runs_of(spark, sf)[0])


@query(
    "m10_specialists",
    SCORED + SIDE.format(p="") + """, weak AS (SELECT series_id, metric FROM compared WHERE method = 'Moving Average' AND (quality_pct < 85 OR gain < 5))
SELECT s.series_id, s.metric, max(row_idx) OVER (PARTITION BY s.series_id, s.metric) - row_idx AS tail_idx, round(CASE WHEN w.metric IS NULL THEN first WHEN s.metric = 'traffic_mbps' THEN second WHEN s.metric = 'packet_loss_pct' THEN 0.7 * second + 0.3 * first ELSE 0.5 * persistence + 0.5 * first END, 8) AS predicted
FROM side s LEFT JOIN weak w USING (series_id, metric)""",
)
def _(spark, sf):
    rows = links(spark, sf)
    fc = V.test_forecasts(rows)
    scored = E.score(fc, E.quantile_thresholds(C.split_train(rows)))
    tails = L.with_tail_position(fc)
    model = L.align_tails(fc, ["Moving Average", "Persistence"]).select(
        "series_id", "metric", "tail_idx", F.col("p0").alias("predicted"), F.col("p1").alias("persistence")
    )
    specialist = tails.filter(F.col("method") == "Seasonal Naive")
    out = L.apply_specialists(model, specialist, L.weak_metrics(E.compare_with_baseline(scored), "Moving Average"))
    return r8(out.select("series_id", "metric", "tail_idx", "predicted"))


@query(
    "m13_future_times",
    f"""WITH {LINKS}, gaps AS (SELECT series_id, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY row_idx)) AS BIGINT) AS gap FROM tele),
st AS (SELECT series_id, arg_max(gap, (n, -gap)) AS step FROM (SELECT series_id, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT series_id, CAST(i AS INT) AS step_no, CAST(epoch(max(ts)) AS BIGINT) + i * step AS timestamp FROM tele JOIN st USING (series_id), range(1, 25) r(i) GROUP BY series_id, i, step""",
)
def _(spark, sf):
    out = FP.future_times(links(spark, sf), 24)
    return out.select("series_id", "step_no", S.epoch_seconds("timestamp").alias("timestamp"))
