"""Window operators over positioned telemetry: P-05 .. P-09, W-*, U-*, M-01, A-25 .. A-29."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import LINKS, SPLITS, THRESHOLDS, links, melt, query, r8
from telespan.functions import scalar as S
from telespan.model import METRICS
from telespan.operators import baselines as B
from telespan.operators import evaluation as E
from telespan.operators import features as X
from telespan.operators import forecasts as C
from telespan.operators import report as R

HISTORY = "PARTITION BY series_id ORDER BY row_idx"


@query(
    "p05_p06_calendar",
    f"""WITH {LINKS} SELECT series_id, row_idx, round(sin(2*pi()*hour(ts)/24.0), 8) + 0.0 AS hour_sin, round(cos(2*pi()*hour(ts)/24.0), 8) + 0.0 AS hour_cos,
  round(sin(2*pi()*(isodow(ts)-1)/7.0), 8) + 0.0 AS weekday_sin, round(cos(2*pi()*(isodow(ts)-1)/7.0), 8) + 0.0 AS weekday_cos,
  CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend FROM tele""",
)
def _(spark, sf):
    return r8(links(spark, sf).select("series_id", "row_idx", *[c.alias(n) for n, c in S.calendar().items()], S.is_weekend().alias("is_weekend")))


@query(
    "p07_p08_p09_transforms",
    f"""WITH {LINKS} SELECT series_id, row_idx, round(sqrt(packet_loss_pct), 8) AS root, round(greatest(0, sqrt(packet_loss_pct) * sqrt(packet_loss_pct)), 8) AS back,
  round(greatest(5.0, least(40.0, latency_ms)), 8) AS clipped FROM tele""",
)
def _(spark, sf):
    root = S.sqrt_loss("packet_loss_pct")
    return r8(
        links(spark, sf).select(
            "series_id",
            "row_idx",
            root.alias("root"),
            S.square_loss(root).alias("back"),
            S.clip("latency_ms", 5.0, 40.0).alias("clipped"),
        )
    )


def _lag_sql():
    cols = []
    for m in METRICS:
        cols += [f"round(lag({m}, {i}) OVER w, 8) AS {m}_lag_{i}" for i in range(1, 7)]
        for n in (3, 6):
            frame = f"OVER (ORDER_ ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)".replace("ORDER_", HISTORY)
            cols += [
                f"round(avg({m}) {frame}, 8) AS {m}_roll_mean_{n}",
                f"round(stddev_samp({m}) {frame}, 8) AS {m}_roll_std_{n}",
                f"round(max({m}) {frame}, 8) AS {m}_roll_max_{n}",
            ]
        cols.append(f"round(lag({m}) OVER w - lag({m}, 2) OVER w, 8) + 0.0 AS {m}_delta_1")
    return cols


@query(
    "w01_w02_w03_features",
    f"WITH {LINKS} SELECT * FROM (SELECT series_id, row_idx, {', '.join(_lag_sql())} FROM tele WINDOW w AS ({HISTORY})) WHERE row_idx >= 6",
)
def _(spark, sf):
    out = X.add_features(links(spark, sf), look_back=6)
    return r8(out.select("series_id", "row_idx", *[c for c in X.feature_names(6) if c not in X.CALENDAR_FEATURES]))


@query(
    "w01_w02_features_full_width",
    f"""WITH {LINKS}, f AS (SELECT series_id, row_idx, lag(traffic_mbps, 24) OVER w AS lag_24, lag(packet_loss_pct, 17) OVER w AS loss_17,
    avg(latency_ms) OVER ({HISTORY} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mean_24,
    stddev_samp(latency_ms) OVER ({HISTORY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS std_12 FROM tele WINDOW w AS ({HISTORY}))
SELECT series_id, count(*) AS n, round(sum(lag_24), 3) AS lag_24, round(sum(loss_17), 3) AS loss_17, round(sum(mean_24), 3) AS mean_24, round(sum(std_12), 3) AS std_12
FROM f WHERE row_idx >= 24 GROUP BY 1""",
)
def _(spark, sf):
    out = X.add_features(links(spark, sf), look_back=24)
    return out.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("traffic_mbps_lag_24"), 3).alias("lag_24"),
        F.round(F.sum("packet_loss_pct_lag_17"), 3).alias("loss_17"),
        F.round(F.sum("latency_ms_roll_mean_24"), 3).alias("mean_24"),
        F.round(F.sum("latency_ms_roll_std_12"), 3).alias("std_12"),
    )


@query(
    "w06_w07_w08_baselines",
    f"WITH {LINKS} SELECT series_id, row_idx, "
    + ", ".join(
        f"""round(coalesce(lag({m}) OVER w, {m}), 8) AS {m}__persistence,
  round(coalesce(avg({m}) OVER ({HISTORY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), {m}), 8) AS {m}__moving_average,
  round(coalesce(lag({m}, 24) OVER w, lag({m}) OVER w, {m}), 8) AS {m}__seasonal_naive"""
        for m in METRICS
    )
    + f" FROM tele WINDOW w AS ({HISTORY})",
)
def _(spark, sf):
    wide = B.add_baselines(links(spark, sf))
    return r8(
        wide.select(
            "series_id",
            "row_idx",
            *[f"{m}{B.suffix(x)}" for m in METRICS for x in ("Persistence", "Moving Average", "Seasonal Naive")],
        )
    )


@query("w09_linear_baseline")
def _(spark, sf):
    rows = links(spark, sf)
    wide = B.linear_regression(rows, fit_on=C.split_train(rows))
    return r8(B.long_forecasts(wide, ["Linear Regression"]))


@query(
    "w10_sequences",
    f"""WITH {LINKS}, s AS (SELECT *, list(traffic_mbps) OVER ({HISTORY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h FROM tele)
SELECT series_id, row_idx - 12 AS seq_idx, round(h[1], 8) AS oldest, round(h[12], 8) AS newest, CAST(len(h) AS BIGINT) AS n, round(traffic_mbps, 8) AS target FROM s WHERE row_idx >= 12""",
)
def _(spark, sf):
    seq = X.sequences(links(spark, sf), 12)
    return r8(
        seq.select(
            "series_id",
            "seq_idx",
            F.col("window")[0]["traffic_mbps"].alias("oldest"),
            F.col("window")[11]["traffic_mbps"].alias("newest"),
            F.size("window").cast("bigint").alias("n"),
            F.col("traffic_mbps").alias("target"),
        )
    )


@query(
    "w11_splits",
    f"""WITH {SPLITS}, seq AS (
  SELECT series_id, n_rows, s, v, greatest(v + 1, least(s - 1, CAST(floor(s * 0.82) AS BIGINT))) AS t FROM (
    SELECT DISTINCT series_id, n_rows, n_rows - 96 AS s, greatest(1, least(n_rows - 96 - 2, CAST(floor((n_rows - 96) * 0.7) AS BIGINT))) AS v FROM tele))
SELECT tele.series_id, row_idx, CASE WHEN row_idx < val_start THEN 'train' WHEN row_idx < test_start THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN row_idx < 96 THEN 'context' WHEN row_idx - 96 < v THEN 'train' WHEN row_idx - 96 < t THEN 'validation' ELSE 'test' END AS sequence_split
FROM tele JOIN bounds USING (series_id) JOIN seq USING (series_id)""",
)
def _(spark, sf):
    n = F.col("n_rows")
    rows = C.label_splits(links(spark, sf), *C.tabular_bounds(n))
    v, t = C.sequence_bounds(n - 96)
    at = F.col("row_idx") - 96
    return rows.select(
        "series_id",
        "row_idx",
        "split",
        F.when(at < 0, "context").when(at < v, "train").when(at < t, "validation").otherwise("test").alias("sequence_split"),
    )


@query(
    "w12_validation_persistence",
    f"WITH {SPLITS} SELECT t.series_id, " + ", ".join(f"round(avg(abs({m} - p_{m})), 8) AS {m}" for m in METRICS)
    + " FROM (SELECT *, " + ", ".join(f"lag({m}) OVER ({HISTORY}) AS p_{m}" for m in METRICS)
    + " FROM tele) t JOIN bounds b USING (series_id) WHERE row_idx >= val_start AND row_idx < test_start GROUP BY 1",
)
def _(spark, sf):
    val, test = C.tabular_bounds(F.col("n_rows"))
    wide = B.add_baselines(links(spark, sf), ["Persistence"])
    rows = wide.filter((F.col("row_idx") >= val) & (F.col("row_idx") < test))
    return r8(
        rows.groupBy("series_id").agg(*[F.avg(F.abs(F.col(m) - F.col(f"{m}__persistence"))).alias(m) for m in METRICS])
    )


@query(
    "w15_sampling_step",
    f"""WITH {LINKS}, gaps AS (SELECT series_id, CAST(epoch(ts) - epoch(lag(ts) OVER ({HISTORY})) AS BIGINT) AS gap FROM tele)
SELECT series_id, coalesce((SELECT g.gap FROM gaps g WHERE g.series_id = k.series_id AND gap IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gap LIMIT 1), 3600) AS step_seconds
FROM (SELECT DISTINCT series_id FROM tele) k""",
)
def _(spark, sf):
    return R.sampling_step(links(spark, sf))


@query(
    "p16_p17_p25_spike_rows",
    f"""WITH {SPLITS},{THRESHOLDS}, w AS (SELECT series_id, max(threshold) FILTER (metric='traffic_mbps') AS a, max(threshold) FILTER (metric='latency_ms') AS b, max(threshold) FILTER (metric='packet_loss_pct') AS c FROM thr GROUP BY 1)
SELECT series_id, row_idx, traffic_mbps > a AS traffic_spike, traffic_mbps > a OR latency_ms > b OR packet_loss_pct > c AS any_spike
FROM test JOIN w USING (series_id) WHERE traffic_mbps > a OR latency_ms > b OR packet_loss_pct > c""",
)
def _(spark, sf):
    rows = links(spark, sf)
    flagged = R.spike_rows(C.split_test(rows), E.quantile_thresholds(C.split_train(rows)))
    return flagged.select("series_id", "row_idx", "traffic_mbps_spike", "any_spike").withColumnRenamed(
        "traffic_mbps_spike", "traffic_spike"
    )


@query(
    "u01_u02_oversampling",
    f"""WITH {SPLITS}, thr AS (SELECT series_id, avg(traffic_mbps) + 1.2 * stddev_pop(traffic_mbps) AS a, avg(latency_ms) + 1.2 * stddev_pop(latency_ms) AS b, avg(packet_loss_pct) + 1.2 * stddev_pop(packet_loss_pct) AS c FROM train GROUP BY 1)
SELECT series_id, row_idx, unnest(range(1, CASE WHEN traffic_mbps > a OR latency_ms > b OR packet_loss_pct > c THEN 5 ELSE 2 END))::INT AS copy FROM train JOIN thr USING (series_id)""",
)
def _(spark, sf):
    rows = C.split_train(links(spark, sf))
    flagged = R.spike_rows(rows, E.spread_thresholds(rows, 1.2), only_spikes=False)
    return X.oversample(flagged, F.col("any_spike"), 3).select("series_id", "row_idx", "copy")


@query(
    "m01_target_scaler",
    f"""WITH {SPLITS},{melt('train', 'l')} SELECT series_id, metric, round(avg(value), 8) AS mean, round(coalesce(nullif(stddev_pop(value), 0), 1), 8) AS scale FROM l GROUP BY ALL""",
)
def _(spark, sf):
    return r8(X.target_scaler(C.split_train(links(spark, sf))))


@query(
    "m01_window_scaler",
    f"""WITH {LINKS}, used AS (SELECT *, CAST(floor((n_rows - 12) * 0.7) AS BIGINT) AS k FROM tele),
pairs AS (SELECT u.* FROM used u JOIN (SELECT DISTINCT series_id, unnest(range(0, k)) AS s FROM used) q
          ON u.series_id = q.series_id AND u.row_idx >= s AND u.row_idx < s + 12), {melt('pairs', 'v', 'v')}
SELECT series_id, metric, count(*) AS weight, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS scale FROM v GROUP BY ALL""",
)
def _(spark, sf):
    used = F.floor((F.col("n_rows") - 12) * F.lit(0.7))
    return r8(X.window_scaler(links(spark, sf), 12, used).select("series_id", "metric", "weight", "mean", "scale"))


@query(
    "m01_standardized",
    f"""WITH {SPLITS},{melt('train', 'l')},{melt('tele', 'a')}, sc AS (SELECT series_id, metric, avg(value) AS m, coalesce(nullif(stddev_pop(value), 0), 1) AS s FROM l GROUP BY ALL)
SELECT series_id, row_idx, metric, round((value - m) / s, 8) + 0.0 AS z FROM a JOIN sc USING (series_id, metric)""",
)
def _(spark, sf):
    rows = links(spark, sf)
    out = X.standardize(rows, X.target_scaler(C.split_train(rows)))
    return r8(out.select("series_id", "row_idx", "metric", "z"))


@query(
    "m08_instance_weights",
    f"""WITH {SPLITS},{THRESHOLDS} SELECT series_id, row_idx, round(1.8 * (1 + 4.0 * CAST(latency_ms > threshold AS DOUBLE) * 1.8), 8) AS weight
FROM train JOIN thr USING (series_id) WHERE metric = 'latency_ms'""",
)
def _(spark, sf):
    train = C.split_train(links(spark, sf))
    thr = E.quantile_thresholds(train).filter(F.col("metric") == "latency_ms").select("series_id", "threshold")
    return r8(
        train.join(thr, "series_id").select(
            "series_id", "row_idx", X.instance_weight("latency_ms", 1.8, F.col("threshold")).alias("weight")
        )
    )


# ---- reports over telemetry ----


@query(
    "a25_correlation",
    f"""WITH {LINKS} SELECT series_id, round(corr(traffic_mbps, latency_ms), 8) AS traffic_latency, round(corr(traffic_mbps, packet_loss_pct), 8) AS traffic_loss,
  round(corr(latency_ms, packet_loss_pct), 8) AS latency_loss,
  round(greatest(abs(corr(traffic_mbps, latency_ms)), abs(corr(traffic_mbps, packet_loss_pct)), abs(corr(latency_ms, packet_loss_pct))), 8) AS max_abs FROM tele GROUP BY 1""",
)
def _(spark, sf):
    return r8(R.correlations(links(spark, sf)))


@query(
    "a26_describe",
    f"""WITH {LINKS},{melt('tele', 'l')} SELECT series_id, metric, count(*) AS count, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std,
  round(min(value), 8) AS min, round(quantile_cont(value, 0.25), 8) AS q25, round(quantile_cont(value, 0.5), 8) AS q50, round(quantile_cont(value, 0.75), 8) AS q75, round(max(value), 8) AS max
FROM l GROUP BY ALL""",
)
def _(spark, sf):
    return r8(R.describe(links(spark, sf)))


@query(
    "a27_feature_relevance",
    f"""WITH {LINKS},{melt('tele', 'l')} SELECT series_id, metric, round(min(value), 8) AS min, round(max(value), 8) AS max, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std,
  CASE metric WHEN 'traffic_mbps' THEN 'primary load signal' WHEN 'latency_ms' THEN 'delay under load' ELSE 'congestion signal' END AS role FROM l GROUP BY ALL""",
)
def _(spark, sf):
    return r8(R.feature_relevance(links(spark, sf)))
