"""Profiles, experience, policy and candidate choice: A-24, A-32 .. A-34, J-07 .. J-09, M-15 .. M-19, T-*, W-14, SRC-09 .. SRC-12."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SCORED, THRESHOLDS, drawn, forecast_ctes, links, query, r8, table
from telespan.model import EXPERIENCE_SCHEMA, METRICS
from telespan.operators import evaluation as E
from telespan.operators import forecasts as C
from telespan.operators import policy as P
from telespan.operators import profile as F2
from telespan.plans import evaluate as V
from telespan.scratch import materialize, scratch_path
from telespan.sources import runs, writers

PROFILES = """, prof_rows AS (
  SELECT t.*, greatest(10, least(n_rows - 2, CAST(floor(n_rows * 0.7) AS BIGINT))) AS tr,
    lag(traffic_mbps) OVER w AS p1, lag(latency_ms) OVER w AS p2, lag(packet_loss_pct) OVER w AS p3
  FROM tele t WHERE n_rows >= 120 WINDOW w AS (PARTITION BY series_id ORDER BY row_idx)),
prof_mark AS (SELECT *, row_idx < tr AS is_tr, row_idx >= tr AND row_idx < greatest(tr + 2, least(n_rows, CAST(floor(n_rows * 0.82) AS BIGINT))) AS is_val FROM prof_rows),
prof_thr AS (SELECT series_id, quantile_cont(traffic_mbps, 0.9) AS h FROM prof_mark WHERE is_tr GROUP BY 1),
prof_sum AS (SELECT series_id, n_rows, count(*) FILTER (is_tr) AS train_rows_est, avg(traffic_mbps) FILTER (is_tr) AS mean, stddev_pop(traffic_mbps) FILTER (is_tr) AS traffic_std,
  stddev_pop(latency_ms) FILTER (is_tr) AS latency_std, stddev_pop(packet_loss_pct) FILTER (is_tr) AS loss_std, count(*) FILTER (is_tr AND traffic_mbps > h) / count(*) FILTER (is_tr) AS traffic_spike_rate,
  avg(abs(traffic_mbps - p1)) FILTER (is_val) AS mae_t, avg(abs(latency_ms - p2)) FILTER (is_val) AS mae_l, avg(abs(packet_loss_pct - p3)) FILTER (is_val) AS mae_p,
  greatest(coalesce(abs(corr(traffic_mbps, latency_ms)), 0), coalesce(abs(corr(traffic_mbps, packet_loss_pct)), 0), coalesce(abs(corr(latency_ms, packet_loss_pct)), 0)) AS r
  FROM prof_mark JOIN prof_thr USING (series_id) GROUP BY ALL),
profiles AS (SELECT *, CASE WHEN traffic_std / greatest(mean, 1e-9) > 0.6 THEN 'high' WHEN traffic_std / greatest(mean, 1e-9) > 0.25 THEN 'medium' ELSE 'low' END AS volatility,
  least(96, greatest(24, CAST(floor(n_rows * 0.05) AS BIGINT))) AS seq_len, CASE WHEN traffic_spike_rate < 0.05 THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS q,
  CASE WHEN n_rows >= 400 AND r > 0.95 OR n_rows < 400 OR 0.5 * mae_t + 0.25 * mae_l + 0.25 * mae_p < 0.5 THEN 'gb_only' WHEN traffic_std / greatest(mean, 1e-9) > 0.6 THEN 'hybrid_aggressive' ELSE 'hybrid' END AS trainer,
  CASE WHEN n_rows < 1000 THEN 40 ELSE 60 END AS epochs FROM prof_sum),
printed AS (SELECT *, substr(sha1(n_rows || '|' || volatility || '|' || CAST(round_even(traffic_spike_rate * 1000, 0) AS BIGINT) || '|' || CAST(round_even(traffic_std * 100, 0) AS BIGINT)), 1, 12) AS data_fingerprint FROM profiles)"""
WITH_PROFILES = SCORED + PROFILES


@query(
    "a24_p20_profiles",
    WITH_PROFILES + """SELECT series_id, n_rows AS rows, n_rows AS usable_rows, train_rows_est, round(traffic_std, 8) AS traffic_std, round(latency_std, 8) AS latency_std, round(loss_std, 8) AS loss_std,
  round(traffic_spike_rate, 8) AS traffic_spike_rate, round(mae_t, 8) AS mae_traffic_mbps, round(mae_l, 8) AS mae_latency_ms, round(mae_p, 8) AS mae_packet_loss_pct, volatility, seq_len AS recommended_sequence_length,
  least(24, greatest(4, seq_len // 2)) AS recommended_lookback, q AS recommended_spike_quantile, trainer AS recommended_trainer, epochs AS recommended_epochs FROM profiles""",
)
def _(spark, sf):
    p = F2.profile_series(links(spark, sf))
    mae = [F.element_at("persistence_mae", F.lit(m)).alias(f"mae_{m}") for m in METRICS]
    return r8(p.select(*[c for c in p.columns if c != "persistence_mae"], *mae))


def fingerprints(spark, sf, rows=None):
    return F2.with_fingerprint(F2.profile_series(rows if rows is not None else links(spark, sf)))


@query("p21_fingerprints", WITH_PROFILES + "SELECT series_id, data_fingerprint FROM printed")
def _(spark, sf):
    return fingerprints(spark, sf).select("series_id", "data_fingerprint")


# An experience log made from the scored methods: each method stands for one candidate.
CANDIDATE_OF = {"Persistence": "gb_spike", "Moving Average": "hybrid_default", "Seasonal Naive": "hybrid_aggressive"}
RECORDS = """, records AS (
  SELECT CAST(substr(series_id, 2) AS BIGINT) * 10 + CASE method WHEN 'Persistence' THEN 0 WHEN 'Moving Average' THEN 1 ELSE 2 END AS seq, series_id, data_fingerprint, volatility,
    CASE method WHEN 'Persistence' THEN 'gb_spike' WHEN 'Moving Average' THEN 'hybrid_default' ELSE 'hybrid_aggressive' END AS candidate_id, m.quality_pct
  FROM per_method m JOIN printed USING (series_id))"""
LOG = WITH_PROFILES + RECORDS
POLICY = """, by_c AS (SELECT candidate_id, avg(quality_pct) AS mean_quality, count(*) AS attempts FROM records GROUP BY 1),
by_fp AS (SELECT data_fingerprint, arg_max(candidate_id, (quality_pct, -seq)) AS best_candidate, avg(quality_pct) AS mean_quality, count(*) AS count FROM records GROUP BY 1),
by_vol AS (SELECT volatility, arg_max(candidate_id, (quality_pct, -seq)) AS best_candidate, avg(quality_pct) AS mean_quality, count(*) AS count FROM records GROUP BY 1)"""


def candidate_of():
    expr = None
    for method, name in CANDIDATE_OF.items():
        expr = F.when(F.col("method") == method, name) if expr is None else expr.when(F.col("method") == method, name)
    return expr


def experience(spark, sf, rows, profiles):
    number = F.when(F.col("method") == "Persistence", 0).when(F.col("method") == "Moving Average", 1).otherwise(2)
    return (
        E.compare_methods(V.score_naive(rows))
        .join(profiles.select("series_id", "data_fingerprint", "volatility"), "series_id")
        .select(
            (F.substring("series_id", 2, 18).cast("bigint") * 10 + number).alias("seq"),
            "series_id",
            "data_fingerprint",
            "volatility",
            candidate_of().alias("candidate_id"),
            "quality_pct",
        )
    )


def context(spark, sf):
    rows = links(spark, sf)
    profiles = fingerprints(spark, sf, rows)
    # The log is a table that many readers share, as an append log is.
    profiles = materialize(profiles, "profiles")
    return rows, profiles, materialize(experience(spark, sf, rows, profiles), "experience")


@query("a32_candidate_policy", LOG + POLICY + "SELECT candidate_id, round(mean_quality, 6) AS mean_quality, attempts FROM by_c")
def _(spark, sf):
    out = P.candidate_policy(context(spark, sf)[2])
    return out.withColumn("mean_quality", F.round("mean_quality", 6))


@query("a32_fingerprint_policy", LOG + POLICY + "SELECT data_fingerprint, best_candidate, round(mean_quality, 6) AS mean_quality, count FROM by_fp")
def _(spark, sf):
    out = P.group_policy(context(spark, sf)[2], "data_fingerprint")
    return out.withColumn("mean_quality", F.round("mean_quality", 6))


@query("a32_volatility_policy", LOG + POLICY + "SELECT volatility, best_candidate, round(mean_quality, 6) AS mean_quality, count FROM by_vol")
def _(spark, sf):
    out = P.group_policy(context(spark, sf)[2], "volatility")
    return out.withColumn("mean_quality", F.round("mean_quality", 6))


CANDIDATES = """, cand AS (
  SELECT series_id, data_fingerprint, volatility, epochs, seq_len, q, CAST(i - 1 AS INT) AS base_order, names[i] AS candidate_id, least(24, greatest(4, seq_len // 2)) AS look_back FROM (
    SELECT *, unnest(range(1, 9)) AS i FROM (SELECT *, CASE trainer
      WHEN 'gb_only' THEN ['gb_spike_deep','gb_spike','hybrid_r2_recovery','hybrid_short_seq','hybrid_default','hybrid_aggressive','hybrid_gb_heavy','hybrid_low_quantile']
      WHEN 'hybrid_aggressive' THEN ['hybrid_aggressive','hybrid_r2_recovery','hybrid_low_quantile','hybrid_gb_heavy','hybrid_default','gb_spike','gb_spike_deep','hybrid_short_seq']
      ELSE ['hybrid_default','hybrid_r2_recovery','hybrid_aggressive','hybrid_gb_heavy','gb_spike','gb_spike_deep','hybrid_short_seq','hybrid_low_quantile'] END AS names FROM printed)))"""


@query(
    "m15_j09_candidates",
    LOG + CANDIDATES + """SELECT series_id, base_order, candidate_id, CASE WHEN candidate_id LIKE 'gb%' THEN 'gb' ELSE 'enhanced' END AS trainer, CASE candidate_id
  WHEN 'hybrid_default' THEN '--epochs ' || epochs || ' --sequence-length ' || seq_len || ' --spike-quantile ' || q
  WHEN 'hybrid_aggressive' THEN '--epochs ' || (epochs + 20) || ' --sequence-length ' || seq_len || ' --spike-quantile 0.85 --spike-weight 8 --focal-gamma 1.0'
  WHEN 'gb_spike' THEN '--lookback ' || look_back || ' --spike-oversample 4'
  WHEN 'hybrid_short_seq' THEN '--epochs ' || epochs || ' --sequence-length 48 --spike-quantile ' || q
  WHEN 'hybrid_gb_heavy' THEN '--epochs ' || epochs || ' --sequence-length ' || seq_len
  WHEN 'gb_spike_deep' THEN '--lookback 36 --spike-oversample 6'
  WHEN 'hybrid_low_quantile' THEN '--epochs ' || (epochs + 20) || ' --sequence-length ' || seq_len || ' --spike-quantile 0.82 --spike-weight 10 --spike-lift-near 1.0,0.9,0.95 --spike-lift-factors 1.05,1.01,1.05'
  ELSE '--epochs ' || (epochs + 20) || ' --sequence-length 24 --spike-quantile 0.85 --spike-weight 8.0 --focal-gamma 0.5 --feature-spike-multipliers 1.0,1.8,2.5' END AS args FROM cand""",
)
def _(spark, sf):
    out = P.candidates(fingerprints(spark, sf))
    return out.select("series_id", "base_order", "candidate_id", "trainer", F.array_join("candidate_args", " ").alias("args"))


NORM = "CASE WHEN {0} > 1 THEN {0} / 100 ELSE greatest(0, least(1, {0})) END"
RANKED = CANDIDATES + f""", tot AS (SELECT greatest(1, count(*)) AS t FROM records),
h AS (SELECT c.*, {NORM.format('coalesce(g.mean_quality, 50.0)')} AS h0, g.attempts, f.best_candidate AS fb, {NORM.format('f.mean_quality')} AS fm, v.best_candidate AS vb, {NORM.format('v.mean_quality')} AS vm, t
  FROM cand c LEFT JOIN by_c g USING (candidate_id) LEFT JOIN by_fp f USING (data_fingerprint) LEFT JOIN by_vol v USING (volatility), tot),
h1 AS (SELECT *, CASE WHEN fb = candidate_id THEN greatest(h0, fm) ELSE h0 END AS h1 FROM h),
h2 AS (SELECT *, CASE WHEN vb = candidate_id THEN greatest(h1, vm) ELSE h1 END AS h2 FROM h1),
scores AS (SELECT series_id, candidate_id, base_order, 0.6 * h2 + 0.2 * (100.0 - base_order * 10) / 100.0 + 0.2 * sqrt(2 * ln(t + 1) / greatest(coalesce(attempts, 0), 1)) AS score FROM h2
  WHERE (series_id, candidate_id) NOT IN (SELECT (series_id, candidate_id) FROM records WHERE seq % 10 = 0))"""


@query(
    "m16_j07_j08_t02_ranking",
    LOG + POLICY + RANKED + "SELECT series_id, candidate_id, base_order, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9) DESC, base_order) AS INT) AS rank FROM scores",
)
def _(spark, sf):
    _, profiles, records = context(spark, sf)
    tried = records.filter(F.col("seq") % 10 == 0)
    out = P.rank_candidates(P.candidates(profiles), records, tried)
    return out.withColumn("score", F.round("score", 6))


@query(
    "m17_ucb1",
    LOG + CANDIDATES + f""", kept AS (SELECT * FROM records UNION ALL SELECT seq, series_id, data_fingerprint, volatility, c, quality_pct FROM records, (VALUES ('gb_spike_deep'), ('hybrid_gb_heavy'), ('hybrid_low_quantile'), ('hybrid_r2_recovery'), ('hybrid_short_seq')) x(c) WHERE seq % 20 = 1),
s AS (SELECT candidate_id, avg(quality_pct) AS m, count(*) AS n FROM kept GROUP BY 1), t AS (SELECT count(*) AS t FROM kept)
SELECT series_id, arg_max(candidate_id, (round({NORM.format('m')} + sqrt(2 * ln(t) / n), 9), -base_order)) AS candidate_id FROM cand JOIN s USING (candidate_id), t GROUP BY 1""",
)
def _(spark, sf):
    """Every candidate has records here, so the upper bounds decide."""
    _, profiles, records = context(spark, sf)
    others = F.array(*[F.lit(c) for c in P.ORDERS["gb_only"] if c not in CANDIDATE_OF.values()])
    names = F.when(F.col("seq") % 20 == 1, F.concat(F.array("candidate_id"), others)).otherwise(F.array("candidate_id"))
    kept = records.withColumn("candidate_id", F.explode(names))
    return P.ucb1(P.candidates(profiles), kept)


@query("m17_ucb1_untried", LOG + CANDIDATES + "SELECT series_id, arg_min(candidate_id, base_order) AS candidate_id FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM records) GROUP BY 1")
def _(spark, sf):
    _, profiles, records = context(spark, sf)
    return P.ucb1(P.candidates(profiles), records)


@query(
    "m18_rule_fallback",
    LOG + CANDIDATES + """, att AS (SELECT g.*, CASE g.method WHEN 'Persistence' THEN 0 WHEN 'Moving Average' THEN 1 ELSE 2 END AS attempt, c.gain AS traffic_gain,
  CASE g.method WHEN 'Persistence' THEN 'gb_spike' WHEN 'Moving Average' THEN 'hybrid_default' ELSE 'hybrid_aggressive' END AS candidate_id
  FROM gated g JOIN compared c ON g.series_id = c.series_id AND g.method = c.method AND c.metric = 'traffic_mbps'),
pref AS (SELECT series_id, CASE WHEN NOT quality_ge_90 AND quality_pct < 80 AND NOT traffic_spike_f1_ge_0_50 THEN 'hybrid_aggressive' WHEN NOT quality_ge_90 AND quality_pct < 80 THEN 'hybrid_r2_recovery'
  WHEN NOT beats_persistence_each_feature_mae AND traffic_gain < 0 THEN 'hybrid_gb_heavy' WHEN NOT beats_persistence_each_feature_mae THEN 'gb_spike' WHEN NOT traffic_spike_f1_ge_0_50 THEN 'hybrid_aggressive' END AS preferred
  FROM att WHERE attempt = 2)
SELECT series_id, arg_min(candidate_id, (CASE WHEN candidate_id = preferred THEN 0 ELSE 1 END, base_order)) AS candidate_id FROM cand JOIN pref USING (series_id)
WHERE (series_id, candidate_id) NOT IN (SELECT (series_id, candidate_id) FROM att) GROUP BY 1""",
)
def _(spark, sf):
    rows = links(spark, sf)
    scored = V.score_naive(rows)
    gain = E.compare_with_baseline(scored).filter(F.col("metric") == "traffic_mbps").select(
        "series_id", "method", F.col("mae_improvement_pct").alias("traffic_gain")
    )
    number = F.when(F.col("method") == "Persistence", 0).when(F.col("method") == "Moving Average", 1).otherwise(2)
    attempts = (
        E.gates(scored).join(gain, ["series_id", "method"]).withColumns({"candidate_id": candidate_of(), "attempt": number})
    )
    return P.rule_fallback(P.candidates(fingerprints(spark, sf, rows)), attempts)


@query(
    "m19_deploy_gate",
    "WITH " + SCORED.split("WITH ", 1)[1] + """, l AS (SELECT series_id, method, sum(x) AS loss FROM (SELECT series_id, method, metric, avg((predicted - actual) * (predicted - actual) * (CASE metric WHEN 'traffic_mbps' THEN 1.0 WHEN 'latency_ms' THEN 1.8 ELSE 2.5 END)
  * (1 + 4.0 * CAST(actual > threshold AS INT) * (CASE metric WHEN 'traffic_mbps' THEN 1.0 WHEN 'latency_ms' THEN 1.8 ELSE 2.5 END))) AS x FROM fc JOIN thr USING (series_id, metric) GROUP BY ALL) GROUP BY ALL)
SELECT series_id, CASE WHEN max(loss) FILTER (method = 'Moving Average') > max(loss) FILTER (method = 'Persistence') THEN 'baseline' ELSE 'challenger' END AS deployed FROM l GROUP BY 1""",
)
def _(spark, sf):
    rows = links(spark, sf)
    thr = E.quantile_thresholds(C.split_train(rows))
    loss = E.spike_weighted_error(V.test_forecasts(rows, ["Persistence", "Moving Average"]), thr)
    return P.deploy_gate(loss.filter(F.col("method") == "Moving Average"), loss.filter(F.col("method") == "Persistence"))


@query(
    "t05_similar_records",
    LOG + ", pick AS (SELECT * FROM records WHERE volatility = 'medium' ORDER BY seq DESC LIMIT 50) SELECT seq, candidate_id, round(quality_pct, 6) AS quality_pct FROM pick UNION ALL SELECT seq, candidate_id, round(quality_pct, 6) FROM (SELECT * FROM records ORDER BY seq DESC LIMIT 50) WHERE NOT EXISTS (SELECT 1 FROM pick)",
)
def _(spark, sf):
    """The volatility stands in for the fingerprint, so that several records match."""
    records = context(spark, sf)[2].withColumn("data_fingerprint", F.col("volatility"))
    out = P.similar_records(records, "medium", 50)
    return out.select("seq", "candidate_id", F.round("quality_pct", 6).alias("quality_pct"))


@query("t05_last_records", LOG + "SELECT data_fingerprint, seq FROM (SELECT *, row_number() OVER (PARTITION BY data_fingerprint ORDER BY seq DESC) AS r FROM records) WHERE r <= 2")
def _(spark, sf):
    return P.last_records(context(spark, sf)[2], "data_fingerprint", 2).select("data_fingerprint", "seq")


@query(
    "t06_random_order",
    LOG + CANDIDATES + f"SELECT series_id, candidate_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY {drawn(7, 'series_id', 'candidate_id')}, candidate_id) AS INT) AS rank FROM cand",
)
def _(spark, sf):
    return P.random_order(P.candidates(fingerprints(spark, sf)), 7)


@query("t03_leaderboard", SCORED + "SELECT series_id || '/' || method AS run, round(CASE WHEN method <> 'Seasonal Naive' THEN quality_pct END, 6) AS quality FROM per_method")
def _(spark, sf):
    runs_ = E.compare_methods(V.score_naive(links(spark, sf))).select(
        F.concat_ws("/", "series_id", "method").alias("run"),
        F.round(F.when(F.col("method") != "Seasonal Naive", F.col("quality_pct")), 6).alias("quality"),
    )
    return P.leaderboard(runs_)


@query("t04_best_run", SCORED + "SELECT series_id, arg_min(method, (round(mae, 9), method)) AS best FROM per_method GROUP BY 1")
def _(spark, sf):
    return P.best_run(E.compare_methods(V.score_naive(links(spark, sf))), "mae", ["series_id"])


@query(
    "t07_latest_complete_run",
    "SELECT arg_max(run, (m, run)) AS run, CAST(epoch(max(m)) AS BIGINT) AS mtime FROM (SELECT user_id AS run, max(ts) AS m FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5)",
)
def _(spark, sf):
    from telespan.functions.scalar import epoch_seconds

    artifacts = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("artifact"), F.col("ts").alias("mtime")
    )
    out = P.latest_complete(artifacts, ["error", "click", "view", "signup", "purchase"])
    return out.select("run", epoch_seconds("mtime").alias("mtime"))


@query(
    "w14_running_best",
    """WITH a AS (SELECT 's' || (user_id % 8) AS series_id, event_id AS attempt, value AS quality_pct FROM events)
SELECT series_id, attempt, quality_pct, max(quality_pct) OVER w AS best_quality, arg_max(attempt, (quality_pct, -attempt)) OVER w AS best_attempt FROM a WINDOW w AS (PARTITION BY series_id ORDER BY attempt)""",
)
def _(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("series_id"),
        F.col("event_id").alias("attempt"),
        F.col("value").alias("quality_pct"),
    )
    return P.running_best(attempts)


@query(
    "a33_spike_ablation",
    SCORED + "SELECT method AS condition, metric AS feature, round(avg(mae), 6) AS mean_mae, round(stddev_pop(mae), 6) AS std_mae, round(avg(f1), 6) AS mean_spike_f1, round(stddev_pop(f1), 6) AS std_spike_f1 FROM scored GROUP BY ALL",
)
def _(spark, sf):
    rows = V.score_naive(links(spark, sf)).select(
        F.col("method").alias("condition"), F.col("metric").alias("feature"), "mae", F.col("f1").alias("spike_f1")
    )
    out = P.spike_ablation_summary(rows)
    return out.select("condition", "feature", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    "a34_selection_ablation",
    SCORED + "SELECT method AS strategy, min(CAST(substr(series_id, 2) AS BIGINT)) FILTER (quality_pct >= 45) AS attempts_to_gate, round(max(quality_pct), 6) AS best_quality_pct, round(avg(quality_pct), 6) AS mean_quality_pct, round(stddev_pop(quality_pct), 6) AS std_quality_pct FROM per_method GROUP BY 1",
)
def _(spark, sf):
    rows = E.compare_methods(V.score_naive(links(spark, sf))).select(
        F.col("method").alias("strategy"), F.substring("series_id", 2, 18).cast("bigint").alias("attempt"), "quality_pct"
    )
    out = P.selection_ablation_summary(rows, 45.0)
    return out.select("strategy", "attempts_to_gate", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("src09_experience_log", LOG + "SELECT seq, data_fingerprint, candidate_id, round(quality_pct, 6) AS quality_pct, volatility FROM records")
def _(spark, sf):
    """Records appended as JSON lines and scanned again with the fixed schema."""
    records = context(spark, sf)[2].withColumn("profile", F.struct("volatility"))
    path = scratch_path(spark, "experience")
    writers.append_json(records.select("seq", "data_fingerprint", "profile", "candidate_id", "quality_pct"), path)
    out = runs.read_experience(spark, path)
    return out.select(
        "seq", "data_fingerprint", "candidate_id", F.round("quality_pct", 6).alias("quality_pct"), F.col("profile.volatility").alias("volatility")
    )


@query(
    "src11_complete_runs",
    SCORED + "," + forecast_ctes("val", "vfc") + ", parts AS (SELECT method AS run_id, 'test' AS split, series_id, metric, row_idx FROM fc UNION ALL SELECT method, 'validation', series_id, metric, row_idx FROM vfc WHERE method <> 'Seasonal Naive') SELECT run_id, split, count(*) AS rows FROM parts WHERE run_id <> 'Seasonal Naive' GROUP BY ALL",
)
def _(spark, sf):
    rows = links(spark, sf)
    both = V.test_forecasts(rows).withColumn("split", F.lit("test")).unionByName(
        V.validation_forecasts(rows).withColumn("split", F.lit("validation")).filter(F.col("method") != "Seasonal Naive")
    )
    whole = runs.complete_runs(both.withColumnRenamed("method", "run_id"))
    return whole.groupBy("run_id", "split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "src12_traffic_f1",
    SCORED + "SELECT series_id, method, round(CASE WHEN method = 'Moving Average' THEN 0 ELSE traffic_f1 END, 8) AS traffic_spike_f1 FROM per_method",
)
def _(spark, sf):
    scored = V.score_naive(links(spark, sf))
    runs_ = scored.select("series_id", "method").distinct()
    return r8(runs.traffic_f1(runs_, scored.filter(F.col("method") != "Moving Average")))


@query(
    "snk02_src10_run_summaries",
    SCORED + "SELECT 'run=' || replace(method, ' ', '%20') AS run, round(avg(quality_pct), 6) AS quality, round(avg(mae_improvement_pct), 6) AS gain, count(*) AS rows, CAST(0 AS BIGINT) AS epochs, 'unknown' AS model FROM per_method GROUP BY method",
)
def _(spark, sf):
    """Nested summaries written as one JSON file per run and scanned again."""
    gates = E.gates(V.score_naive(links(spark, sf)))
    overall = F.struct(
        F.round(F.avg("quality_pct"), 6).alias("normalized_quality_pct"),
        (F.round(F.avg("mae_improvement_pct"), 6) + 0.0).alias("mae_improvement_vs_persistence_pct"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(0).cast("bigint").alias("epochs"),
    )
    path = scratch_path(spark, "summaries")
    gates.groupBy(F.col("method").alias("run")).agg(overall.alias("overall")).write.partitionBy("run").json(path)
    return runs.read_run_summaries(spark, f"{path}/*")


@query(
    "snk02_nested_report",
    SCORED + "SELECT series_id, method, CAST(3 AS INT) AS metrics, round(quality_pct, 6) AS quality_pct, quality_ge_90 FROM gated",
)
def _(spark, sf):
    rows = links(spark, sf)
    scored = V.score_naive(rows)
    gates = E.gates(scored)
    overall = gates.select("series_id", "method", "quality_pct")
    path = scratch_path(spark, "report")
    writers.write_report(writers.run_summary(overall, E.compare_with_baseline(scored), gates), path, "json")
    out = spark.read.schema(
        "series_id string, method string, overall struct<quality_pct: double>, per_feature array<struct<metric: string>>, gates_passed map<string, boolean>"
    ).json(path)
    return out.select(
        "series_id",
        "method",
        F.size("per_feature").alias("metrics"),
        F.round("overall.quality_pct", 6).alias("quality_pct"),
        F.element_at("gates_passed", "quality_ge_90").alias("quality_ge_90"),
    )
