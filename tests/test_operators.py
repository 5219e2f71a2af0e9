import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.functions import scalar as S
from telespan.functions.stats import student_t_p
from telespan.model import METRICS, require_columns
from telespan.operators import evaluation as E
from telespan.operators import policy as P
from telespan.operators import significance as G
from telespan.sources import counters, flows, runs, telemetry


def test_p_values_match_t_tables(spark):
    def p(*pairs):
        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, t double, df double")
        return [r["p"] for r in rows.select("i", student_t_p(F.col("t"), F.col("df")).alias("p")).orderBy("i").collect()]

    # Two-sided 5 % and 1 % points of Student's t.
    assert p((12.7062, 1.0), (2.2281, 10.0), (1.9840, 100.0)) == pytest.approx([0.05] * 3, abs=2e-5)
    assert p((63.6567, 1.0), (-3.1693, 10.0), (2.6259, 100.0)) == pytest.approx([0.01] * 3, abs=2e-5)
    assert p((0.0, 5.0), (None, 5.0), (float("nan"), 5.0), (1.0, 0.0), (1.0, None)) == [1.0] * 5
    assert p((float("inf"), 5.0), (1e200, 3.0)) == [0.0, 0.0] and 0 <= p((80.0, 1e6))[0] < 1e-12
    # Closed forms at one and two degrees of freedom, and the normal limit.
    ts = [1e-9, 0.01, 0.5, 1.0, 1.7, 1.74, 2.0, 5.0, 1e3, 1e7]
    assert p(*[(t, 1.0) for t in ts]) == pytest.approx([1 - 2 * math.atan(t) / math.pi for t in ts], abs=1e-13)
    assert p(*[(t, 2.0) for t in ts]) == pytest.approx([1 - t / math.sqrt(2 + t * t) for t in ts], abs=1e-13)
    # Even degrees of freedom: a finite sum.
    def even(t, df):
        c2, term, total = df / (df + t * t), 1.0, 1.0
        for k in range(1, df // 2):
            term *= c2 * (2 * k - 1) / (2 * k)
            total += term
        return 1 - t / math.sqrt(df + t * t) * total

    cases = [(t, df) for df in (4, 10, 48, 1000) for t in ts[:8]]
    assert p(*[(t, float(df)) for t, df in cases]) == pytest.approx([even(t, df) for t, df in cases], abs=1e-12)
    normal = [math.erfc(t / math.sqrt(2)) for t in ts[:8]]
    assert p(*[(t, 1e12) for t in ts[:8]]) == pytest.approx(normal, abs=5e-8)


def test_flow_log_single_bin(spark):
    rows = [("a", f"2024-01-01 00:00:{12 * i:02d}", r * 1e6, d, 0, 0) for i, (r, d) in enumerate(zip((1.0, 2.0, 1.5, 1.0, 0.5), (1.0, 2.0, 1.5, 1.0, 0.5)))]
    rows += [("a", "bad time", 9e9, 1.0, 1, 1), ("a", "2024-01-01 00:00:59", float("inf"), None, 0, 0)]
    names = "series_id string, Timestamp string, `Flow Bytes/s` double, `Flow Duration` double, `PSH Flag Count` int, `RST Flag Count` int"
    out = flows.bin_flow_log(spark.createDataFrame(rows, names)).collect()
    assert len(out) == 1
    assert (out[0]["traffic_mbps"], out[0]["latency_ms"], out[0]["packet_loss_pct"]) == (6.0, 1.2, 0.0)


def test_flow_log_needs_time_only(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:01")], "series_id string, Timestamp string")
    row = flows.bin_flow_log(df).first()
    assert (row["traffic_mbps"], row["latency_ms"], row["packet_loss_pct"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        flows.bin_flow_log(df.drop("Timestamp"))


def test_flow_counts(spark):
    rows = [(f"2024-01-01 {h:02d}:00:00", str(w), 1, str(float(10 * h + w))) for h in range(8) for w in (1, 2)]
    df = spark.createDataFrame(rows, "date string, l_ipn string, r_asn long, f string")
    out = flows.with_deltas(flows.telemetry_from_counts(df, only="key", key=1)).orderBy("row_idx").toPandas()
    assert len(out) == 8 and out["timestamp"].is_monotonic_increasing
    f = np.array([10.0 * h + 1 for h in range(8)])
    n = (f - f.min()) / (f.max() - f.min())
    np.testing.assert_array_equal(out["traffic_mbps"], np.round(10 + 140 * n, 3))
    high = 10 + 140 * n > np.quantile(10 + 140 * n, 0.88)
    np.testing.assert_array_equal(out["packet_loss_pct"], np.round(np.where(high, 0.2 + 2.3 * n, 0), 3))
    assert out["traffic_delta"].iloc[0] == 0 and (out[METRICS] >= 0).all().all()


def test_scan_rejects_short_series_and_bad_rows(spark):
    rows = [("ok", f"2024-01-01 {i % 24:02d}:00:00", 1.0, 1.0, 0.0) for i in range(40)]
    rows += [("short", "2024-01-01 00:00:00", 1.0, 1.0, 0.0), ("ok", "nonsense", 1.0, 1.0, 0.0), ("ok", "2024-01-02 00:00:00", float("nan"), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "series_id string, timestamp string, traffic_mbps double, latency_ms double, packet_loss_pct double")
    assert telemetry.scan(df).count() == 40
    assert [r["series_id"] for r in telemetry.rejected(df).collect()] == ["short"]
    with pytest.raises(ValueError):
        require_columns(df, ["absent"])


def test_scores_gates_and_transforms(spark):
    fc = [("a", i, "Model", m, float(a), float(p)) for m, pairs in {
        "traffic_mbps": [(1, 1), (10, 11)], "latency_ms": [(10, 10), (12, 40)], "packet_loss_pct": [(0, 0), (3, 0)]}.items()
        for i, (a, p) in enumerate(pairs)]
    forecasts = spark.createDataFrame(fc, "series_id string, row_idx long, method string, metric string, actual double, predicted double")
    train = spark.createDataFrame([("a", 1.0, 10.0, 0.0), ("a", 2.0, 11.0, 0.1), ("a", 10.0, 30.0, 2.0)], "series_id string, traffic_mbps double, latency_ms double, packet_loss_pct double")
    thresholds = E.quantile_thresholds(train, 0.8)
    want = {m: np.quantile(v, 0.8) for m, v in zip(METRICS, ([1, 2, 10], [10, 11, 30], [0, 0.1, 2]))}
    got = {r["metric"]: r for r in E.spike_scores(forecasts, thresholds).collect()}
    assert {m: got[m]["threshold"] for m in METRICS} == pytest.approx(want)
    assert got["traffic_mbps"]["f1"] == pytest.approx(1.0)
    assert got["latency_ms"]["predicted_spikes"] == 1 and got["packet_loss_pct"]["actual_spikes"] == 1
    row = spark.range(1).select(
        S.square_loss(S.sqrt_loss(F.lit(1.5))).alias("back"), S.normalize_quality(F.lit(91.0)).alias("q"),
        S.normalize_quality(F.lit(0.5)).alias("f"), S.round3(F.lit(0.0125)).alias("r"),
        S.parse_metric_values(F.lit("1.0, 1.8,2.5")).alias("v"),
    ).first()
    assert row["back"] == pytest.approx(1.5) and row["q"] == 0.91 and row["f"] == 0.5 and row["r"] == np.round(0.0125, 3)
    assert row["v"] == [1.0, 1.8, 2.5]


def test_significance(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 200), rng.normal(0, 5, 200)
    pairs = spark.createDataFrame(
        [("a", "diff", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
        + [("a", "same", i, float(x), float(x)) for i, x in enumerate(a[:100])],
        "series_id string, metric string, row_idx long, e_model double, e_base double",
    )
    dm = {r["metric"]: r for r in G.with_p_value(G.diebold_mariano(pairs), "dm_stat", "p").collect()}
    t = {r["metric"]: r for r in G.with_p_value(G.paired_t_test(pairs), "t_stat", "p").collect()}
    d = a**2 - b**2
    assert dm["diff"]["dm_stat"] == pytest.approx(d.mean() / np.sqrt(d.var() / 200) * np.sqrt(199 / 200))
    assert dm["diff"]["p"] < 0.05 and t["diff"]["p"] < 0.05
    assert (dm["same"]["dm_stat"], dm["same"]["p"], t["same"]["t_stat"], t["same"]["p"]) == (0.0, 1.0, 0.0, 1.0)
    both = {r["feature"]: r for r in G.significance(pairs).collect()}
    for metric in ("diff", "same"):
        assert both[metric]["diebold_mariano_stat"] == dm[metric]["dm_stat"] and both[metric]["paired_t_stat"] == t[metric]["t_stat"]
        assert both[metric]["diebold_mariano_p_value"] == dm[metric]["p"] and both[metric]["paired_t_p_value"] == t[metric]["p"]
    # Lag terms: chunks of the series give the same statistic.
    whole, cut = G.diebold_mariano(pairs, h=4), G.diebold_mariano(pairs, h=4, chunk_rows=16)
    get = lambda df: {r["metric"]: r["dm_stat"] for r in df.collect()}
    assert get(whole) == pytest.approx(get(cut))


def test_policy_and_choice(spark):
    profile = spark.createDataFrame(
        [("a", "hybrid", 40, 96, 24, 0.9, "medium", "fp1")],
        "series_id string, recommended_trainer string, recommended_epochs int, recommended_sequence_length long, recommended_lookback long, recommended_spike_quantile double, volatility string, data_fingerprint string",
    )
    table = P.candidates(profile)
    assert [r["candidate_id"] for r in table.orderBy("base_order").collect()] == P.ORDERS["hybrid"]
    records = spark.createDataFrame(
        [(1, "gb_spike", 91.0, "fp1", "medium"), (2, "hybrid_default", 91.0, "fp1", "medium"), (3, "hybrid_default", 40.0, "fp2", "low")],
        "seq long, candidate_id string, quality_pct double, data_fingerprint string, volatility string",
    )
    assert P.group_policy(records, "data_fingerprint").filter("data_fingerprint = 'fp1'").first()["best_candidate"] == "gb_spike"
    assert {r["candidate_id"]: r["mean_quality"] for r in P.candidate_policy(records).collect()} == {"gb_spike": 91.0, "hybrid_default": 65.5}
    assert P.ucb1(table, records).first()["candidate_id"] == "hybrid_r2_recovery"
    assert [r["seq"] for r in P.similar_records(records, "none", 2).orderBy("seq").collect()] == [2, 3]
    assert [r["seq"] for r in P.similar_records(records, "fp2", 2).collect()] == [3]
    loss = lambda x: spark.createDataFrame([("a", x)], "series_id string, weighted_loss double")
    assert P.deploy_gate(loss(0.40), loss(0.20)).first()["deployed"] == "baseline"
    assert P.deploy_gate(loss(0.15), loss(0.20)).first()["deployed"] == "challenger"


def test_running_best_over_chunks(spark):
    quality = [5.0, 3.0, 5.0, 7.0, 1.0, 7.0, 6.0, 9.0]
    df = spark.createDataFrame([("a", i, q) for i, q in enumerate(quality)], "series_id string, attempt long, quality_pct double")
    out = P.running_best(df, chunk_rows=3).orderBy("attempt").collect()
    assert [r["best_attempt"] for r in out] == [0, 0, 0, 3, 3, 3, 3, 7]


def test_selection_summary_of_published_attempts(spark):
    # Published quality of six attempts per order.
    fixed = [80.63333500723138, 80.6689718337698, 81.33861327600773, 73.6836253947528, 73.6836253947528, 68.43059115293705]
    df = spark.createDataFrame([("fixed", i + 1, q) for i, q in enumerate(fixed)], "strategy string, attempt int, quality_pct double")
    row = P.selection_ablation_summary(df).first()
    assert row["attempts_to_gate"] is None
    assert row["mean_quality_pct"] == pytest.approx(76.40646034324192) and row["std_quality_pct"] == pytest.approx(4.809777469530696)


def test_counters_and_probes(spark):
    from datetime import datetime as D

    rows = [(D(2024, 1, 1, 0, m), n, i, rx, 0) for m, n, i, rx in [
        (0, "x", "eth1", 0), (1, "x", "eth1", 1_000_000), (2, "x", "eth1", 500), (0, "y", "eth2", 0), (2, "y", "eth2", 2_000_000),
        (0, "x", "lo", 0), (1, "x", "lo", 9_000_000)]]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, node string, iface string, rx_bytes long, tx_bytes long")
    out = [r["traffic_mbps"] for r in counters.traffic_rate(df, 1).orderBy("timestamp").collect()]
    assert out == [0.0, 8.0, 16.0]  # a reset counts as 0; a missing sample falls back to the last known total
    text = "Inter-| Receive\n eth1: 10 0 0 0 0 0 0 0 20 0 0 0 0 0 0 0\n short: 1 2\n"
    parsed = counters.parse_interface_text(spark.createDataFrame([("n", text)], "node string, text string")).collect()
    assert [(r["iface"], r["rx_bytes"], r["tx_bytes"]) for r in parsed] == [("eth1", 10, 20)]
    pings = [("l1", "4 received, 20% packet loss\nrtt min/avg/max/mdev = 0.1/2.5/9/1 ms"), ("l2", "100% packet loss"), ("l3", ""), ("z-spine1", "0% packet loss")]
    df = spark.createDataFrame([(D(2024, 1, 1), n, t) for n, t in pings], "ts timestamp_ntz, node string, output string")
    row = counters.probe_means(df).first()
    assert (row["latency_ms"], row["packet_loss_pct"]) == (2.5, 60.0)


def test_experience_and_summary_files(spark, tmp_path):
    (tmp_path / "memory.jsonl").write_text('{"candidate_id": "gb_spike", "quality_pct": 91.0, "gates_passed": {"a": true}}\n\n', encoding="utf-8")
    row = runs.read_experience(spark, str(tmp_path / "memory.jsonl")).collect()
    assert len(row) == 1 and row[0]["quality_pct"] == 91.0 and row[0]["gates_passed"] == {"a": True}
    run = tmp_path / "runs" / "r1" / "json"
    run.mkdir(parents=True)
    (run / "evaluation_summary.json").write_text('{\n "overall": {"normalized_quality_pct": 80.5, "rows": 10, "epochs": 3}\n}')
    out = runs.read_run_summaries(spark, str(tmp_path / "runs" / "*" / "json" / "*.json")).first()
    assert (out["run"], out["quality"], out["rows"], out["model"]) == ("r1", 80.5, 10, "unknown")
