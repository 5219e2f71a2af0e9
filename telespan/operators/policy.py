"""Experience log, policy tables and candidate choice (A-32 .. A-34, J-07 .. J-09, M-15 .. M-19, T-02 .. T-07, W-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telespan.functions import scalar as S
from telespan.functions.scalar import normalize_quality
from telespan.operators.layout import CHUNK_ROWS, index_rows

# Candidate order per recommended trainer.
ORDERS = {
    "gb_only": [
        "gb_spike_deep",
        "gb_spike",
        "hybrid_r2_recovery",
        "hybrid_short_seq",
        "hybrid_default",
        "hybrid_aggressive",
        "hybrid_gb_heavy",
        "hybrid_low_quantile",
    ],
    "hybrid_aggressive": [
        "hybrid_aggressive",
        "hybrid_r2_recovery",
        "hybrid_low_quantile",
        "hybrid_gb_heavy",
        "hybrid_default",
        "gb_spike",
        "gb_spike_deep",
        "hybrid_short_seq",
    ],
    "hybrid": [
        "hybrid_default",
        "hybrid_r2_recovery",
        "hybrid_aggressive",
        "hybrid_gb_heavy",
        "gb_spike",
        "gb_spike_deep",
        "hybrid_short_seq",
        "hybrid_low_quantile",
    ],
}
DEFAULT_QUALITY = 50.0


def _args(*parts: str | Column) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _candidate_args(candidate: Column) -> Column:
    """Settings of each candidate, some taken from the profile."""
    epochs, longer = F.col("recommended_epochs"), F.col("recommended_epochs") + 20
    length, q = F.col("recommended_sequence_length"), F.col("recommended_spike_quantile")
    settings = {
        "hybrid_default": _args("--epochs", epochs, "--sequence-length", length, "--spike-quantile", q),
        "hybrid_aggressive": _args(
            "--epochs", longer, "--sequence-length", length, "--spike-quantile", "0.85", "--spike-weight", "8", "--focal-gamma", "1.0"
        ),
        "gb_spike": _args("--lookback", F.col("recommended_lookback"), "--spike-oversample", "4"),
        "hybrid_short_seq": _args("--epochs", epochs, "--sequence-length", "48", "--spike-quantile", q),
        "hybrid_gb_heavy": _args("--epochs", epochs, "--sequence-length", length),
        "gb_spike_deep": _args("--lookback", "36", "--spike-oversample", "6"),
        "hybrid_low_quantile": _args(
            "--epochs", longer, "--sequence-length", length, "--spike-quantile", "0.82", "--spike-weight", "10",
            "--spike-lift-near", "1.0,0.9,0.95", "--spike-lift-factors", "1.05,1.01,1.05",
        ),
        "hybrid_r2_recovery": _args(
            "--epochs", longer, "--sequence-length", "24", "--spike-quantile", "0.85", "--spike-weight", "8.0",
            "--focal-gamma", "0.5", "--feature-spike-multipliers", "1.0,1.8,2.5",
        ),
    }
    expr = None
    for name, value in settings.items():
        expr = F.when(candidate == name, value) if expr is None else expr.when(candidate == name, value)
    return expr


def candidates(profiles: DataFrame) -> DataFrame:
    """M-15 / J-09: eight rows per series in preferred order, made by a generator, not a join."""
    order = None
    for trainer in ("gb_only", "hybrid_aggressive"):
        names = F.array(*[F.lit(c) for c in ORDERS[trainer]])
        test = F.col("recommended_trainer") == trainer
        order = F.when(test, names) if order is None else order.when(test, names)
    order = order.otherwise(F.array(*[F.lit(c) for c in ORDERS["hybrid"]]))
    rows = profiles.select("*", F.posexplode(order).alias("base_order", "candidate_id"))
    return rows.withColumns(
        {
            "trainer": F.when(F.col("candidate_id").startswith("gb_"), "gb").otherwise("enhanced"),
            "candidate_args": _candidate_args(F.col("candidate_id")),
        }
    )


# ---- policy ----


def first_best(value: Column, quality: Column, seq: Column) -> Column:
    """The value with the highest quality; the earliest record wins a tie."""
    return F.max_by(value, F.struct(quality, -seq))


def candidate_policy(records: DataFrame) -> DataFrame:
    """A-32: mean quality and attempts per candidate."""
    return records.groupBy("candidate_id").agg(
        F.avg("quality_pct").alias("mean_quality"), F.count(F.lit(1)).alias("attempts")
    )


def group_policy(records: DataFrame, by: str) -> DataFrame:
    """A-32: best candidate, mean quality and count per fingerprint or volatility."""
    return records.groupBy(by).agg(
        first_best(F.col("candidate_id"), F.col("quality_pct"), F.col("seq")).alias("best_candidate"),
        F.avg("quality_pct").alias("mean_quality"),
        F.count(F.lit(1)).alias("count"),
    )


def similar_records(records: DataFrame, fp: str, limit: int = 50) -> DataFrame:
    """T-05: the last records with this fingerprint, or the last of all. Top-n first, so the window sees ``limit`` rows."""
    exact = F.coalesce(F.col("data_fingerprint") == fp, F.lit(False))
    top = records.withColumn("_exact", exact).orderBy(F.desc("_exact"), F.desc("seq")).limit(limit)
    any_exact = F.max("_exact").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("_any", any_exact).filter(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def last_records(records: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """T-05 for every fingerprint at once; the limit is applied before the shuffle, so a hot one stays small."""
    w = Window.partitionBy(by).orderBy(F.desc("seq"))
    return records.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


# ---- choosing ----


def untried(table: DataFrame, attempts: DataFrame) -> DataFrame:
    """J-07"""
    return table.join(attempts.select("series_id", "candidate_id"), ["series_id", "candidate_id"], "left_anti")


def rank_candidates(table: DataFrame, records: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """M-16, J-08, T-02 for all series: history, preference and exploration.

    ``table`` is :func:`candidates` over fingerprinted profiles.
    """
    per_candidate = candidate_policy(records).select(
        "candidate_id", F.col("mean_quality").alias("_global"), F.col("attempts").alias("_count")
    )
    by_fp = group_policy(records, "data_fingerprint")
    fp = by_fp.select(
        "data_fingerprint", F.col("best_candidate").alias("_fp_best"), F.col("mean_quality").alias("_fp_mean")
    )
    vol = group_policy(records, "volatility").select(
        "volatility", F.col("best_candidate").alias("_vol_best"), F.col("mean_quality").alias("_vol_mean")
    )
    # One record is counted under one fingerprint, so the counts sum to the log size.
    total = records.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("_total"))
    # Only the single total is broadcast; how many ids and classes a log holds is not known.
    rows = untried(table, attempts) if attempts is not None else table
    joined = (
        rows.join(per_candidate, "candidate_id", "left")
        .join(fp, "data_fingerprint", "left")
        .join(vol, "volatility", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    )
    base = normalize_quality(F.coalesce("_global", F.lit(DEFAULT_QUALITY)))

    def lifted(value: Column, best: str, mean: str) -> Column:
        hit = F.coalesce(F.col(best) == F.col("candidate_id"), F.lit(False))
        return F.when(hit, F.greatest(value, normalize_quality(F.col(mean)))).otherwise(value)

    history = lifted(lifted(base, "_fp_best", "_fp_mean"), "_vol_best", "_vol_mean")
    explore = F.sqrt(2.0 * F.log(F.col("_total") + 1.0) / F.greatest(F.coalesce("_count", F.lit(0)), F.lit(1)))
    score = 0.6 * history + 0.2 * (100.0 - F.col("base_order") * 10.0) / 100.0 + 0.2 * explore
    w = Window.partitionBy("series_id").orderBy(F.desc(F.round("score", 9)), "base_order")
    return (
        joined.withColumn("score", score)
        .withColumn("rank", F.row_number().over(w))
        .select("series_id", "candidate_id", "base_order", "score", "rank")
    )


def ucb1(table: DataFrame, records: DataFrame) -> DataFrame:
    """M-17: an untried candidate first, in preferred order, else the best upper bound."""
    stats = candidate_policy(records).withColumn("_one", F.lit(1))
    total = records.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("_total")).withColumn("_one", F.lit(1))
    bound = F.when(
        F.col("attempts") > 0,
        normalize_quality(F.col("mean_quality")) + F.sqrt(2.0 * F.log("_total") / F.col("attempts")),
    )
    joined = table.join(stats.join(F.broadcast(total), "_one").drop("_one"), "candidate_id", "left")
    choice = F.struct(
        F.col("attempts").isNull(),
        F.when(F.col("attempts").isNotNull(), F.round(bound, 9)).otherwise(F.lit(0.0)),
        -F.col("base_order"),
    )
    return joined.groupBy("series_id").agg(F.max_by("candidate_id", choice).alias("candidate_id"))


def rule_fallback(table: DataFrame, attempts: DataFrame) -> DataFrame:
    """M-18: the next candidate from the gates of the last attempt.

    ``attempts`` has one row per attempt with its gates, quality and traffic gain.
    """
    last = attempts.groupBy("series_id").agg(
        F.max_by(
            F.struct(
                "quality_pct",
                "traffic_gain",
                "traffic_spike_f1_ge_0_50",
                "beats_persistence_each_feature_mae",
                "quality_ge_90",
            ),
            "attempt",
        ).alias("l"),
        F.count(F.lit(1)).alias("_attempts"),
    )
    spiky = ~F.coalesce(F.col("l.traffic_spike_f1_ge_0_50"), F.lit(True))
    beaten = ~F.coalesce(F.col("l.beats_persistence_each_feature_mae"), F.lit(True))
    poor = ~F.coalesce(F.col("l.quality_ge_90"), F.lit(True)) & (F.coalesce(F.col("l.quality_pct"), F.lit(0.0)) < 80)
    preferred = (
        F.when(poor & spiky, "hybrid_aggressive")
        .when(poor, "hybrid_r2_recovery")
        .when(beaten & (F.coalesce(F.col("l.traffic_gain"), F.lit(0.0)) < 0), "hybrid_gb_heavy")
        .when(beaten, "gb_spike")
        .when(spiky, "hybrid_aggressive")
    )
    tried = attempts.select("series_id", "candidate_id", F.lit(True).alias("_tried")).distinct()
    joined = (
        table.join(last.withColumn("_preferred", preferred), "series_id", "left")
        .join(tried, ["series_id", "candidate_id"], "left")
        .withColumn("_attempts", F.coalesce("_attempts", F.lit(0)))
    )
    fresh = F.col("_tried").isNull()
    # Preferred and untried, then first untried, then round robin.
    tier = (
        F.when(fresh & F.coalesce(F.col("candidate_id") == F.col("_preferred"), F.lit(False)), 0)
        .when(fresh, 1)
        .when(F.col("base_order") == F.col("_attempts") % len(ORDERS["hybrid"]), 2)
        .otherwise(3)
    )
    return joined.groupBy("series_id").agg(
        F.min_by("candidate_id", F.struct(tier, F.col("base_order"))).alias("candidate_id")
    )


def random_order(table: DataFrame, seed: int = 7) -> DataFrame:
    """T-06: the same shuffled order for the same seed. Eight rows per series."""
    w = Window.partitionBy("series_id").orderBy(S.draw(seed, "series_id", "candidate_id"), "candidate_id")
    return table.select("series_id", "candidate_id", F.row_number().over(w).alias("rank"))


def deploy_gate(challenger: DataFrame, baseline: DataFrame) -> DataFrame:
    """M-19: keep the challenger unless its weighted loss is worse; a missing loss is the worst."""
    inf = F.lit(float("inf"))
    joined = challenger.select("series_id", F.col("weighted_loss").alias("_c")).join(
        baseline.select("series_id", F.col("weighted_loss").alias("_b")), "series_id", "full"
    )
    worse = F.coalesce("_c", inf) > F.coalesce("_b", inf)
    return joined.select("series_id", F.when(worse, "baseline").otherwise("challenger").alias("deployed"))


# ---- runs and attempts ----


def running_best(attempts: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """W-14: best quality so far and the attempt that set it; only a strictly better one replaces it.

    A running maximum has no bounded look-back. The best of each chunk is taken
    first, a prefix over chunks carries it on, and a window runs inside a chunk.
    """
    key = F.struct(F.col("quality_pct").alias("quality_pct"), (-F.col("attempt")).alias("neg"))
    rows = index_rows(attempts, ["series_id"], ["attempt"], "attempts").withColumns(
        {"chunk": F.floor(F.col("row_idx") / chunk_rows), "_key": key}
    )
    earlier = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("series_id", "chunk")
        .agg(F.max("_key").alias("_best"))
        .select("series_id", "chunk", F.max("_best").over(earlier).alias("_carried"))
    )
    inside = Window.partitionBy("series_id", "chunk").orderBy("row_idx")
    best = F.greatest(F.max("_key").over(inside), F.coalesce("_carried", "_key"))
    return (
        rows.join(carried, ["series_id", "chunk"])
        .withColumn("_best", best)
        .select(
            "series_id",
            "attempt",
            "quality_pct",
            F.col("_best.quality_pct").alias("best_quality"),
            (-F.col("_best.neg")).alias("best_attempt"),
        )
    )


def best_run(runs: DataFrame, error: str, by: list[str]) -> DataFrame:
    """T-04: lowest validation error; the first name wins a tie."""
    return runs.groupBy(*by).agg(F.min_by("method", F.struct(F.round(error, 9), F.col("method"))).alias("best"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """T-03: best quality first, runs without a quality last."""
    return runs.orderBy(F.desc_nulls_last("quality"), "run")


def latest_complete(artifacts: DataFrame, required: list[str]) -> DataFrame:
    """T-07: the most recent run that has every required artifact."""
    complete = (
        artifacts.filter(F.col("artifact").isin(required))
        .groupBy("run")
        .agg(F.count_distinct("artifact").alias("_parts"), F.max("mtime").alias("mtime"))
        .filter(F.col("_parts") == len(required))
    )
    return complete.agg(F.max_by("run", F.struct("mtime", "run")).alias("run"), F.max("mtime").alias("mtime"))


def spike_ablation_summary(rows: DataFrame) -> DataFrame:
    """A-33"""
    return rows.groupBy("condition", "feature").agg(
        F.avg("mae").alias("mean_mae"),
        F.stddev_pop("mae").alias("std_mae"),
        F.avg("spike_f1").alias("mean_spike_f1"),
        F.stddev_pop("spike_f1").alias("std_spike_f1"),
    )


def selection_ablation_summary(rows: DataFrame, target: float = 90.0) -> DataFrame:
    """A-34"""
    return rows.groupBy("strategy").agg(
        F.min(F.when(F.col("quality_pct") >= target, F.col("attempt"))).alias("attempts_to_gate"),
        F.max("quality_pct").alias("best_quality_pct"),
        F.avg("quality_pct").alias("mean_quality_pct"),
        F.stddev_pop("quality_pct").alias("std_quality_pct"),
    )
