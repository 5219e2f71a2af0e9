"""Blending, calibration, stacking and specialists (J-02, J-10, M-05 .. M-10, M-14, P-23).

Along a grid of weights a row's error is linear but for one change of its sign,
and its forecast passes the threshold at most once. So a row adds to the sums at
one or two grid points, and prefix sums over them give every score; no row is
copied for the grid. At most one partial row per series, metric and grid point
moves. The calibration grid has three parameters; a piece of rows is tried at
all of its points at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from telespan.functions import quality as Q
from telespan.functions import scalar as S
from telespan.model import metric_lookup, metric_weight
from telespan.operators.layout import lookup
from telespan.operators.quantile import exact_quantile
from telespan.scratch import materialize

BY = ["series_id", "metric"]
DIGITS = 9  # scores equal to this many places tie; the earlier grid point wins


def _f1() -> Column:
    return Q.f1(Q.precision(F.col("tp"), F.col("fp")), Q.recall(F.col("tp"), F.col("fn")))


def grid_scores(rows: DataFrame, steps: int, per: int, start: Column, end: Column, threshold: Column | None = None) -> DataFrame:
    """J-10: MAE, and tp, fp and fn with a threshold, of ``w * end + (1 - w) * start`` for w = i / per, i = 0 .. steps - 1.

    ``rows`` has series_id, metric, actual. The signed error of a row is
    ``s + w * d``; from grid point ``k`` on its sign is the other one. A row is at most
    two entries: (k, s, d) for the errors and the first point beyond the
    threshold for the counts. Entries are added per point, at most steps + 1 for a
    series and metric, before and after one shuffle. Rows without a forecast
    or actual value count nowhere. MAE is exact to the rounding of sums of s and d.
    """
    weight = lambda i: i / F.lit(float(per))
    s, d = start - F.col("actual"), end - start
    divisor, never = F.when(d != 0, d), F.lit(steps).cast("bigint")
    known = (s + d).isNotNull()
    sign = F.when(known & (s != 0), F.signum(s)).when(known, F.when(d < 0, -1.0).otherwise(1.0))
    k = F.when(s * d < 0, F.ceil(F.least(-s / divisor * per, F.lit(float(steps))))).otherwise(never)
    names = ["a", "b", "n", "hit", "miss", "alarm", "quiet"]
    none = {n: F.lit(0.0 if n in "ab" else 0).cast("double" if n in "ab" else "bigint") for n in names}

    def entry(at: Column, **values: Column) -> Column:
        return F.struct(at.alias("at"), *[v.alias(n) for n, v in (none | values).items()])

    entries = [entry(k, a=sign * s, b=sign * d, n=F.when(known, 1).otherwise(0).cast("bigint"))]
    if threshold is not None:
        beyond = lambda i: weight(i) * end + (1.0 - weight(i)) * start > threshold
        first, spike = start > threshold, F.col("actual") > threshold
        # Rounding may be one point off, so the points around the crossing are compared as the plain form would.
        near = F.floor(F.greatest(F.lit(-2.0), F.least((threshold - start) / divisor * per, F.lit(steps + 1.0))))
        points = [near + j for j in (-1, 0, 1, 2)]
        turn = F.least(*[F.when((x > 0) & (x < steps) & (beyond(x) != first), x) for x in points])
        count = lambda c: F.when(known & c, 1).otherwise(0).cast("bigint")
        kinds = {"hit": spike & first, "miss": spike & ~first, "alarm": ~spike & first, "quiet": ~spike & ~first}
        entries.append(entry(F.coalesce(turn, never), **{n: count(c) for n, c in kinds.items()}))
    at_points = rows.select(*BY, F.inline(F.array(*entries))).groupBy(*BY, "at").agg(*[F.sum(n).alias(n) for n in names])
    values = F.struct(*names)
    of_series = at_points.groupBy(*BY).agg(
        F.map_from_entries(F.collect_list(F.struct("at", values))).alias("_points"),
        *[F.sum(n).alias(f"all_{n}") for n in names],
    )
    dense = of_series.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))))
    dense = dense.withColumn("_e", F.try_element_at("_points", F.col("_i")))
    so_far = Window.partitionBy(*BY).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)  # one row per grid point
    turned = {n: F.coalesce(F.sum(f"_e.{n}").over(so_far), F.lit(0)) for n in names if n != "n"}
    w, total = weight(F.col("_i")), lambda n: F.coalesce(f"all_{n}", F.lit(0))
    error = total("a") - 2.0 * turned["a"] + w * (total("b") - 2.0 * turned["b"])
    scores = {"_mae": error / F.nullif(F.col("all_n"), F.lit(0))}
    if threshold is not None:
        swapped = lambda x, y: total(x) - turned[x] + turned[y]
        scores |= {"tp": swapped("hit", "miss"), "fp": swapped("alarm", "quiet"), "fn": swapped("miss", "hit")}
    return dense.select(*BY, F.col("_i").cast("int").alias("_i"), *[c.alias(n) for n, c in scores.items()])


def two_learner_weights(rows: DataFrame, steps: int = 41, q: float = 0.90) -> DataFrame:
    """M-05: weight of ``first`` against ``second`` per series and metric.

    ``rows``: series_id, metric, actual, first, second of the validation part.
    """
    spread = rows.groupBy(*BY).agg(F.stddev_pop("actual").alias("_std"))
    limits = exact_quantile(rows, BY, "actual", q)
    placed = lookup(rows, limits, BY)
    grid = grid_scores(placed, steps, steps - 1, F.col("second"), F.col("first"), F.col("threshold"))
    w = F.col("_i") / float(steps - 1)
    scored = grid.join(spread, BY).withColumn("_score", F.col("_mae") + 0.20 * F.col("_std") * (1.0 - _f1()))
    best = scored.groupBy(*BY).agg(F.min_by("_i", F.struct(F.round("_score", DIGITS), "_i")).alias("_i"))
    return best.select(*BY, w.alias("first_weight"), (1.0 - w).alias("second_weight"))


def persistence_weights(rows: DataFrame) -> DataFrame:
    """M-06: weight of persistence on a grid of 0.00 .. 0.95. ``rows`` has actual, predicted, persistence."""
    scored = grid_scores(rows, 20, 20, F.col("predicted"), F.col("persistence"))
    best = scored.groupBy(*BY).agg(F.min_by("_i", F.struct(F.round("_mae", DIGITS), "_i")).alias("_i"))
    return best.select(*BY, (F.col("_i") * 5 / 100.0).alias("persistence_weight"))


PIECE = 500  # validation rows tried at all points of the calibration grid by one call


def _calibration_score(mae: Column, base: Column, tp: Column, fp: Column, fn: Column) -> Column:
    """Log-ratio quality less the penalties for too few and too many spikes."""
    f1 = Q.f1(Q.precision(tp, fp), Q.recall(tp, fn))
    actual, found = tp + fn, tp + fp
    quality = Q.log_ratio_quality(mae, base, F.lit(0.0), f1, actual, found)
    few = F.when(found < 5, 10.0).otherwise(0.0)
    many = F.when(
        (actual > 0) & (found > 1.3 * actual),
        15.0 * (found / F.greatest(actual, F.lit(1)) - 1.3),
    ).otherwise(0.0)
    return quality - F.when(F.col("metric") == "traffic_mbps", few + many).otherwise(0.0)


def _tried(actual: np.ndarray, predicted: np.ndarray, persistence: np.ndarray, threshold: float, std: float):
    """Of some rows, per grid point: known errors and their sum, and tp, fp and fn. Points are numbered by scale, bias and weight."""
    scale = ((85 + 5 * np.arange(7)) / 100.0)[None, :, None, None]
    bias = np.array([(k - 2) * 0.05 for k in range(5)])[None, None, :, None] * std
    share = (np.arange(6) / 10.0)[None, None, None, :]
    column = lambda v: v[:, None, None, None]
    tried = ((scale * column(predicted) + bias + share * column(persistence)) / (1.0 + share)).reshape(len(actual), -1)
    error = np.abs(actual[:, None] - tried)
    known = ~np.isnan(error[:, 0])
    spike, above = (actual > threshold)[known, None], tried[known] > threshold
    counts = [(x & y).sum(axis=0) for x, y in ((spike, above), (~spike, above), (spike, ~above))]
    return int(known.sum()), error[known].sum(axis=0), *counts


def calibration(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """M-07: scale, bias and persistence weight with the best log-ratio quality.

    7 x 5 x 6 points. ``rows`` has row_idx, actual, predicted, persistence of
    the validation part. No row is repeated for the grid: up to ``PIECE`` rows
    are moved as one array and tried at all points at once. A series of one
    piece is decided where the piece is and moves its best point only; the sums of
    longer ones are added per point.
    """
    base = rows.groupBy(*BY).agg(
        F.greatest(F.stddev_pop("actual"), F.lit(1e-9)).alias("_std"),
        F.avg(F.abs(F.col("actual") - F.col("persistence"))).alias("_base"),
        (F.max("row_idx") < PIECE).alias("_whole"),
    )
    fixed = thresholds.select(*BY, "threshold").join(base, BY)
    names = ["actual", "predicted", "persistence"]
    pieces = rows.groupBy(*BY, F.floor(F.col("row_idx") / PIECE).alias("_piece")).agg(
        F.collect_list(F.struct(*[F.col(n).cast("double").alias(n) for n in names])).alias("_rows")
    )
    counted = ["tp", "fp", "fn"]

    def tried(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_rows")
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            values = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
            limits = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("threshold", "_std")]
            found = [_tried(*[v[i:j] for v in values], *[x[k] for x in limits]) for k, (i, j) in enumerate(zip(ends, ends[1:]))]
            n, *sums = zip(*found)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * 210)
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in sums]
            kept = [batch.column(c) for c in (*BY, "_std", "_base", "_whole")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *arrays], [*BY, "_std", "_base", "_whole", "n", "error", *counted])

    kinds = "series_id string, metric string, _std double, _base double, _whole boolean, n bigint, error array<double>, " + ", ".join(f"{c} array<bigint>" for c in counted)
    made = pieces.join(fixed, BY).mapInArrow(tried, kinds)
    mae = lambda error, n: error / F.nullif(n, F.lit(0))
    points = F.transform(F.arrays_zip("error", *counted), lambda p, g: F.struct(g.alias("_g"), *[p[c].alias(c) for c in ("error", *counted)]))

    def rank(p):
        score = _calibration_score(mae(p["error"], F.col("n")), F.col("_base"), *[p[c] for c in counted])
        return F.struct(F.round(score, DIGITS).alias("score"), (-p["_g"]).alias("g"))

    best = F.array_max(F.transform("_points", rank))["g"]
    decided = F.when(F.col("_whole"), F.array(F.get("_points", -best))).otherwise(F.col("_points"))
    sums = (
        made.withColumn("_points", points)
        .select(*BY, "_std", "_base", "n", F.inline(decided))
        .groupBy(*BY, "_std", "_base", "_g")
        .agg(*[F.sum(c).alias(c) for c in ("n", "error", *counted)])
    )
    score = _calibration_score(mae(F.col("error"), F.col("n")), F.col("_base"), *map(F.col, counted))
    chosen = sums.groupBy(*BY, "_std").agg(F.max_by("_g", F.struct(F.round(score, DIGITS), -F.col("_g"))).alias("_g"))
    scale = (85 + 5 * F.floor(F.col("_g") / 30)) / 100.0
    bias = (F.floor(F.col("_g") / 6) % 5 - 2) * 0.05 * F.col("_std")
    weight = (F.col("_g") % 6) / 10.0
    return chosen.select(*BY, scale.alias("scale"), bias.alias("bias"), weight.alias("persistence_weight"))


def apply_calibration(rows: DataFrame, params: DataFrame) -> DataFrame:
    """M-07b"""
    return calibrated(lookup(rows, params, BY))


def calibrated(rows: DataFrame) -> DataFrame:
    """Rows next to their calibration."""
    w = F.col("persistence_weight")
    value = (F.col("scale") * F.col("predicted") + F.col("bias") + w * F.col("persistence")) / (1.0 + w)
    return rows.withColumn("predicted", S.clip(value)).drop("scale", "bias", "persistence_weight")


def blend_two(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """M-14, first step: weighted sum of two learners."""
    value = F.col("first_weight") * F.col("first") + F.col("second_weight") * F.col("second")
    return lookup(rows, weights, BY).withColumn("predicted", value).drop("first_weight", "second_weight")


def mix_persistence(rows: DataFrame, weights: DataFrame, clip: bool = True) -> DataFrame:
    """M-14, second step: mix with persistence, then no negative forecasts."""
    w = F.coalesce("persistence_weight", F.lit(0.0))
    value = w * F.col("persistence") + (1.0 - w) * F.col("predicted")
    return (
        lookup(rows, weights, BY, "left")
        .withColumn("predicted", S.clip(value) if clip else value)
        .drop("persistence_weight")
    )


def lift_spikes(rows: DataFrame, thresholds: DataFrame, near: dict[str, float], lift: dict[str, float]) -> DataFrame:
    """P-23"""
    value = S.spike_lift(F.col("predicted"), F.col("threshold"), metric_lookup(near), metric_lookup(lift))
    return lookup(rows, thresholds.select(*BY, "threshold"), BY).withColumn("predicted", value).drop("threshold")


# ---- stacking ----


def with_tail_position(forecasts: DataFrame) -> DataFrame:
    """J-02: distance from the end, from the number of rows of each run and series."""
    sizes = forecasts.groupBy("series_id", "method", "metric").agg(F.max("row_idx").alias("_last"))
    return (
        lookup(forecasts, sizes, ["series_id", "method", "metric"])
        .withColumn("tail_idx", F.col("_last") - F.col("row_idx"))
        .drop("_last")
    )


def _aligned(forecasts: DataFrame, methods: list[str]) -> DataFrame:
    """:func:`align_tails`, with ``_rows``: positions that the shortest run has.

    The ends of all runs are looked up by series and metric, so the rows of a
    position stay together and are one row before they move again.
    """
    known = forecasts.filter(F.col("method").isin(methods))
    of = lambda m, c: F.when(F.col("method") == m, F.col(c))
    ends = known.groupBy(*BY).agg(*[F.max(of(m, "row_idx")).alias(f"_last{i}") for i, m in enumerate(methods)])
    last = F.coalesce(*[of(m, f"_last{i}") for i, m in enumerate(methods)])
    return (
        lookup(known, ends, BY)
        .groupBy(*BY, (last - F.col("row_idx")).alias("tail_idx"))
        .agg(
            F.max(of(methods[0], "actual")).alias("actual"),
            *[F.max(of(m, "predicted")).alias(f"p{i}") for i, m in enumerate(methods)],
            (F.max(F.array_min(F.array(*[f"_last{i}" for i in range(len(methods))]))) + 1).alias("_rows"),
        )
        .dropna(subset=[f"p{i}" for i in range(len(methods))])
    )


def align_tails(forecasts: DataFrame, methods: list[str]) -> DataFrame:
    """J-02: one row per tail position that every run has, one column per run.

    Positions spread a hot series over the shuffle; a group holds one row per run.
    """
    return _aligned(forecasts, methods).drop("_rows")


VECTORS = 3_000  # weight vectors drawn
SCORED_ROWS = 20_000  # rows scored by one group
SUMMED = 1_000  # partial sums added by one group


def weight_vectors(runs: int, count: int = VECTORS, seed: int = 7) -> np.ndarray:
    """Convex weights, one row each: every run alone, all alike, then ``count`` uniform draws from the simplex.

    A draw divides exponential variables, from the first 32 bits of the digest of seed, number and run, by their sum.
    """
    digest = lambda k, i: int(hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:8], 16)
    drawn = -np.log((np.array([[digest(k, i) for i in range(runs)] for k in range(count)], dtype=np.float64) + 1) / 2.0**32)
    return np.vstack([np.eye(runs), np.full((1, runs), 1.0 / runs), drawn / drawn.sum(axis=1, keepdims=True)])


def stacking_weights(validation: DataFrame, methods: list[str], count: int = VECTORS) -> DataFrame | None:
    """M-09: convex weights per series and metric with the lowest validation MAE. Under two runs: none.

    Any number of runs: the vectors are drawn by hash, so a result can be repeated,
    and a group of rows scores all of them as one product of matrices; no row is
    copied. A series and metric of one group is decided there and hands on its
    weights only. Groups of longer ones hand on an array of sums, which are
    added up in two steps.
    """
    if len(methods) < 2:
        return None
    names, weighed = [f"p{i}" for i in range(len(methods))], [f"w{i}" for i in range(len(methods))]
    vectors = weight_vectors(len(methods), count)
    partial_type = "series_id string, metric string, piece bigint, n bigint, sums array<double>"
    weights_type = ", ".join(f"{w} double" for w in weighed) + ", val_mae double"

    def keys(key) -> list[pa.Array]:
        return [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.string())]

    def row(key, piece: int, n: int, sums: np.ndarray | None) -> pa.Table:
        found = pa.array([None if sums is None else sums.tolist()], pa.list_(pa.float64()))
        return pa.table([*keys(key), pa.array([piece]), pa.array([n]), found], names=["series_id", "metric", "piece", "n", "sums"])

    def with_best(table: pa.Table, n: int, sums: np.ndarray | None) -> pa.Table:
        # The first of equal scores wins.
        best = [None] * (len(weighed) + 1) if sums is None else [*vectors[int(np.argmin(np.round(sums / n, DIGITS)))], sums.min() / n]
        for name, value in zip([*weighed, "val_mae"], best):
            table = table.append_column(name, pa.array([None if value is None else float(value)], pa.float64()))
        return table

    def scored(key, group):
        runs = np.column_stack([group[c].to_numpy() for c in names])
        actual, sums = group["actual"].to_numpy(), np.zeros(len(vectors))
        for i in range(0, len(runs), 500):  # bounds the matrix of errors
            sums += np.abs(runs[i : i + 500] @ vectors.T - actual[i : i + 500, None]).sum(axis=0)
        whole = group["whole"][0].as_py()
        made = row(key, key[2].as_py() // SUMMED, len(runs), None if whole else sums)
        return with_best(made, len(runs), sums if whole else None)

    def added(group: pa.Table) -> tuple[int, np.ndarray]:
        sums = group["sums"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        return sum(group["n"].to_pylist()), sums.sum(axis=0)

    def summed(key, group):
        return row(key, 0, *added(group))

    def chosen(key, group):
        return with_best(pa.table(keys(key), names=BY), *added(group))

    aligned = _aligned(validation, methods)
    whole = (F.col("_rows") <= SCORED_ROWS).alias("whole")
    rows = aligned.select(*BY, "actual", *names, F.floor(F.col("tail_idx") / SCORED_ROWS).alias("piece"), whole)
    parts = materialize(rows.groupBy(*BY, "piece").applyInArrow(scored, f"{partial_type}, {weights_type}"), "stacking")
    decided = parts.where("sums IS NULL").select(*BY, *weighed, "val_mae")
    long = parts.where("sums IS NOT NULL").select(*BY, "piece", "n", "sums")
    long = long.groupBy(*BY, "piece").applyInArrow(summed, partial_type)
    return decided.unionByName(long.groupBy(*BY).applyInArrow(chosen, f"series_id string, metric string, {weights_type}"))


def stack(test: DataFrame, weights: DataFrame, methods: list[str]) -> DataFrame:
    """M-09: stacked forecasts of the test part, by tail position."""
    value = sum((F.col(f"w{i}") * F.col(f"p{i}") for i in range(len(methods))), F.lit(0.0))
    return (
        lookup(align_tails(test, methods), weights, BY)
        .select(*BY, "tail_idx", "actual", value.alias("predicted"))
    )


def best_stacked_run(validation: DataFrame) -> DataFrame:
    """T-04: the run with the lowest weighted validation MAE per series."""
    mae = validation.groupBy("series_id", "method", "metric").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae")
    )
    total = mae.groupBy("series_id", "method").agg(F.sum(metric_weight() * F.col("mae")).alias("weighted_mae"))
    return total.groupBy("series_id").agg(
        F.min_by("method", F.struct(F.round("weighted_mae", DIGITS), "method")).alias("best_run")
    )


# ---- specialists ----


def weak_metrics(comparison: DataFrame, method: str) -> DataFrame:
    """M-10: metrics of a run below 85 quality or 5 % gain."""
    weak = (F.col("quality_pct") < 85.0) | (F.col("mae_improvement_pct") < 5.0)
    return comparison.filter((F.col("method") == method) & weak).select(*BY)


def apply_specialists(model: DataFrame, specialist: DataFrame, weak: DataFrame) -> DataFrame:
    """M-10: rows of ``model`` (with tail_idx, persistence) with weak metrics replaced or blended.

    Positions without a specialist forecast keep the model's.
    """
    s = specialist.select(*BY, "tail_idx", F.col("predicted").alias("_s"))
    flags = weak.withColumn("_weak", F.lit(True))
    m, has = F.col("metric"), F.col("_s").isNotNull()
    value = (
        F.when(F.col("_weak").isNull(), F.col("predicted"))
        .when((m == "traffic_mbps") & has, F.col("_s"))
        .when((m == "packet_loss_pct") & has, 0.7 * F.col("_s") + 0.3 * F.col("predicted"))
        .when(m == "latency_ms", 0.5 * F.col("persistence") + 0.5 * F.col("predicted"))
        .otherwise(F.col("predicted"))
    )
    return (
        lookup(model.join(s, [*BY, "tail_idx"], "left"), flags, BY, "left")
        .withColumn("predicted", value)
        .drop("_s", "_weak")
    )
