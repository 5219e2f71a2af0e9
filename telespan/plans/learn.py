"""Learned forecasters with Spark ML (F-02, M-03, M-08, M-11, A-35, J-04).

One model per metric learns from all series at once; fitting is distributed.
Models of each series by itself are in :mod:`telespan.plans.series_models`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from telespan.functions.scalar import calendar, clip, is_weekend, spike_weight_factor
from telespan.model import METRICS
from telespan.operators import baselines as B
from telespan.operators import evaluation as E
from telespan.operators import features as X
from telespan.operators import forecasts as C
from telespan.operators.layout import CHUNK_ROWS, split_chunks
from telespan.operators.report import spike_rows
from telespan.plans.series_models import block_features
from telespan.scratch import materialize

FOLDS = 4  # blocks of train rows for the first learner of a fused fit

# F-02: learner name -> estimator. The default sizes.
LEARNERS = {
    "gbr": lambda seed, **p: GBTRegressor(
        **{
            "maxIter": 240,
            "stepSize": 0.03,
            "maxDepth": 3,
            "minInstancesPerNode": 3,
            "subsamplingRate": 0.8,
            "validationIndicatorCol": "is_validation",
            "validationTol": 1e-4,
            "seed": seed,
            **p,
        }
    ),
    "rf": lambda seed, **p: RandomForestRegressor(
        **{"numTrees": 180, "maxDepth": 12, "minInstancesPerNode": 3, "seed": seed, **p}
    ),
    "linear": lambda seed, **p: LinearRegression(**{"solver": "normal", "regParam": 1e-6, **p}),
}


def register(name: str, make) -> None:
    """Add an estimator factory ``(seed, **params) -> Estimator``."""
    LEARNERS[name] = make


@dataclass
class Fitted:
    """Models per metric, and the table of features and splits they came from."""

    models: dict[str, Model]
    features: list[str]
    table: DataFrame
    look_back: int
    label: str
    extra: dict = field(default_factory=dict)


def feature_table(rows: DataFrame, look_back: int, train_split: float = 0.8) -> DataFrame:
    """Features with positions counted after the look-back, and the tabular split; written once for many fits."""
    built = X.add_features(rows, look_back)
    shifted = built.withColumns(
        {"row_idx": F.col("row_idx") - look_back, "n_rows": F.col("n_rows") - look_back}
    ).filter(F.col("n_rows") >= 2)
    val, test = C.tabular_bounds(F.col("n_rows"), train_split)
    labelled = C.label_splits(shifted, val, test).withColumns({"val_start": val, "test_start": test})
    return materialize(labelled, "features")


# ---- features computed as they are read: a row of features is forty times as large as the row it is made of ----


def feature_rows(rows: DataFrame, look_back: int, part: str, train_split: float = 0.8, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows that the features of a split are made of, sorted by series, chunk and position; nothing wider is moved or written."""
    n = F.col("n_rows") - look_back
    val, test = C.tabular_bounds(n, train_split)
    low = {"train": F.lit(0), "validation": val, "test": test}[part]
    high = {"train": val, "validation": test, "test": n}[part]
    needed = rows.filter((n >= 2) & (F.col("row_idx") >= low) & (F.col("row_idx") < high + look_back))
    known = {**calendar(), "is_weekend": is_weekend(), "val_start": val, "test_start": test, "split": F.lit(part)}
    chunked = split_chunks(needed.select("series_id", "timestamp", "row_idx", "n_rows", *METRICS), max(look_back, 2), chunk_rows)
    chunked = chunked.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "row_idx")
    return chunked.withColumns(known)


def feature_blocks(batches: Iterator[pa.RecordBatch], look_back: int, chunk_rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with a full look-back and their features (W-01..W-03), from batches of :func:`feature_rows`.

    The last rows of a batch are put before the next one, and a row counts if
    the row ``look_back`` places before it is of its series and chunk.
    """
    before = None
    for batch in batches:
        group = pa.Table.from_batches([batch]) if before is None else pa.concat_tables([before, pa.Table.from_batches([batch])])
        group = group.combine_chunks()
        before = group.slice(max(0, group.num_rows - look_back))
        if group.num_rows <= look_back:
            continue
        series = group["series_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        chunk, at = group["chunk"].to_numpy(), group["row_idx"].to_numpy()
        same = (series[look_back:] == series[:-look_back]) & (chunk[look_back:] == chunk[:-look_back])
        full = same & (at[look_back:] >= chunk[look_back:] * chunk_rows)
        missing = np.cumsum([0, *group[METRICS[0]].is_null().to_numpy()])
        full &= missing[look_back:-1] == missing[: -look_back - 1]
        if full.any():
            numbers = lambda names: np.column_stack([group[c].to_numpy().astype(np.float64) for c in names])
            x = block_features(numbers(METRICS), numbers(X.CALENDAR_FEATURES), look_back)
            yield group.slice(look_back).filter(pa.array(full)), x[full]


def feature_arrays(rows: DataFrame, look_back: int, part: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As :func:`feature_table` for one split, with the features as the array ``x`` in the order of ``feature_names``."""
    kept = ["series_id", "timestamp", "row_idx", "n_rows", *METRICS, "split", "val_start", "test_start"]
    prepared = feature_rows(rows, look_back, part, chunk_rows=chunk_rows)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prepared.select(*kept).schema)

    def made(batches):
        for group, x in feature_blocks(batches, look_back, chunk_rows):
            flat = pa.array(x.ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            whole = group.select(kept).append_column("x", pa.ListArray.from_arrays(ends, flat))
            yield from whole.to_batches()

    built = prepared.mapInArrow(made, f"{types}, x array<double>")
    return built.withColumns({"row_idx": F.col("row_idx") - look_back, "n_rows": F.col("n_rows") - look_back})


MERGED = 16  # rows of partial moments that come to the driver


def _joined(parts) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Number, means and centred cross products of several parts; None of none."""
    n, mean, cross = 0, None, None
    for m, its_mean, its_cross in parts:
        if not n:
            n, mean, cross = m, its_mean, its_cross
            continue
        apart = its_mean - mean
        cross = cross + its_cross + np.outer(apart, apart) * (n * m / (n + m))
        mean, n = mean + apart * (m / (n + m)), n + m
    return (n, mean, cross) if n else None


def train_moments(rows: DataFrame, look_back: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of train rows, means and covariances of their features and targets in one pass; a task hands on one row."""
    kind, floats = "n bigint, mean array<double>, cross array<double>", pa.list_(pa.float64())

    def of_block(group: pa.Table, x: np.ndarray):
        block = np.column_stack([x, *[group[m].to_numpy().astype(np.float64) for m in METRICS]])
        if np.isnan(block).any():
            raise ValueError("a feature or target of a train row has no value")
        mean = block.mean(axis=0)
        return len(block), mean, (block - mean).T @ (block - mean)

    def as_row(found):
        if found is not None:
            n, mean, cross = found
            columns = [pa.array([n]), pa.array([mean.tolist()], floats), pa.array([cross.ravel().tolist()], floats)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "cross"])

    def read(row: dict):
        mean = np.array(row["mean"])
        return row["n"], mean, np.array(row["cross"]).reshape(len(mean), len(mean))

    def summed(batches):
        yield from as_row(_joined(of_block(*b) for b in feature_blocks(batches, look_back)))

    def merged(batches):
        yield from as_row(_joined(read(r) for b in batches for r in b.to_pylist()))

    parts = feature_rows(rows, look_back, "train").mapInArrow(summed, kind).repartition(MERGED).mapInArrow(merged, kind)
    found = _joined(read(r) for r in parts.toArrow().to_pylist())
    if found is None:
        raise ValueError("no train rows")
    n, mean, cross = found
    return n, mean, cross / n


def rows_with(mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Two rows per column that together have these means and covariances: one on either side of the mean along each principal axis."""
    spread = np.sqrt(np.diag(covariance))
    scale = np.where(spread > 0, spread, 1.0)
    length, axes = np.linalg.eigh(covariance / np.outer(scale, scale))
    apart = (scale[:, None] * axes * np.sqrt(np.maximum(length, 0.0) * len(mean))).T
    apart[:, spread == 0] = 0.0
    return mean + np.vstack([apart, -apart])


def depends_on_moments(estimator: Estimator) -> bool:
    """Normal equations know their rows by means and covariances alone."""
    return isinstance(estimator, LinearRegression) and estimator.getSolver() == "normal" and estimator.getLoss() == "squaredError"


def fit_by_moments(rows: DataFrame, learner: str = "linear", look_back: int = 24, seed: int = 7, **params) -> Fitted:
    """M-02 for the linear learner: as :func:`fit` on the features of ``rows``, but the features are never written.

    One pass over the train rows gives the moments of all features and targets,
    and each metric's estimator is fitted to a few rows that have the same ones.
    The table of the fit has features of the test part, as an array.
    """
    estimators = {m: LEARNERS[learner](seed, **params) for m in METRICS}
    if not all(map(depends_on_moments, estimators.values())):
        raise ValueError(f"{learner} needs its rows one by one: use fit")
    features = X.feature_names(look_back)
    _, mean, covariance = train_moments(rows, look_back)
    k = len(features)
    points = [(Vectors.dense(p[:k]), *map(float, p[k:])) for p in rows_with(mean, covariance)]
    assembled = rows.sparkSession.createDataFrame(points, ["features", *METRICS])
    models = {m: e.setFeaturesCol("features").setLabelCol(m).setPredictionCol(f"predicted_{m}").fit(assembled) for m, e in estimators.items()}
    return Fitted(models, features, feature_arrays(rows, look_back, "test"), look_back, learner)


def _weighted(df: DataFrame, multipliers: dict[str, float] | None, spike_weight: float) -> DataFrame:
    """M-08: one weight column per metric."""
    return df.withColumns(
        {
            f"weight_{m}": spike_weight_factor(
                F.lit(float((multipliers or {}).get(m, 1.0))), F.col(f"{m}_spike"), spike_weight
            )
            for m in METRICS
        }
    )


def fit(
    table: DataFrame,
    learner: str = "gbr",
    look_back: int = 24,
    spike_std: float = 1.2,
    oversample: int = 0,
    seed: int = 7,
    spike_weight: float = 0.0,
    multipliers: dict[str, float] | None = None,
    features: list[str] | None = None,
    **params,
) -> Fitted:
    """M-02 / M-03: one regressor per metric on the train part; boosting stops on the validation part (Q5)."""
    features = features or X.feature_names(look_back)
    train = table.filter(F.col("split") == "train")
    flagged = spike_rows(
        table.filter(F.col("split") != "test"), E.spread_thresholds(train, spike_std), only_spikes=False
    )
    is_train = F.col("split") == "train"
    copies = X.oversample(flagged, F.col("any_spike") & is_train, oversample)
    wanted = _weighted(copies, multipliers, spike_weight).withColumn("is_validation", ~is_train)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(wanted)
    stops_early = learner == "gbr"
    if not stops_early:
        assembled = assembled.filter(~F.col("is_validation"))
    models = {}
    for m in METRICS:
        estimator = LEARNERS[learner](seed, **params)
        estimator.setFeaturesCol("features").setLabelCol(m).setPredictionCol(f"predicted_{m}")
        if spike_weight > 0:
            estimator.setWeightCol(f"weight_{m}")
        models[m] = estimator.fit(assembled)
    return Fitted(models, features, table, look_back, learner)


def predict(fitted: Fitted, split: str | None = None) -> DataFrame:
    """Wide forecasts ``predicted_<metric>``, never negative."""
    rows = fitted.table if split is None else fitted.table.filter(F.col("split") == split)
    if "x" in rows.columns:
        out = rows.withColumn("features", array_to_vector("x")).drop("x")
    else:
        out = VectorAssembler(inputCols=fitted.features, outputCol="features").transform(rows)
    for m in METRICS:
        out = fitted.models[m].transform(out)
    return out.withColumns({f"predicted_{m}": clip(f"predicted_{m}") for m in METRICS}).drop("features")


def forecasts(fitted: Fitted, split: str = "test", method: str = "Model") -> DataFrame:
    """Forecasts in the long table; positions start at the first row of the split."""
    start = {"train": F.lit(0), "validation": F.col("val_start"), "test": F.col("test_start")}[split]
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), F.col(f"predicted_{m}").alias("predicted"))
            for m in METRICS
        ]
    )
    return predict(fitted, split).select(
        "series_id", (F.col("row_idx") - start).alias("row_idx"), F.lit(method).alias("method"), F.inline(entries)
    )


def staged_losses(fitted: Fitted) -> DataFrame:
    """M-04: loss after each tree on the validation part, and the best stage. One number per tree and metric."""
    rows = fitted.table.filter(F.col("split") == "validation")
    assembled = VectorAssembler(inputCols=fitted.features, outputCol="features").transform(rows)
    spreads = rows.agg(*[F.greatest(F.var_pop(m), F.lit(1e-18)).alias(m) for m in METRICS]).first()
    curves = {m: list(fitted.models[m].evaluateEachIteration(assembled, "squared")) for m in METRICS}
    # Boosting stops at its own number of trees for each metric; a shorter curve goes on at its last value.
    stages = max(len(c) for c in curves.values())
    curves = {m: c + c[-1:] * (stages - len(c)) for m, c in curves.items()}
    losses = [
        (
            k + 1,
            float(sum(curves[m][k] / spreads[m] for m in METRICS) / len(METRICS)),
            float(sum(curves[m][k] for m in METRICS) / len(METRICS)),
        )
        for k in range(stages)
    ]
    best = min(range(stages), key=lambda k: losses[k][1]) + 1
    return rows.sparkSession.createDataFrame(
        [(*row, row[0] == best) for row in losses],
        "epoch int, mse_loss double, raw_mse_loss double, is_best boolean",
    )


def ensemble_size(fitted: Fitted) -> dict[str, int]:
    """M-04b"""
    trees = [int(getattr(m, "getNumTrees", 1)) for m in fitted.models.values()]
    nodes = [int(getattr(m, "totalNumNodes", 0)) for m in fitted.models.values()]
    return {"tree_count": sum(trees), "estimators_per_target": round(sum(trees) / len(trees)), "total_nodes": sum(nodes)}


def feature_importance(fitted: Fitted) -> DataFrame:
    """A-35: mean importance over the metrics, highest first. One number per feature."""
    vectors = [m.featureImportances.toArray() for m in fitted.models.values()]
    rows = [(n, float(sum(v[i] for v in vectors) / len(vectors))) for i, n in enumerate(fitted.features)]
    return (
        fitted.table.sparkSession.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
    )


def fuse(table: DataFrame, outputs: DataFrame) -> DataFrame:
    """J-04: first-learner outputs beside the features, by series and original position."""
    return table.join(outputs, ["series_id", "row_idx"])


def fit_fused(
    table: DataFrame, look_back: int = 24, first: str = "linear", second: str = "gbr", first_params: dict | None = None, **params
) -> Fitted:
    """M-11: the second learner also sees the first one's forecast.

    Train rows are cut into blocks of time. A block is forecast by a fit on the
    blocks before it, the first one by a fit on those after it, so both learners
    use every train row and no row is forecast by a model that saw it. Later
    parts are forecast by a fit on the whole train part.
    """
    is_train = F.col("split") == "train"
    block = F.when(is_train, F.least(F.floor(F.col("row_idx") * FOLDS / F.col("val_start")), F.lit(FOLDS - 1)))
    parts = table.withColumn("_block", block)
    names = {f"predicted_{m}": f"first_{m}" for m in METRICS}

    def scored(fitted: Fitted, rows: DataFrame) -> DataFrame:
        out = predict(Fitted(fitted.models, fitted.features, rows.drop("_block"), look_back, first))
        return out.select("series_id", "row_idx", *[F.col(p).alias(n) for p, n in names.items()])

    whole = fit(table, first, look_back, **(first_params or {}))
    outputs = scored(whole, parts.filter(~is_train))
    for k in range(FOLDS):
        known = F.col("_block") < k if k else F.col("_block") > 0
        made = fit(parts.filter(known).drop("_block"), first, look_back, **(first_params or {}))
        outputs = outputs.unionByName(scored(made, parts.filter(F.col("_block") == k)))
    fused = materialize(fuse(table, materialize(outputs, "first-forecasts")), "fused")
    out = fit(fused, second, look_back, features=[*X.feature_names(look_back), *names.values()], **params)
    out.extra["first"] = whole
    return out


def evaluate(fitted: Fitted, method: str = "Model") -> DataFrame:
    """Scores of a fit next to persistence, on the test part."""
    train = fitted.table.filter(F.col("split") != "test")
    test = F.col("test_start")
    rows = fitted.table.filter(F.col("split") == "test").select(
        "series_id",
        "timestamp",
        (F.col("row_idx") - test).alias("row_idx"),
        (F.col("n_rows") - test).alias("n_rows"),
        *METRICS,
    )
    base = B.long_forecasts(B.add_baselines(rows, ["Persistence"]), ["Persistence"])
    both = base.unionByName(forecasts(fitted, "test", method))
    return E.score(both, E.quantile_thresholds(train.select("series_id", *METRICS)))
