"""Linear models of all series from features that are never written, against the fit on a table of features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.model import METRICS
from telespan.operators import features as X
from telespan.operators.layout import index_rows
from telespan.plans import forecast as FP
from telespan.plans import learn


@pytest.fixture(scope="module")
def rows(spark):
    """Series of several lengths, one without a key and one too short for any features."""
    i = F.col("id") % 300
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0
    df = spark.range(900).select(
        F.when(F.col("id") < 300, "a").when(F.col("id") < 600, "b").alias("series_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=i.cast("int"))).alias("timestamp"),
        (60 + 40 * F.sin(i / 4) + noise(1)).alias("traffic_mbps"),
        (10 + noise(2)).alias("latency_ms"),
        (1 + noise(3) / 5).alias("packet_loss_pct"),
    )
    short = df.filter("series_id = 'a'").limit(20).withColumn("series_id", F.lit("short"))
    return index_rows(df.filter("series_id != 'b' OR series_id IS NULL OR id < 390").unionByName(short), ["series_id"], ["timestamp"], "streamed")


@pytest.mark.parametrize("part", ["train", "validation", "test"])
@pytest.mark.parametrize("batch, chunk", [(10_000, 200_000), (7, 40)])
def test_features_equal_those_of_the_table(rows, spark, part, batch, chunk):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        order = ["series_id", "row_idx"]
        want = learn.feature_table(rows, 24).filter(F.col("split") == part).toPandas().sort_values(order).reset_index(drop=True)
        found = learn.feature_arrays(rows, 24, part, chunk).toPandas().sort_values(order).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    kept = ["series_id", "row_idx", "n_rows", "split", "val_start", "test_start", *METRICS, "timestamp"]
    assert len(want) and found[kept].equals(want[kept])
    assert set(want.series_id.dropna()) == {"a", "b"} and want.series_id.isna().any()
    assert np.allclose(np.stack(found.x), want[X.feature_names(24)].to_numpy(float), atol=1e-9)


def test_models_equal_those_fitted_to_every_row(rows, monkeypatch):
    whole = learn.fit(learn.feature_table(rows, 24), "linear", 24)
    # No table of features is written.
    monkeypatch.setattr(learn, "materialize", lambda *_: pytest.fail("features were written"))
    found = learn.fit_by_moments(rows, "linear", 24)
    want = learn.forecasts(whole, "test").toPandas().sort_values(["series_id", "metric", "row_idx"])
    made = learn.forecasts(found, "test").toPandas().sort_values(["series_id", "metric", "row_idx"])
    assert len(want) and np.allclose(want.predicted, made.predicted, atol=1e-7)
    assert (want[["series_id", "metric", "row_idx"]].fillna("").values == made[["series_id", "metric", "row_idx"]].fillna("").values).all()
    with pytest.raises(ValueError, match="one by one"):
        learn.fit_by_moments(rows, "gbr", 24)


def test_points_have_the_moments():
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 5)) * [1, 100, 0.01, 3, 0] + [0, 1e4, 5, -3, 0.25]
    x[:, 3] = 2 * x[:, 0] - x[:, 1]  # collinear; the last one is constant
    points = learn.rows_with(x.mean(axis=0), np.cov(x.T, ddof=0))
    assert len(points) == 10 and np.allclose(points.mean(axis=0), x.mean(axis=0))
    assert np.allclose(np.cov(points.T, ddof=0), np.cov(x.T, ddof=0), rtol=1e-9, atol=1e-9) and (points[:, 4] == 0.25).all()


def test_steps_of_a_batch_equal_steps_as_transforms(rows, monkeypatch):
    fitted = learn.fit_by_moments(rows, "linear", 24)
    known = rows.filter("series_id IN ('a', 'b')")
    found = FP.recursive_forecast(known, fitted.models, 24, 5)
    assert found.columns == ["series_id", "step_no", "timestamp", *METRICS]
    order = ["series_id", "step_no"]
    monkeypatch.setattr(FP, "LinearRegressionModel", type("Other", (), {}))  # as for models without coefficients
    want = FP.recursive_forecast(known, fitted.models, 24, 5).toPandas().sort_values(order).reset_index(drop=True)
    found = found.toPandas().sort_values(order).reset_index(drop=True)
    assert len(found) == 10 and found[[*order, "timestamp"]].equals(want[[*order, "timestamp"]])
    assert np.allclose(found[METRICS], want[METRICS], atol=1e-9)
