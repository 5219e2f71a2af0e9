import pytest
from pyspark.sql import functions as F

from telespan.model import METRICS
from telespan.operators import evaluation as E
from telespan.operators.layout import index_rows
from telespan.plans import forecast as FP
from telespan.plans import learn


@pytest.fixture(scope="module")
def seasonal(spark):
    """Two hourly series with a daily cycle and bursts at fixed positions."""
    i = F.col("id") % 240
    wave = F.sin(i * 2 * 3.141592653589793 / 24)
    burst = F.when(i % 41 == 0, 40.0).otherwise(0.0)
    rows = spark.range(480).select(
        F.when(F.col("id") < 240, "a").otherwise("b").alias("series_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=i.cast("int"))).alias("timestamp"),
        (60 + 40 * wave + burst).alias("traffic_mbps"),
        (10 + 5 * wave).alias("latency_ms"),
        (1 + wave).alias("packet_loss_pct"),
    )
    return index_rows(rows, ["series_id"], ["timestamp"], "seasonal")


def test_learner_beats_persistence_and_forecasts(seasonal):
    table = learn.feature_table(seasonal, 24)
    fitted = learn.fit(table, "linear", 24)
    scored = learn.evaluate(fitted)
    gain = {(r["method"], r["metric"]): r["mae_improvement_pct"] for r in E.compare_with_baseline(scored).collect()}
    assert all(gain[("Model", m)] > 0 for m in ("latency_ms", "packet_loss_pct"))
    out = FP.with_bands(FP.recursive_forecast(seasonal, fitted.models, 24, 3)).orderBy("series_id", "step_no").toPandas()
    assert len(out) == 6 and (out[METRICS] >= 0).all().all()
    for m in METRICS:
        assert (out[f"{m}_lower_95"] >= 0).all() and (out[f"{m}_upper_95"] >= out[f"{m}_lower_95"]).all()
    assert str(out["timestamp"].iloc[0]) == "2024-01-11 00:00:00"
    # The cycle is exact for latency, so the first step is close to it.
    assert out["latency_ms"].iloc[0] == pytest.approx(10.0, abs=0.5)
