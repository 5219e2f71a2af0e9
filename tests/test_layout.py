import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.operators import baselines as B
from telespan.operators import features as X
from telespan.operators import forecasts as C
from telespan.operators.layout import index_rows, lookup
from telespan.operators.quantile import exact_quantile

COLUMNS = "series_id string, timestamp timestamp_ntz, traffic_mbps double, latency_ms double, packet_loss_pct double"


@pytest.fixture(scope="module")
def telemetry(spark):
    """One hot series and two small ones, in shuffled order."""
    rows = spark.range(1300).select(
        F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1280, "b").otherwise("c").alias("series_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))).alias("timestamp"),
        (50 + 30 * F.sin(F.col("id") / 4) + (F.col("id") * 37 % 11)).alias("traffic_mbps"),
        (10 + (F.col("id") * 13 % 7)).cast("double").alias("latency_ms"),
        (F.col("id") * 7 % 5).cast("double").alias("packet_loss_pct"),
    )
    return rows.orderBy(F.xxhash64("timestamp"))


@pytest.fixture(scope="module")
def indexed(telemetry):
    return index_rows(telemetry, ["series_id"], ["timestamp"], "t")


def test_positions(telemetry, indexed):
    got = indexed.toPandas().sort_values(["series_id", "timestamp"])
    want = telemetry.toPandas().sort_values(["series_id", "timestamp"])
    assert (got["row_idx"].to_numpy() == want.groupby("series_id").cumcount().to_numpy()).all()
    assert (got["n_rows"].to_numpy() == want.groupby("series_id")["timestamp"].transform("size").to_numpy()).all()


def test_chunked_features_equal_plain(indexed):
    def table(chunk):
        out = X.add_features(indexed, 12, chunk_rows=chunk).toPandas().sort_values(["series_id", "row_idx"])
        return out[["series_id", "row_idx", *X.feature_names(12)]].reset_index(drop=True)

    plain, chunked = table(100_000), table(40)
    assert plain[["series_id", "row_idx"]].equals(chunked[["series_id", "row_idx"]])
    np.testing.assert_allclose(plain[X.feature_names(12)], chunked[X.feature_names(12)], rtol=0, atol=1e-12)
    assert len(plain) == 1300 - 3 * 12
    # Against pandas: values of the rows before, never of the row itself.
    series = indexed.toPandas().sort_values(["series_id", "row_idx"])
    shifted = series.groupby("series_id")["traffic_mbps"].shift(1)
    want = shifted.groupby(series["series_id"]).rolling(6).std().reset_index(0, drop=True)[series["row_idx"] >= 12]
    np.testing.assert_allclose(plain["traffic_mbps_roll_std_6"], want, atol=1e-9)


def test_features_do_not_see_the_future(indexed):
    changed = indexed.withColumn(
        "traffic_mbps", F.when(F.col("row_idx") >= 500, F.lit(-1.0)).otherwise(F.col("traffic_mbps"))
    )
    names = X.feature_names(6)

    def upto(df):
        out = X.add_features(df, 6).filter((F.col("series_id") == "hot") & (F.col("row_idx") <= 500))
        return out.select("row_idx", *names).toPandas().sort_values("row_idx")[names].to_numpy()

    np.testing.assert_array_equal(upto(indexed), upto(changed))


def test_chunk_must_cover_halo(indexed):
    with pytest.raises(ValueError):
        X.add_features(indexed, 24, chunk_rows=10)


def test_quantile_equals_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "smooth": rng.normal(size=40_000),
        "ties": rng.integers(0, 4, 30_000).astype(float),
        "mostly_zero": np.where(rng.random(30_000) < 0.95, 0.0, rng.random(30_000)),
        "heavy_tail": rng.pareto(0.5, 20_000),
        "one": np.array([7.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for q in (0.0, 0.5, 0.88, 0.9, 1.0):
        got = {r["k"]: r["threshold"] for r in exact_quantile(df, ["k"], "v", q).collect()}
        for k, v in groups.items():
            assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), (k, q)


def test_linear_baseline_equals_least_squares(indexed):
    wide = B.linear_regression(indexed, chunk_rows=64).toPandas().sort_values(["series_id", "row_idx"])
    for sid in ("hot", "b"):
        part = wide[wide["series_id"] == sid]
        y = part[["traffic_mbps", "latency_ms", "packet_loss_pct"]].to_numpy()
        x = np.array([np.r_[1.0, y[i - 3 : i].ravel()] for i in range(3, len(y))])
        fit = x @ np.linalg.lstsq(x, y[3:], rcond=None)[0]
        got = part[[f"{m}__linear_regression" for m in ("traffic_mbps", "latency_ms", "packet_loss_pct")]].to_numpy()
        np.testing.assert_allclose(got[3:], fit, atol=1e-6)
        np.testing.assert_array_equal(got[:3], y[:3])


def test_sequences_and_alignment(spark):
    df = spark.range(10).select(
        F.lit("a").alias("series_id"), F.col("id").alias("row_idx"), F.lit(10).cast("bigint").alias("n_rows"),
        *[F.col("id").cast("double").alias(m) for m in ("traffic_mbps", "latency_ms", "packet_loss_pct")],
    )
    out = X.sequences(df, 3, chunk_rows=4).orderBy("seq_idx").collect()
    assert len(out) == 7
    assert [w["traffic_mbps"] for w in out[0]["window"]] == [0, 1, 2] and out[0]["traffic_mbps"] == 3
    assert [w["traffic_mbps"] for w in out[-1]["window"]] == [6, 7, 8] and out[-1]["traffic_mbps"] == 9
    assert C.feature_slice(100, 150, 48, 24, 1000) == (124, 174)


def test_lookup_equals_join_and_frees_the_key(indexed):
    table = indexed.filter("series_id <> 'c'").groupBy("series_id").agg(F.max("traffic_mbps").alias("top"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = lookup(indexed, table, ["series_id"], how).groupBy("series_id").count().collect()
        want = indexed.join(table, ["series_id"], how).groupBy("series_id").count().collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    # The aggregate after the lookup has its own shuffle on the key, so rows of a hot key are never gathered.
    spark = indexed.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = lookup(indexed, table, ["series_id"]).groupBy("series_id").agg(F.sum("top"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Null keys compare equal, so the join is on the key with a stand-in for null.
    assert "SortMergeJoin [coalesce(series_id" in plan and "_salt" in plan and "partial_sum(top" in plan
