"""No row is lost, no order is left to chance, no result depends on how a stream is cut."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from telespan.operators.layout import index_rows, lookup
from telespan.operators.quantile import exact_quantile
from telespan.sources import flows, runs, writers
from telespan.streaming import live


def test_null_keys_and_ties_keep_their_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 1, 6.0), ("a", 1, 7.0), (None, 2, 1.0), (None, 1, 2.0), ("a", 0, 9.0)], "series_id string, t int, v double"
    )
    got = index_rows(rows, ["series_id"], ["t"], "ties").toPandas()
    again = index_rows(rows.orderBy(F.desc("v")), ["series_id"], ["t"], "ties").toPandas()
    assert len(got) == 6
    assert sorted(got[got.series_id.isna()].row_idx) == [0, 1] and sorted(got[got.series_id == "a"].row_idx) == [0, 1, 2, 3]
    key = ["v", "row_idx", "n_rows"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    table = spark.createDataFrame([(None, 1), ("a", 2)], "series_id string, x int")
    assert lookup(rows.withColumn("row_idx", F.lit(0)), table, ["series_id"]).count() == 6


def test_hot_series_and_equal_values_without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select(
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("series_id"),
            F.col("id").alias("t"),
            F.when(F.col("id") % 5 == 0, F.col("id") % 17).otherwise(0).cast("double").alias("v"),
        )
        got = index_rows(rows, ["series_id"], ["t"], "hot").toPandas()
        assert (got.sort_values(["series_id", "t"]).row_idx == got.sort_values(["series_id", "t"]).groupby("series_id").cumcount()).all()
        want = rows.toPandas().groupby("series_id").v.quantile(0.9)
        found = exact_quantile(rows.select("series_id", "v", "t"), ["series_id"], "v", 0.9).toPandas().set_index("series_id").threshold
        assert (found - want).abs().max() < 1e-9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/forecasts"
    one = spark.createDataFrame([("r1", "test", 1), ("r2", "test", 2)], "run_id string, split string, v int")
    writers.write_partitioned(one, ["run_id", "split"], "f", path)
    writers.write_partitioned(one.where("run_id = 'r1'").withColumn("v", F.lit(3)), ["run_id", "split"], "f", path)
    assert sorted(map(tuple, spark.read.parquet(path).select("run_id", "v").collect())) == [("r1", 3), ("r2", 2)]


def test_bad_log_lines_are_rejected_not_lost(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "candidate_id": "a"}\n\n{"seq": oops\n{"seq": 2}\n')
    assert [r.seq for r in runs.read_experience(spark, str(tmp_path)).orderBy("seq").collect()] == [1, 2]
    assert [r.line for r in runs.rejected_experience(spark, str(tmp_path)).collect()] == ['{"seq": oops']


@pytest.mark.parametrize("files", [1, 1000])
def test_streams_follow_event_time(spark, tmp_path, files):
    """Three files whose times are shuffled, read one at a time or all at once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    hours = [5, 0, 3, 1, 6, 2, 4, 8, 7]
    for part in range(3):
        rows = pd.DataFrame(
            {
                "series_id": "s",
                "timestamp": [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in hours[part::3]],
                "traffic_mbps": [float(h * h) for h in hours[part::3]],
            }
        )
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=files)

    def finish(out, name):
        live.append_telemetry(out, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}").toPandas()

    got = finish(live.running_persistence(stream, "12 hours"), "errors") if files == 1000 else None
    samples = stream.select(F.col("series_id").alias("node"), F.col("timestamp").cast("timestamp").alias("ts"), F.col("traffic_mbps").cast("long").alias("total"))
    late = finish(live.counter_rates(samples, "12 hours"), "waiting")
    assert len(late) == 0 and (got is None or len(got) == 0)  # the watermark has passed none of them
    # A last row far ahead lets all others go; it waits itself.
    ahead = pd.DataFrame({"series_id": ["s"], "timestamp": [pd.Timestamp("2024-01-03")], "traffic_mbps": [0.0]})
    spark.createDataFrame(ahead).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = finish(live.running_persistence(stream, "12 hours"), "errors2").sort_values("timestamp")
    assert got.predicted.tolist() == [0.0] + [float(h * h) for h in range(8)] and got.n.tolist() == list(range(1, 10))
    assert got.running_mae.tolist() == pytest.approx([h * h / (h + 1) for h in range(9)])
    rates = finish(live.counter_rates(samples, "12 hours"), "rates").sort_values("ts")
    assert rates.delta.tolist() == [0] + [2 * h + 1 for h in range(8)]


@pytest.mark.parametrize("shuffled", [True, False])
def test_bounded_streams_lose_no_row(spark, tmp_path, shuffled):
    """The default delay, one file a trigger: each row is in the results or in the table of late rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    hours = [5, 0, 3, 7, 6, 1, 2, 8, 4] if shuffled else list(range(9))
    for part in range(3):
        some = hours[3 * part : 3 * part + 3]
        times = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in some]
        rows = pd.DataFrame({"series_id": "s", "timestamp": times, "traffic_mbps": [float(h * h) for h in some]})
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = live.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=1)
    samples = stream.select(F.col("series_id").alias("node"), F.col("timestamp").cast("timestamp").alias("ts"), F.col("traffic_mbps").cast("long").alias("total"))
    late = [2] if shuffled else []  # 3 had been handed on before it came
    kept = [h for h in range(9) if h not in late]
    for name, tracked, closing, at in (
        ("errors", live.tracked_persistence(stream), live.closing_persistence, "timestamp"),
        ("rates", live.tracked_rates(samples), live.closing_rates, "ts"),
    ):
        done, rejected = (x.toPandas().sort_values(at) for x in live.finish(tracked, closing, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint"))
        assert done[at].dt.hour.tolist() + rejected[at].dt.hour.tolist() == kept + late
        assert rejected.late_value.tolist() == [h * h for h in late]
        again = live.finished(spark, tracked.schema, f"{tmp_path}/{name}")[0].toPandas().sort_values(at)
        assert again.equals(done) or again.reset_index(drop=True).equals(done.reset_index(drop=True))
        before = [0, *kept[:-1]]
        if name == "rates":
            assert done.delta.tolist() == [h * h - b * b for h, b in zip(kept, before)]
        else:
            errors = pd.Series([float(h * h - b * b) for h, b in zip(kept, before)])
            assert done.predicted.tolist() == [float(b * b) for b in before] and done.n.tolist() == list(range(1, len(kept) + 1))
            assert done.running_mae.tolist() == pytest.approx((errors.cumsum() / done.n.to_numpy()).tolist())


def test_streamed_bins_have_the_options_of_the_batch(spark, tmp_path):
    """Bits, bounded loss, absent columns, unreadable times; what comes after its bin has closed is counted."""
    flags = ", `PSH Flag Count` int, `RST Flag Count` int"
    for name, more in (("full", flags), ("bare", "")):
        files = [[("00:05", 1e6), ("00:40", 3e6), ("no time", 9e9)], [("03:00", 2e6), ("04:30", 5e6)], [("05:30", 4e6)], [("00:50", 7e6), ("06:30", 1e6)]]
        folder = f"{tmp_path}/{name}"
        for rows in files:
            rows = [("s", f"2024-01-01 {t}:00" if ":" in t else t, r, *([1, 1] if more else [])) for t, r in rows]
            spark.createDataFrame(rows, f"series_id string, Timestamp string, `Flow Bytes/s` double{more}").coalesce(1).write.mode("append").parquet(folder)
            time.sleep(1.1)  # files are read in the order of their times
        log = spark.read.parquet(folder)
        stream = live.read_files(spark, folder, log.schema, files=1)
        out = live.flow_bins(stream, 60, bits=True, clip_loss=True)
        run = live.append_telemetry(out, f"{folder}-bins", f"{folder}-checkpoint")
        run.awaitTermination()
        got = spark.read.parquet(f"{folder}-bins").orderBy("timestamp").collect()
        in_time = log.where("Timestamp NOT LIKE '%00:50%'")
        want = flows.bin_flow_log(in_time, 60, bits=True, clip_loss=True).where("timestamp < '2024-01-01 06:00'")
        assert got == want.select(*out.columns).orderBy("timestamp").collect() and len(got) == 4
        assert (got[0].traffic_mbps, got[0].packet_loss_pct) == (32.0, 100.0 if more else 0.0)
        assert live.dropped_rows(run) == 1


def test_rows_wait_without_being_read_again(spark, tmp_path):
    """Many rows wait; a batch of one row adds its own entry and no more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    start = pd.Timestamp("2024-01-01 00:00:00.5")
    first = [(start + pd.Timedelta(minutes=m), m) for m in range(300)]
    second, third = [(start + pd.Timedelta(minutes=301), 300)], [(start + pd.Timedelta(minutes=7, seconds=-0.25), 6)]
    for rows in (first, second, third):
        table = pd.DataFrame([("n", t, v) for t, v in rows], columns=["node", "ts", "total"])
        spark.createDataFrame(table).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run = live.append_telemetry(
        live.tracked_rates(live.read_files(spark, f"{tmp_path}/in", schema, files=1), "1000 hours"), f"{tmp_path}/held", f"{tmp_path}/held-checkpoint"
    )
    run.awaitTermination()
    updated = [p.stateOperators[0].numRowsUpdated for p in run.recentProgress if p.numInputRows]
    assert updated[0] >= 300 and all(0 < n <= 6 for n in updated[1:]), updated
    stream = live.read_files(spark, f"{tmp_path}/in", schema, files=1)
    for delay, late in (("1000 hours", 0), ("0 seconds", 1)):
        name = f"{tmp_path}/{delay[:1]}"
        done, rejected = live.finish(live.tracked_rates(stream, delay), live.closing_rates, name, f"{name}-checkpoint")
        got = done.orderBy("ts").toPandas()
        assert len(got) == 302 - late and rejected.count() == late
        assert got.delta.tolist() == ([0, *[1] * 6, 0, *[1] * 293, 1] if not late else [0, *[1] * 300])
