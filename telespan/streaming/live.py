"""ST-01 .. ST-05: streaming ingestion, rates, alerts, running errors, log and policy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from telespan.functions import scalar as S
from telespan.model import METRICS
from telespan.sources import counters, flows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Files of a folder as a stream; ``files`` bounds a micro-batch, and with it the rows of one key in it."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)
    )


def flow_bins(
    log: DataFrame,
    minutes: int,
    delay: str = "10 minutes",
    key: str = "series_id",
    bits: bool = False,
    clip_loss: bool = False,
) -> DataFrame:
    """ST-01: the bins of :func:`flows.bin_flow_log` over event-time windows, with its options; a bin is emitted once, when it closes.

    Rows later than ``delay`` are dropped by the watermark, where the reference
    has no late-data rule; :func:`dropped_rows` counts them.
    """
    rows = flows.flow_columns(log, key).withColumn("_ts", F.col("_ts").cast("timestamp")).withWatermark("_ts", delay)
    return (
        rows.groupBy(F.window("_ts", f"{minutes} minutes").alias("_w"), key)
        .agg(*flows.bin_aggregates(bits, clip_loss))
        .select(key, F.col("_w.start").cast("timestamp_ntz").alias("timestamp"), *METRICS)
    )


def dropped_rows(run: StreamingQuery) -> int:
    """Partial bins that came after their bin had closed, of the batches whose progress Spark still keeps.

    Rows of a bin are added up before the state is asked, so what is dropped is
    counted as at most one per late bin and task.
    """
    return sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)


class InOrder(StatefulProcessor):
    """Rows of a key in event-time order, whatever order they came in.

    Rows wait in list state, to which a batch only appends. A timer stands at
    the median time of the rows that waited when it was set; once the watermark
    has passed it, all rows that the watermark has passed are handed on in
    order. So reading and rewriting the list releases at least half of what it
    held then: a row is read a bounded number of times on average, however many
    wait, and waits at most half a backlog longer than it must. Results do not
    depend on how a stream is cut into micro-batches. A row that comes after
    later rows of its key were handed on is passed through with ``late`` set;
    the last rows wait until the watermark moves on or :func:`finish` takes them.
    """

    time, value, kind = "ts", "value", "double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, value {self.kind}")
        self.due = handle.getValueState("due", "us long")
        self.newest = handle.getValueState("newest", f"us long, value {self.kind}")

    def step(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        raise NotImplementedError

    def rejected(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        us = batch[self.time].to_numpy().astype("datetime64[us]").astype("int64")
        rows = sorted(zip(us.tolist(), batch[self.value].tolist()))
        newest = tuple(self.newest.get()) if self.newest.exists() else None
        late = [x for x in rows if newest and x < newest]
        new = rows[len(late) :]
        if late:
            yield self.rejected(key, *_columns(late))
        if new:
            self.waiting.appendList(new)
            if not self.due.exists():
                self._wait(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in held if x[0] < passed]
        held = held[len(ready) :]
        if held:
            self.waiting.put(held)
            self._wait(held)
        else:
            self.waiting.clear()
            self.due.clear()
        if ready:
            self.newest.update(ready[-1])
            yield self.step(key, *_columns(ready))

    def _wait(self, held: list[tuple]) -> None:
        us = held[len(held) // 2][0]
        self.due.update((us,))
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def _columns(rows: list[tuple]) -> tuple[pd.Series, pd.Series]:
    return pd.Series(pd.to_datetime([x[0] for x in rows], unit="us")), pd.Series([x[1] for x in rows])


def _in_order(rows: DataFrame, processor: type[InOrder], key: str, schema: str, delay: str) -> DataFrame:
    # The watermark's column itself would let Spark drop late rows unseen; a computed one does not.
    time = F.timestamp_micros(F.unix_micros(processor.time)).alias(processor.time)
    return (
        rows.withWatermark(processor.time, delay)
        .select(key, time, processor.value)
        .groupBy(key)
        .transformWithStateInPandas(processor(), schema, "Append", "EventTime")
    )


def finish(tracked: DataFrame, closing, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Run a bounded stream to its end: all results, those of the rows still waiting too, and the table of late rows.

    ``closing`` is the stream's batch pass over the state it left. Its rows go
    to a folder next to the sink, which every run replaces: should the stream
    go on later, those rows come out of it. :func:`finished` reads both.
    """
    spark = tracked.sparkSession
    append_telemetry(tracked, path, checkpoint).awaitTermination()
    results = spark.createDataFrame([], tracked.drop("late", "late_value").schema)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/0")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):  # else nothing was read
        results = closing(spark, checkpoint).select(*results.columns)
    results.write.mode("overwrite").parquet(_closing_folder(path))
    return finished(spark, tracked.schema, path)


def finished(spark: SparkSession, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`finish` left in its folders: results and late rows."""
    written = spark.read.schema(schema).parquet(path)
    done = written.where("NOT late").drop("late", "late_value")
    return done.unionByName(spark.read.schema(done.schema).parquet(_closing_folder(path))), written.where("late")


def _closing_folder(path: str) -> str:
    return f"{path.rstrip('/')}-closing"


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def _waiting(spark: SparkSession, checkpoint: str, key: str, state: str) -> DataFrame:
    rows = _state(spark, checkpoint, "waiting").select(F.col(f"key.{key}").alias(key), "list_element.us", "list_element.value")
    before = _state(spark, checkpoint, state).select(F.col(f"key.{key}").alias("_key"), F.col("value").alias("state"))
    return rows.join(before, F.col(key).eqNullSafe(F.col("_key")), "left")


class CounterRates(InOrder):
    """ST-02: last known total per node; a reset counts as 0."""

    time, value, kind = "ts", "total", "long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "total long")

    def step(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        before = values.shift(1)
        before.iloc[0] = self.last.get()[0] if self.last.exists() else values.iloc[0]
        self.last.update((int(values.iloc[-1]),))
        delta = (values - before).clip(lower=0).astype("int64")
        return pd.DataFrame({"node": key[0], "ts": times, "delta": delta, "late": False, "late_value": None})

    def rejected(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"node": key[0], "ts": times, "delta": None, "late": True, "late_value": values})


def tracked_rates(samples: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """As :func:`counter_rates`, with late rows marked ``late``."""
    return _in_order(samples, CounterRates, "node", "node string, ts timestamp, delta long, late boolean, late_value long", delay)


def counter_rates(samples: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST-02: ``samples`` has one total per node and sample time."""
    return tracked_rates(samples, delay).where("NOT late").drop("late", "late_value")


def closing_rates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST-02 of the rows that still wait at the end."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("node").orderBy("us", "value")), "state.total", "value")
    return _waiting(spark, checkpoint, "node", "last").select(
        "node", F.timestamp_micros("us").alias("ts"), F.greatest(F.lit(0).cast("long"), F.col("value") - before).alias("delta")
    )


def node_samples(rows: DataFrame) -> DataFrame:
    """Total of one counter message: an array of interfaces with bytes, so no aggregation is needed on the stream."""
    counted = F.filter("interfaces", lambda i: i["iface"].isin(counters.INTERFACES))
    total = F.aggregate(counted, F.lit(0).cast("long"), lambda a, i: a + i["rx_bytes"] + i["tx_bytes"])
    return rows.select("node", F.col("ts").cast("timestamp").alias("ts"), total.alias("total"))


def spike_alerts(telemetry: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ST-03: stream rows above the static threshold of their series; Spark broadcasts the table if it is small."""
    return telemetry.join(thresholds.select("series_id", "threshold"), "series_id").filter(
        S.is_spike("traffic_mbps", "threshold")
    )


class RunningError(InOrder):
    """ST-04: last value, rows and summed absolute persistence error per series."""

    time, value, kind = "timestamp", "traffic_mbps", "double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "value double, n long, total double")

    def step(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        value, n, total = self.state.get() if self.state.exists() else (float(values.iloc[0]), 0, 0.0)
        predicted = values.shift(1)
        predicted.iloc[0] = value
        errors = (values - predicted).abs().cumsum() + total
        counts = pd.Series(range(n + 1, n + len(values) + 1), index=values.index)
        self.state.update((float(values.iloc[-1]), int(n + len(values)), float(errors.iloc[-1])))
        return pd.DataFrame(
            {"series_id": key[0], "timestamp": times, "predicted": predicted, "n": counts, "running_mae": errors / counts, "late": False, "late_value": None}
        )

    def rejected(self, key, times: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {"series_id": key[0], "timestamp": times, "predicted": None, "n": None, "running_mae": None, "late": True, "late_value": values}
        )


def tracked_persistence(telemetry: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """As :func:`running_persistence`, with late rows marked ``late``."""
    rows = telemetry.select("series_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "traffic_mbps")
    schema = "series_id string, timestamp timestamp, predicted double, n long, running_mae double, late boolean, late_value double"
    return _in_order(rows, RunningError, "series_id", schema, delay)


def running_persistence(telemetry: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST-04"""
    return tracked_persistence(telemetry, delay).where("NOT late").drop("late", "late_value")


def closing_persistence(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST-04 of the rows that still wait at the end."""
    order = Window.partitionBy("series_id").orderBy("us", "value")
    rows = _waiting(spark, checkpoint, "series_id", "state").withColumns(
        {"predicted": F.coalesce(F.lag("value").over(order), "state.value", "value"), "n": F.coalesce("state.n", F.lit(0)) + F.row_number().over(order)}
    )
    errors = F.sum(F.abs(F.col("value") - F.col("predicted"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "series_id",
        F.timestamp_micros("us").alias("timestamp"),
        "predicted",
        "n",
        ((F.coalesce("state.total", F.lit(0.0)) + errors) / F.col("n")).alias("running_mae"),
    )


def append_telemetry(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """SNK-04 / ST-05: append-only file sink with a checkpoint; runs over what is there and stops."""
    return (
        stream.writeStream.format(form)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


POLICY_KINDS = {"candidate": "candidate_id", "fingerprint": "data_fingerprint", "volatility": "volatility"}
_PARTIAL = "kind string, name string, total double, n long, best struct<quality:double,older:long,candidate_id:string>"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "name").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("best").alias("best"))


def refresh_policy(experience: DataFrame, log: str, partials: str, checkpoint: str):
    """ST-05: append records and keep policy sums per micro-batch: by candidate, fingerprint and volatility.

    Both folders are written per batch number, so a repeated batch replaces
    itself; sums are taken from the written log. The policy is the sum over the
    small partial tables, so the log is never read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{log}/batch={number}"
        batch.write.mode("overwrite").json(path)
        written = batch.sparkSession.read.schema(batch.schema).json(path)
        # Highest quality, and of equal ones the oldest.
        best = F.struct(F.col("quality_pct").alias("quality"), (-F.col("seq")).alias("older"), "candidate_id")
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in POLICY_KINDS.items()])
        rows = written.select(F.inline(kinds), F.col("quality_pct").alias("total"), F.lit(1).alias("n"), best.alias("best"))
        _merged(rows).write.mode("overwrite").parquet(f"{partials}/batch={number}")

    return (
        experience.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _policy(spark: SparkSession, partials: str, kind: str) -> DataFrame:
    rows = spark.read.schema(_PARTIAL).parquet(f"{partials}/batch=*").where(F.col("kind") == kind)
    return _merged(rows).withColumn("mean_quality", F.col("total") / F.col("n"))


def current_policy(spark: SparkSession, partials: str) -> DataFrame:
    """As :func:`telespan.operators.policy.candidate_policy` over all records so far."""
    return _policy(spark, partials, "candidate").select(
        F.col("name").alias("candidate_id"), "mean_quality", F.col("n").alias("attempts")
    )


def current_group_policy(spark: SparkSession, partials: str, by: str) -> DataFrame:
    """As :func:`telespan.operators.policy.group_policy`, by ``data_fingerprint`` or ``volatility``."""
    kind = {c: k for k, c in POLICY_KINDS.items()}[by]
    return _policy(spark, partials, kind).select(
        F.col("name").alias(by), F.col("best.candidate_id").alias("best_candidate"), "mean_quality", F.col("n").alias("count")
    )
