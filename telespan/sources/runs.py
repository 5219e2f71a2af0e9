"""SRC-09 .. SRC-12: experience logs, run summaries, complete forecast sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from telespan.model import EXPERIENCE_SCHEMA, RUN_SUMMARY_SCHEMA
from telespan.operators.layout import lookup


def read_experience(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: one record per line; blank lines are skipped, unreadable ones are in :func:`rejected_experience`."""
    return _experience_lines(spark, path).where("record._bad IS NULL").select("record.*").drop("_bad")


def rejected_experience(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: file and text of the lines that are no records."""
    return _experience_lines(spark, path).where("record._bad IS NOT NULL").select("file", "line")


def _experience_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*EXPERIENCE_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.where(F.trim("line") != "").withColumn("record", F.from_json("line", schema, options))


def read_run_summaries(spark: SparkSession, glob: str) -> DataFrame:
    """SRC-10: one summary file per run, as a flat row. The run is the folder above ``json/``."""
    raw = spark.read.schema(RUN_SUMMARY_SCHEMA).option("multiLine", True).json(glob)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:json/)?[^/]+$", 1).alias("run"),
        F.col("overall.normalized_quality_pct").alias("quality"),
        F.col("overall.mae_improvement_vs_persistence_pct").alias("gain"),
        F.col("overall.rows").alias("rows"),
        F.col("overall.epochs").alias("epochs"),
        F.coalesce("benchmark.artifact", F.lit("unknown")).alias("model"),
    )


def complete_runs(forecasts: DataFrame, splits: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """SRC-11: rows of the runs that have actual and predicted values in every split."""
    whole = (
        forecasts.filter(F.col("split").isin(*splits))
        .filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
        .groupBy("run_id")
        .agg(F.count_distinct("split").alias("_n"))
        .filter(F.col("_n") == len(splits))
        .select("run_id")
    )
    return lookup(forecasts, whole, ["run_id"], "left_semi")


def traffic_f1(runs: DataFrame, spikes: DataFrame) -> DataFrame:
    """SRC-12: spike F1 of traffic per run, 0.0 where a run has none."""
    f1 = spikes.filter(F.col("metric") == "traffic_mbps").select("series_id", "method", F.col("f1").alias("_f1"))
    return runs.join(f1, ["series_id", "method"], "left").select(
        "series_id", "method", F.coalesce("_f1", F.lit(0.0)).alias("traffic_spike_f1")
    )
