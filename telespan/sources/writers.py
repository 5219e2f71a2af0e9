"""SNK-01 .. SNK-03, SNK-06: tables, summary JSON, append-only logs, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from telespan.scratch import scratch_path


def write_partitioned(df: DataFrame, by: list[str], label: str, path: str | None = None) -> DataFrame:
    """SNK-01: one folder per run and split, so readers prune; returns the written table.

    Writing a run again replaces its folders and leaves the others.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """SNK-02: evaluation tables (parquet or csv) or nested summaries (json)."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def append_json(df: DataFrame, path: str) -> None:
    """SNK-03: records are only ever added; ``seq`` keeps their order."""
    df.write.mode("append").json(path)


def run_summary(overall: DataFrame, comparison: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """SNK-02: the nested report, one row per series and method. Groups hold one row per metric."""
    keys = ["series_id", "method"]
    flags = [c for c in gate_rows.columns if c not in (*keys, "quality_pct", "mae_improvement_pct")]
    per_metric = comparison.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in comparison.columns if c not in keys]))).alias("per_feature")
    )
    gate_map = F.create_map(*[x for c in flags for x in (F.lit(c), F.col(c))])
    return (
        overall.select(*keys, F.struct(*[c for c in overall.columns if c not in keys]).alias("overall"))
        .join(per_metric, keys)
        .join(gate_rows.select(*keys, gate_map.alias("gates_passed")), keys)
    )


def save_model(model: PipelineModel, path: str) -> None:
    """SNK-06"""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """SRC-13"""
    return PipelineModel.load(path)
