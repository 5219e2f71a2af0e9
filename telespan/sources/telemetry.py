"""SRC-01, SRC-02, SRC-05: telemetry scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from telespan.functions import scalar as S
from telespan.functions.scalar import calendar, finite, time_column
from telespan.model import METRICS, TELEMETRY_SCHEMA, require_columns
from telespan.operators.layout import lookup, row_hash

MIN_ROWS = 30


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY_SCHEMA).option("header", True).csv(path)


def clean(df: DataFrame, key: str = "series_id") -> DataFrame:
    """SRC-02: coerce times, drop rows without a time or any of the three metrics (P-01 .. P-04)."""
    require_columns(df, [key, "timestamp", *METRICS])
    metrics = {m: finite(F.col(m).cast("double")) for m in METRICS}
    return df.withColumns({"timestamp": time_column(df, "timestamp"), **metrics}).dropna(
        subset=[key, "timestamp", *METRICS]
    )


def scan(df: DataFrame, key: str = "series_id", min_rows: int = MIN_ROWS) -> DataFrame:
    """SRC-01: cleaned rows with calendar columns, of the series that have enough rows.

    The count is a separate small aggregate, not a window: a window would move a
    whole series into one task.
    """
    rows = clean(df, key)
    enough = rows.groupBy(key).count().filter(F.col("count") >= min_rows).select(key)
    out = rows.withColumns({"hour": F.hour("timestamp"), "day_of_week": F.weekday("timestamp"), **calendar()})
    return lookup(out, enough, [key], "left_semi", salt_by="timestamp")


def rejected(df: DataFrame, key: str = "series_id", min_rows: int = MIN_ROWS) -> DataFrame:
    """P-26: series that are too short, with the rows they have. The reference raises for its one series."""
    return clean(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < min_rows)


def first_rows(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """SRC-05: first-N read; with ``order`` the same rows on every run."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


DRAW_BITS, LEVEL_BITS = 60, 12


def sample_rows(df: DataFrame, n: int, order: list[str], seed: int = 42) -> DataFrame:
    """SRC-05: ``n`` rows without replacement, the same rows for the same seed; all rows if there are fewer.

    A draw per row, from the identifying columns, decides. Two counts of
    4,096 cells each find the cell of the draw in which the n-th row lies; only
    rows up to it are kept, and only that cell, about one in 16 million rows, is
    ranked. So neither a task nor the driver ever holds the sample. Rows that
    tie in draw and ``order`` are taken by a hash of the row.
    """
    cells = 1 << LEVEL_BITS
    drawn = df.select(S.draw(seed, *order).alias("_draw")).withColumn("_cell", F.shiftright("_draw", DRAW_BITS - 2 * LEVEL_BITS))

    def cell_of_last(rows: DataFrame, cell: Column, wanted: Column) -> DataFrame:
        """One row: the cell that holds the last wanted row, and how many rows lie before it; null if there are too few."""
        counts = rows.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.max(wanted).alias("_wanted"))
        upto = F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))  # at most 4,096 rows
        reached = counts.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_wanted"))
        return reached.agg(F.min("_c").alias("_at"), F.min_by(F.col("_upto") - F.col("_n"), "_c").alias("_before"))

    # Joins with single rows.
    high = cell_of_last(drawn, F.floor(F.col("_cell") / cells), F.lit(n)).select(F.col("_at").alias("_high"), F.col("_before").alias("_skipped"))
    inside = drawn.crossJoin(F.broadcast(high)).filter(F.floor(F.col("_cell") / cells) == F.col("_high"))
    low = cell_of_last(inside, F.col("_cell") % cells, F.lit(n) - F.col("_skipped"))
    last = high.crossJoin(low).select(
        (F.col("_high") * cells + F.col("_at")).alias("_last"), (F.lit(n) - F.col("_skipped") - F.col("_before")).alias("_left")
    )
    cell = F.shiftright("_draw", DRAW_BITS - 2 * LEVEL_BITS)
    kept = df.withColumns({"_draw": S.draw(seed, *order), "_tie": row_hash(df)}).crossJoin(F.broadcast(last))
    kept = kept.filter(F.col("_last").isNull() | (cell <= F.col("_last"))).withColumn("_cell", cell)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", *order, "_tie"))
    taken = kept.withColumn("_rank", rank).filter(
        F.col("_last").isNull() | (F.col("_cell") < F.col("_last")) | (F.col("_rank") <= F.col("_left"))
    )
    return taken.select(*[F.col(f"`{c}`") for c in df.columns])


def quality_counts(df: DataFrame, key: str = "series_id") -> DataFrame:
    """A-36: rows read and rows left after each cleaning step, in one pass."""
    time_ok = time_column(df, "timestamp").isNotNull()
    metrics_ok = F.lit(True)
    for m in METRICS:
        metrics_ok = metrics_ok & finite(F.col(m).cast("double")).isNotNull()
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(metrics_ok).alias("rows_with_metrics"),
        F.count_if(metrics_ok & time_ok).alias("rows_usable"),
        (F.count_if(metrics_ok & time_ok) / F.count(F.lit(1))).alias("usable_rate"),
    )
