"""Exact quantiles of groups of any size (linear interpolation).

``percentile`` keeps every distinct value of a group in one buffer. Here a
bounded sketch gives a bracket around the wanted rank, the values inside it are
counted exactly, and only they are ranked. The bracket is cut again into equal
slices, so no task ranks more than a small share of a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from telespan.operators.layout import lookup, row_hash

SKETCH_ACCURACY = 10_000
_MARGIN = 5.0 / SKETCH_ACCURACY
_SLICES = 256


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    name: str = "threshold",
) -> DataFrame:
    """A-04: one row per key with the ``q`` quantile of the non-null values.

    The result is checked: if the sketch bracket ever missed the rank, the job
    fails instead of returning a wrong value.
    """
    keys = list(keys)
    position = [c for c in ("row_idx", "tail_idx", "tie") if c in df.columns and c not in keys][:1]
    # Salted by position or else by the whole row: equal values alone may be most of the table.
    at = F.col(position[0]) if position else row_hash(df)
    data = df.select(*keys, at.alias("_at"), F.col(value).alias("_v"))
    data = data.filter(F.col("_v").isNotNull())
    sketch = data.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", [max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0)], SKETCH_ACCURACY).alias("_b"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # One rank of slack on both sides covers the interpolation partner.
    bounds = sketch.select(
        *keys,
        ((F.col("_n") - 1) * F.lit(q)).alias("_h"),
        F.when(F.lit(q - _MARGIN <= 0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(F.lit(q + _MARGIN >= 1), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
        "_max",
    )
    placed = lookup(data, bounds, keys, salt_by="_at")
    width = F.col("_hi") - F.col("_lo")
    slice_no = (
        F.when(F.col("_v") < F.col("_lo"), F.lit(-1))
        .when(F.col("_v") > F.col("_hi"), F.lit(_SLICES))
        .when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * _SLICES), F.lit(_SLICES - 1)))
        .otherwise(F.lit(0))
        .cast("int")
    )
    # Rows outside the bracket keep only a count and their nearest value.
    inside = (F.col("_s") >= 0) & (F.col("_s") < _SLICES)
    counted = (
        placed.withColumn("_s", slice_no)
        .groupBy(*keys, "_h", "_s", F.when(inside, F.col("_v")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_near_hi"), F.max("_v").alias("_near_lo"))
        .select(
            *keys,
            "_h",
            "_s",
            "_c",
            F.when(F.col("_s") < 0, F.col("_near_lo")).otherwise(F.col("_near_hi")).alias("_x"),
        )
    )
    by_slice = counted.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sc"))
    starts = by_slice.select(
        *keys,
        "_s",
        (F.sum("_sc").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("_sc")).alias("_before"),
    )
    low, high = F.floor("_h"), F.ceil("_h")
    ranked = (
        counted.join(starts, [*keys, "_s"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_x")))
        .withColumn("_begin", F.col("_end") - F.col("_c"))
    )
    # A group outside the bracket answers a rank only at its inner edge, where its value is known.
    def holds(rank):
        edge = (
            F.when(F.col("_s") < 0, rank == F.col("_end") - 1)
            .when(F.col("_s") >= _SLICES, rank == F.col("_begin"))
            .otherwise(F.lit(True))
        )
        return (rank >= F.col("_begin")) & (rank < F.col("_end")) & edge

    picked = ranked.groupBy(*keys, "_h").agg(
        F.max(F.when(holds(low), F.col("_x"))).alias("_a"),
        F.max(F.when(holds(high), F.col("_x"))).alias("_z"),
    )
    found = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    interpolated = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h"))
    return picked.select(
        *keys,
        F.when(found, interpolated)
        .otherwise(F.raise_error(F.lit("quantile bracket missed the rank")).cast("double"))
        .alias(name),
    )
