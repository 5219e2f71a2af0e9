"""Row positions and bounded windows for series of any size.

A window partitioned by series alone runs one series in one task. Here every
series gets exact row positions from a range-partitioned sort, and bounded
look-back windows run over chunks of a series. Each chunk also receives the
last rows of the chunk before it (the halo), so results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from telespan.scratch import materialize

CHUNK_ROWS = 200_000
_POSITION_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


def row_hash(df: DataFrame) -> Column:
    """Of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.typeName()])


def same_keys(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null, so rows without a key are not lost."""
    renamed = table.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return rows.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"_of_{c}" for c in on])


def index_rows(
    df: DataFrame,
    keys: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("timestamp",),
    label: str = "series",
) -> DataFrame:
    """T-01: total order per key; adds 0-based ``row_idx`` and ``n_rows``.

    Rows that tie in ``order`` are put in the order of a hash of all their
    columns, so a rerun numbers them alike. A null key is a key like any other.
    Range partitioning splits a hot key over many tasks. The sorted rows are
    written once with their partition and position, because a second evaluation
    of the sampled ranges could differ.
    The span table has one row per (key, partition holding it): at most
    ``#keys + #partitions`` rows, because ranges keep a key contiguous.
    """
    keys, order = list(keys), list(order)
    tie = row_hash(df)
    placed = (
        df.repartitionByRange(*keys, *order, tie)
        .sortWithinPartitions(*keys, *order, tie)
        .select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("_pos"),
        )
    )
    stored = materialize(placed, label)
    by_key = Window.partitionBy(*keys)
    so_far = by_key.orderBy("_part")
    spans = (
        stored.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
        .select(
            *keys,
            "_part",
            (F.sum("_n").over(so_far) - F.col("_n") - F.col("_first")).alias("_shift"),
            F.sum("_n").over(by_key).alias("n_rows"),
        )
    )
    return same_keys(stored, spans, [*keys, "_part"]).select(
        *df.columns, (F.col("_pos") + F.col("_shift")).alias("row_idx"), "n_rows"
    )


SALTS = 16


def broadcast_by_size(table: DataFrame) -> bool:
    """Whether Spark broadcasts the table by the size it expects, so that a join with it shuffles nothing."""
    expected = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    session = table.sparkSession._jsparkSession.sessionState().conf()
    return 0 <= expected <= session.autoBroadcastJoinThreshold()


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", salt_by: str | Sequence[str] | None = None
) -> DataFrame:
    """Join rows with a table that has at most one row per key, safely for a hot key.

    Joining on the key alone would move all rows of a hot key to one task, and a
    later aggregation on the key would be planned on top without a shuffle, so
    nothing could split it. Here the join also uses a salt from the row
    position, and the table holds one copy per salt. Aggregations afterwards
    combine partial results first, and adaptive execution may broadcast the
    table when its measured size allows, or split skewed partitions.

    A table that is broadcast moves no rows and needs no salt: the driver and
    every executor would hold ``SALTS`` copies of it.
    """
    if broadcast_by_size(table):
        return same_keys(rows, table, on, how)
    if salt_by is None:
        others = [c for c in rows.columns if c not in on]
        salt_by = next((c for c in ("row_idx", "tail_idx", "tie") if c in others), others)
    by = [salt_by] if isinstance(salt_by, str) else list(salt_by)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return same_keys(salted, copies, [*on, "_salt"], how).drop("_salt")


def rebase(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keep rows ``[start, end)`` of each series and renumber them from zero.

    Positions are contiguous, so no new sort is needed.
    """
    return (
        df.withColumn("_start", start)
        .withColumn("_end", end)
        .filter((F.col("row_idx") >= F.col("_start")) & (F.col("row_idx") < F.col("_end")))
        .withColumn("row_idx", F.col("row_idx") - F.col("_start"))
        .withColumn("n_rows", F.col("_end") - F.col("_start"))
        .drop("_start", "_end")
    )


def split_chunks(df: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Assign ``chunk`` and copy the last ``halo`` rows of a chunk into the next one."""
    if chunk_rows < halo:
        raise ValueError(f"chunk_rows={chunk_rows} must be at least halo={halo}")
    own = F.floor(F.col("row_idx") / chunk_rows)
    feeds_next = (F.col("row_idx") % chunk_rows >= chunk_rows - halo) & (
        (own + 1) * chunk_rows < F.col("n_rows")
    )
    return df.withColumn(
        "chunk", F.explode(F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def chunk_window(keys: Sequence[str] = ("series_id",)) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("row_idx")


def drop_halo(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.filter(F.col("row_idx") >= F.col("chunk") * chunk_rows).drop("chunk")


def windowed(
    df: DataFrame,
    columns: dict[str, "callable"],
    look_back: int,
    keys: Sequence[str] = ("series_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns. Each value of ``columns`` maps a WindowSpec to a Column.

    All columns share one partitioning and one sort.
    """
    spec = chunk_window(keys)
    out = split_chunks(df, look_back, chunk_rows).withColumns({name: make(spec) for name, make in columns.items()})
    return drop_halo(out, chunk_rows)
