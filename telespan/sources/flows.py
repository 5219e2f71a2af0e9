"""SRC-03 / SRC-04: flow logs and flow counts to telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telespan.functions import scalar as S
from telespan.model import require_columns
from telespan.operators.layout import index_rows, lookup, rebase, windowed
from telespan.operators.quantile import exact_quantile

HIGH_LOAD_QUANTILE = 0.88
LABEL = "flow-converted"


def flow_columns(df: DataFrame, key: str) -> DataFrame:
    """Key, time and what the bins add up; absent optional columns are null, rows with an unreadable time go."""
    require_columns(df, [key, "Timestamp"])

    def optional(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("double")

    return df.select(
        F.col(key),
        S.time_column(df, "Timestamp").alias("_ts"),
        S.finite(optional("Flow Bytes/s").cast("double")).alias("_rate"),
        S.finite(optional("Flow Duration").cast("double")).alias("_duration"),
        F.coalesce(optional("PSH Flag Count") > 0, F.lit(False)).alias("_psh"),
        F.coalesce(optional("RST Flag Count") > 0, F.lit(False)).alias("_rst"),
    ).filter(F.col("_ts").isNotNull())


def bin_aggregates(bits: bool = False, clip_loss: bool = False) -> list[Column]:
    """A-03: the three metrics of a bin, for batch and stream alike."""
    loss = 100.0 * (F.count_if("_psh") + F.count_if("_rst")) / F.count(F.lit(1))
    return [
        (F.coalesce(F.sum("_rate"), F.lit(0.0)) * (8.0 if bits else 1.0) / 1e6).alias("traffic_mbps"),
        F.coalesce(F.avg("_duration"), F.lit(0.0)).alias("latency_ms"),
        (F.least(F.lit(100.0), loss) if clip_loss else loss).alias("packet_loss_pct"),
    ]


def bin_flow_log(
    df: DataFrame,
    bin_minutes: int = 1,
    key: str = "series_id",
    bits: bool = False,
    clip_loss: bool = False,
) -> DataFrame:
    """SRC-04 / A-03: fixed time bins per series.

    Traffic is bytes per second over 1e6, as in the reference; ``bits`` adds the
    factor 8. The flag-based loss proxy may pass 100; ``clip_loss`` bounds it.
    Absent optional columns count as 0, unreadable times drop the row, and
    non-finite rates are ignored.
    """
    bins = flow_columns(df, key).groupBy(key, S.floor_minutes("_ts", bin_minutes).alias("timestamp"))
    return bins.agg(*bin_aggregates(bits, clip_loss))


def clean_flow_counts(df: DataFrame) -> DataFrame:
    """P-02 .. P-04 on flow counts."""
    require_columns(df, ["date", "l_ipn", "f"])
    extra = ["r_asn"] if "r_asn" in df.columns else []
    return df.select(
        S.time_column(df, "date").alias("date"),
        S.parse_number("l_ipn").cast("bigint").alias("l_ipn"),
        *extra,
        S.parse_number("f").alias("f"),
    ).dropna(subset=["date", "l_ipn", "f"])


def sum_flows(df: DataFrame) -> DataFrame:
    """A-01"""
    keys = ["date", "l_ipn"] + (["r_asn"] if "r_asn" in df.columns else [])
    return df.groupBy(*keys).agg(F.sum("f").alias("f"))


def workstations(df: DataFrame) -> DataFrame:
    """A-02 / U-04: distinct keys with their row counts."""
    return df.groupBy("l_ipn").agg(F.count(F.lit(1)).alias("rows"))


def most_active(df: DataFrame) -> DataFrame:
    """A-02: the key with most rows; the smallest key wins a tie."""
    return workstations(df).agg(F.max_by("l_ipn", F.struct("rows", -F.col("l_ipn"))).alias("l_ipn"))


def slice_start(key: Column, n_rows: Column, length: int, seed: int) -> Column:
    """W-13: a seeded start for a contiguous slice, the same on every run."""
    room = F.greatest(n_rows - length, F.lit(0))
    return F.pmod(S.draw(seed, key), room + 1)


def telemetry_from_counts(
    df: DataFrame,
    rows: int | None = None,
    seed: int = 7,
    only: str = "all",
    key: int | None = None,
) -> DataFrame:
    """SRC-03: flow counts to telemetry, one series per workstation.

    ``only`` is ``all``, ``most_active`` or ``key``. ``rows`` keeps a contiguous
    slice per series (W-13). Times shifted past midnight are sorted again, so
    time order always holds.
    """
    data = clean_flow_counts(df)
    if only == "key":
        data = data.filter(F.col("l_ipn") == key)
    elif only == "most_active":
        data = data.join(F.broadcast(most_active(data)), "l_ipn", "left_semi")  # a single row
    profile = sum_flows(data)
    tie = [c for c in ("r_asn",) if c in profile.columns]
    ordered = index_rows(profile, ["l_ipn"], ["date", *tie], "counts")
    if rows is not None:
        start = slice_start(F.col("l_ipn"), F.col("n_rows"), rows, seed)
        ordered = rebase(ordered, start, F.least(F.col("n_rows"), start + rows))
    # W-05: the minute inside a date is the position minus the first position of the date. After the
    # sums a (key, date) holds one row per remote network, so this fine-grained join needs no salt.
    day_starts = ordered.groupBy("l_ipn", "date").agg(F.min("row_idx").alias("_first"))
    extent = ordered.groupBy("l_ipn").agg(
        F.min(S.clip("f")).alias("_low"), F.max(S.clip("f")).alias("_high")
    )
    scaled = (
        lookup(ordered.join(day_starts, ["l_ipn", "date"]), extent, ["l_ipn"])
        .select(
            "l_ipn",
            (F.col("date") + F.make_interval(mins=(F.col("row_idx") - F.col("_first")).cast("int"))).alias("timestamp"),
            F.col("row_idx").alias("tie"),
            S.min_max(S.clip("f"), F.col("_low"), F.col("_high")).alias("_n"),
        )
        .withColumn("_traffic", S.traffic_of(F.col("_n")))
    )
    high = exact_quantile(scaled, ["l_ipn"], "_traffic", HIGH_LOAD_QUANTILE, "_high_load")
    label = {
        "all": F.concat(F.lit(f"{LABEL}:l_ipn="), F.col("l_ipn").cast("string")),
        "key": F.concat(F.lit(f"{LABEL}:l_ipn="), F.col("l_ipn").cast("string")),
        "most_active": F.concat(F.lit(f"{LABEL}:auto_most_active_l_ipn="), F.col("l_ipn").cast("string")),
    }[only]
    return lookup(scaled, high, ["l_ipn"]).select(
        F.col("l_ipn").cast("string").alias("series_id"),
        "timestamp",
        "tie",
        S.round3("_traffic").alias("traffic_mbps"),
        S.round3(S.latency_of(F.col("_n"))).alias("latency_ms"),
        S.round3(S.loss_of(F.col("_n"), F.col("_traffic") > F.col("_high_load"))).alias("packet_loss_pct"),
        label.alias("source"),
    )


def with_deltas(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """W-04: first differences, 0 on the first row, three places."""
    ordered = df if "row_idx" in df.columns else index_rows(df, ["series_id"], order or ["timestamp", "tie"], "deltas")

    def delta(metric):
        return lambda w: S.round3(F.coalesce(F.col(metric) - F.lag(metric).over(w), F.lit(0.0)))

    return windowed(ordered, {"traffic_delta": delta("traffic_mbps"), "latency_delta": delta("latency_ms")}, 1)


def spike_threshold_sidecar(df: DataFrame, q: float = 0.90) -> DataFrame:
    """SNK-05: thresholds of every series and metric, ready to write."""
    from telespan.operators.forecasts import to_long

    return exact_quantile(to_long(df), ["series_id", "metric"], "value", q).withColumn("quantile", F.lit(q))
