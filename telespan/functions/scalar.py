"""Row expressions: calendar, transforms, clips, flags (P-03 .. P-25)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Per-metric affine mapping of normalized flow counts.
TRAFFIC_FLOOR, TRAFFIC_SPAN = 10.0, 140.0
LATENCY_BASE, LATENCY_SPAN, LATENCY_MIN = 2.0, 14.0, 0.5
LOSS_BASE, LOSS_SPAN = 0.2, 2.3


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(x: Column | str) -> Column:
    """P-03: unreadable text becomes NULL. Zone-free, so no session setting matters."""
    return F.try_to_timestamp(_c(x).cast("string")).cast("timestamp_ntz")


def time_column(df: DataFrame, name: str) -> Column:
    """P-03 for a column of any type: typed times are only cast, text is parsed."""
    typed = dict(df.dtypes)[name].startswith(("timestamp", "date"))
    return F.col(name).cast("timestamp_ntz") if typed else parse_timestamp(name)


def parse_number(x: Column | str) -> Column:
    """P-04: unreadable text, NaN and infinities become NULL."""
    return finite(_c(x).try_cast("double"))


def finite(x: Column | str) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(ts))


def floor_minutes(ts: Column | str, minutes: int) -> Column:
    """P-14: start of the enclosing fixed bin, aligned to the epoch."""
    return F.window(_c(ts), f"{minutes} minutes")["start"]


def calendar(ts: Column | str = "timestamp") -> dict[str, Column]:
    """P-05: cyclic hour and weekday (Monday is 0)."""
    ts = _c(ts)
    hour = 2.0 * math.pi * F.coalesce(F.hour(ts), F.lit(0)) / 24.0
    day = 2.0 * math.pi * F.coalesce(F.weekday(ts), F.lit(0)) / 7.0
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "weekday_sin": F.sin(day),
        "weekday_cos": F.cos(day),
    }


def is_weekend(ts: Column | str = "timestamp") -> Column:
    """P-06: 1.0 on Saturday and Sunday, 0.0 for a missing time."""
    return (F.coalesce(F.weekday(_c(ts)), F.lit(0)) >= 5).cast("double")


def sqrt_loss(x: Column | str = "packet_loss_pct") -> Column:
    """P-07. Negative input gives NaN."""
    return F.sqrt(_c(x))


def square_loss(x: Column | str = "packet_loss_pct") -> Column:
    """P-08: inverse of :func:`sqrt_loss`, never below zero."""
    return F.greatest(F.lit(0.0), _c(x) * _c(x))


def clip(x: Column | str, low: float | None = 0.0, high: float | None = None) -> Column:
    """P-09. NULL stays NULL: ``greatest`` alone would skip it."""
    x = _c(x)
    out = x
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(x.isNotNull(), out)


def round3(x: Column | str) -> Column:
    """P-12: three places, ties to even."""
    return F.rint(_c(x) * 1000.0) / 1000.0


def min_max(x: Column, low: Column, high: Column) -> Column:
    """P-10: 0 when the range is empty."""
    return F.when(high > low, (x - low) / F.when(high > low, high - low)).otherwise(F.lit(0.0))


def traffic_of(n: Column) -> Column:
    """P-11"""
    return F.lit(TRAFFIC_FLOOR) + F.lit(TRAFFIC_SPAN) * n


def latency_of(n: Column) -> Column:
    """P-11"""
    return F.greatest(F.lit(LATENCY_MIN), F.lit(LATENCY_BASE) + n * LATENCY_SPAN)


def loss_of(n: Column, high_load: Column) -> Column:
    """P-11"""
    return clip(F.when(high_load, F.lit(LOSS_BASE) + F.lit(LOSS_SPAN) * n).otherwise(F.lit(0.0)), 0.0, 100.0)


def is_spike(value: Column | str, threshold: Column | str) -> Column:
    """P-16: strict."""
    return _c(value) > _c(threshold)


def any_spike(pairs: list[tuple[Column, Column]]) -> Column:
    """P-17"""
    out = F.lit(False)
    for value, threshold in pairs:
        out = out | (value > threshold)
    return out


def spike_weight_factor(multiplier: Column, spike: Column, spike_weight: float) -> Column:
    """P-18 / M-08: the multiplier counts once as a metric weight and once on spikes."""
    return multiplier * (1.0 + F.lit(float(spike_weight)) * spike.cast("double") * multiplier)


def spike_weighted_term(
    error: Column, multiplier: Column, spike: Column, spike_weight: float = 4.0, focal_gamma: float = 0.0
) -> Column:
    """P-18: squared error with focal and spike weights, for one metric of one row."""
    focal = F.lit(1.0) if focal_gamma <= 0 else 1.0 + F.pow(F.abs(error), F.lit(float(focal_gamma)))
    return error * error * focal * spike_weight_factor(multiplier, spike, spike_weight)


def smape_term(actual: Column, predicted: Column) -> Column:
    """P-19"""
    return 2.0 * F.abs(predicted - actual) / F.greatest(F.abs(actual) + F.abs(predicted), F.lit(1e-9))


def volatility_class(cv: Column) -> Column:
    """P-20"""
    return F.when(cv > 0.6, "high").when(cv > 0.25, "medium").otherwise("low")


def draw(seed: int, *key: Column | str) -> Column:
    """SRC-05, W-13, T-06: a number below 2**60 from the MD5 digest of ``seed:key``; any engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def fingerprint(rows: Column, volatility: Column, spike_rate: Column, traffic_std: Column) -> Column:
    """P-21: 12 hex digits over a fixed-format text; numbers are whole thousandths and hundredths."""
    payload = F.concat_ws(
        "|",
        rows.cast("bigint").cast("string"),
        volatility,
        F.rint(spike_rate * 1000).cast("bigint").cast("string"),
        F.rint(traffic_std * 100).cast("bigint").cast("string"),
    )
    return F.substring(F.sha1(payload), 1, 12)


def normalize_quality(q: Column) -> Column:
    """P-22: above 1 is a percentage. A quality in (0, 1] percent therefore reads as a fraction."""
    return F.when(q > 1.0, q / 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))


def spike_lift(predicted: Column, threshold: Column, near: Column, lift: Column) -> Column:
    """P-23: raise forecasts that are near a threshold."""
    return F.when(predicted > threshold * near, F.greatest(predicted, threshold * lift)).otherwise(predicted)


def parse_metric_values(text: Column) -> Column:
    """A comma list such as ``1.0,1.8,2.5`` as an array of numbers; other lengths become NULL."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) == 3, F.transform(parts, lambda p: p.try_cast("double")))


def log_ratio_score(model_mae: Column, baseline_mae: Column) -> Column:
    """P-24: 1 when the error is half of the baseline's."""
    ratio = F.greatest(baseline_mae, F.lit(1e-9)) / F.greatest(model_mae, F.lit(1e-9))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log2(ratio)))
