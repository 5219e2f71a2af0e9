"""Scores along a grid of weights, against every row at every weight."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.operators import blend as L

SCHEMA = "series_id string, metric string, row_idx bigint, actual double, first double, second double, threshold double"


def cases():
    draw = np.random.default_rng(3)
    out = []
    for series, n in (("long", 3_000), ("short", 7), ("one", 1)):
        for i in range(n):
            out.append((series, "m", i, *(float(x) for x in draw.normal(10, 4, 3)), 12.0))
    # Equal forecasts, forecasts equal to the actual value or to the threshold, crossings on grid points.
    steps = [0.0, 1.0, 2.0, 4.0, 8.0]
    out += [("ties", "m", i, a, f, s, 2.0) for i, (a, f, s) in enumerate((a, f, s) for a in steps for f in steps for s in steps)]
    out += [("same", "m", i, float(i % 5), 3.0, 3.0, 2.5) for i in range(40)]
    out += [("gaps", "m", 0, 1.0, None, 2.0, 1.5), ("gaps", "m", 1, None, 1.0, 2.0, 1.5), ("gaps", "m", 2, 2.0, 1.0, 3.0, 1.5)]
    out += [("none", "m", 0, 1.0, None, 2.0, 1.5)]
    out += [("tiny", "m", 0, 1.0, 1.0 + 1e-12, 1.0, 1.0), ("tiny", "m", 1, 1e9, 1e-9, 1e9, 5e8)]
    return out


def plain(rows, steps, per):
    for i in range(steps):
        w = i / per
        use = [(a, w * f + (1.0 - w) * s, t) for *_, a, f, s, t in rows if None not in (a, f, s)]
        mae = sum(abs(p - a) for a, p, _ in use) / len(use) if use else None
        yield i, mae, sum(a > t and p > t for a, p, t in use), sum(a <= t < p for a, p, t in use), sum(a > t >= p for a, p, t in use)


@pytest.mark.parametrize("steps, per", [(41, 40), (20, 20), (1, 1), (2, 1)])
def test_scores_at_every_weight(spark, steps, per):
    df = spark.createDataFrame(cases(), SCHEMA)
    got = L.grid_scores(df, steps, per, F.col("second"), F.col("first"), F.col("threshold")).collect()
    assert len(got) == steps * len({r[0] for r in cases()})
    by = {}
    for r in got:
        by.setdefault(r["series_id"], {})[r["_i"]] = r
    for series, found in by.items():
        for i, mae, tp, fp, fn in plain([r for r in cases() if r[0] == series], steps, per):
            assert (found[i]["tp"], found[i]["fp"], found[i]["fn"]) == (tp, fp, fn), (series, i)
            # Sums over rows: rounding is that of the largest values, which is 1e9 for "tiny".
            close = mae if mae is None else pytest.approx(mae, rel=1e-12, abs=1e-6 if series == "tiny" else 1e-12)
            assert found[i]["_mae"] == close, (series, i)


def test_no_row_is_copied_for_the_grid(spark):
    """Generated rows do not grow with the steps."""
    df = spark.createDataFrame(cases(), SCHEMA)
    shuffled = []
    for steps in (11, 41):
        entries = L.grid_scores(df, steps, steps - 1, F.col("second"), F.col("first"), F.col("threshold"))
        plan = entries._jdf.queryExecution().optimizedPlan().toString()
        shuffled.append(plan.count("Generate"))
    assert shuffled == [2, 2]  # two entries a row; one row a grid point after the sums


def test_empty_grid(spark):
    assert L.grid_scores(spark.createDataFrame([], SCHEMA), 41, 40, F.col("second"), F.col("first")).collect() == []
