"""Seeded samples by counts of cells, against a plain sort."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from telespan.functions import scalar as S
from telespan.sources import telemetry


def plain(seed, *key):
    return int(hashlib.md5(":".join([str(seed), *[str(k) for k in key if k is not None]]).encode()).hexdigest()[:15], 16)


def test_draw(spark):
    rows = [(1, "a"), (2, None), (None, "é"), (None, None)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    got = [r[0] for r in df.coalesce(1).select(S.draw(7, "k", "s")).collect()]
    assert got == [plain(7, *r) for r in rows] and all(0 <= x < 2**60 for x in got)


@pytest.mark.parametrize("n", [0, 1, 2, 500, 4_999, 5_000, 5_001])
def test_sample_is_exact(spark, n):
    df = spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = sorted(r["k"] for r in telemetry.sample_rows(df, n, ["k"], seed=3).collect())
    assert got == sorted(sorted(range(5_000), key=lambda k: (plain(3, k), k))[:n])


def test_sample_of_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "x")] * 40 + [(None, "y")] * 40 + [(k, "z") for k in range(2, 12)]
    df = spark.createDataFrame(rows, "k bigint, v string")
    for n in (1, 39, 41, 89, 90, 91):
        out = telemetry.sample_rows(df, n, ["k"])
        assert out.columns == ["k", "v"] and out.count() == min(n, 90)
    assert telemetry.sample_rows(df.limit(0), 5, ["k"]).count() == 0


def test_sample_ranks_only_the_last_cell(spark):
    """The plan has no global sort of the rows and no limit."""
    plan = telemetry.sample_rows(spark.range(100).toDF("k"), 10, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
