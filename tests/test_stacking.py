"""Stacking of many runs, against all vectors scored one by one."""

from __future__ import annotations

import numpy as np
import pytest

from telespan.operators import blend as L


def long_rows(runs, n, seed):
    r = np.random.default_rng(seed)
    out = []
    for series in ("a", "b"):
        actual = r.standard_normal(n).cumsum()
        for k in range(runs):
            # Runs lack some of the oldest rows, each its own number.
            predicted = actual[k % 3 :] + r.standard_normal(n - k % 3) * (0.5 + k % 4)
            out += [(series, f"run{k:02d}", "traffic_mbps", i, float(a), float(p)) for i, (a, p) in enumerate(zip(actual[k % 3 :], predicted))]
    return out


@pytest.mark.parametrize("runs", [3, 8, 20])
def test_weights_are_the_best_of_all_vectors(spark, monkeypatch, runs):
    monkeypatch.setattr(L, "SCORED_ROWS", 17)  # many groups, added up in two steps
    monkeypatch.setattr(L, "SUMMED", 2)
    rows = long_rows(runs, 90, runs)
    methods = sorted({r[1] for r in rows})
    df = spark.createDataFrame(rows, "series_id string, method string, metric string, row_idx bigint, actual double, predicted double")
    got = {r.series_id: r for r in L.stacking_weights(df, methods, 200).collect()}
    vectors = L.weight_vectors(runs, 200)
    assert vectors.shape == (runs + 201, runs) and np.allclose(vectors.sum(axis=1), 1) and (vectors >= 0).all()
    assert set(got) == {"a", "b"}
    for s, found in got.items():
        tails = [[r[5] for r in rows if r[0] == s and r[1] == m][::-1][: 90 - min(2, runs - 1)] for m in methods]
        actual = np.array([r[4] for r in rows if r[0] == s and r[1] == methods[0]][::-1][: len(tails[0])])
        errors = np.abs(vectors @ np.array(tails) - actual).mean(axis=1)
        assert found.val_mae == pytest.approx(errors.min(), abs=1e-12)
        assert np.allclose([found[f"w{i}"] for i in range(runs)], vectors[np.round(errors, 9).argmin()])
        assert found.val_mae <= min(np.abs(np.array(t) - actual).mean() for t in tails) + 1e-12


def test_one_run_has_no_weights(spark):
    assert L.stacking_weights(spark.createDataFrame([("a", "m", "x", 0, 1.0, 1.0)], "series_id string, method string, metric string, row_idx bigint, actual double, predicted double"), ["m"]) is None


@pytest.mark.parametrize("lengths", [(90, 90), (90, 30)])
def test_short_series_hand_on_no_sums(spark, monkeypatch, lengths):
    """One series over ``SCORED_ROWS`` rows hands on arrays of sums, one under it only its weights; both have the best of all vectors."""
    monkeypatch.setattr(L, "SCORED_ROWS", 40)
    written = []
    monkeypatch.setattr(L, "materialize", lambda df, label: written.append(df.cache()) or written[-1])
    rows = [r for n, s in zip(lengths, "ab") for r in long_rows(3, n, n) if r[0] == s]
    methods = sorted({r[1] for r in rows})
    df = spark.createDataFrame(rows, "series_id string, method string, metric string, row_idx bigint, actual double, predicted double")
    found = {r.series_id: r for r in L.stacking_weights(df, methods, 200).collect()}
    vectors = L.weight_vectors(3, 200)
    for n, s in zip(lengths, "ab"):
        tails = [[r[5] for r in rows if r[0] == s and r[1] == m][::-1][: n - 2] for m in methods]
        actual = np.array([r[4] for r in rows if r[0] == s and r[1] == methods[0]][::-1][: n - 2])
        errors = np.abs(vectors @ np.array(tails) - actual).mean(axis=1)
        assert found[s].val_mae == pytest.approx(errors.min(), abs=1e-12)
        assert np.allclose([found[s][f"w{i}"] for i in range(3)], vectors[np.round(errors, 9).argmin()])
    sums = {(r.series_id, r.sums is None) for r in written[0].select("series_id", "sums").collect()}
    assert sums == {(s, n <= 40) for n, s in zip(lengths, "ab")}
