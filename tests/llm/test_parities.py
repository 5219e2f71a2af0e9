"""Near copies in large buckets: what parities of k-mers rule out, and that no k-mer becomes a row."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from telespan.llm import near_dedup
from tests.llm.fixture import edited, folder, frame, prose
from tests.llm.test_tasks import as_dicts, plain_classes


def large_buckets():
    """Copies of one text, some far from it and near to each other, of sizes around a change of width."""
    r = random.Random(9)
    base = prose(90, 133)  # 129 k-mers: 512 parities, and 256 a k-mer less
    out = []
    for k in range(60):
        far = edited(base, r.sample(range(2, 128), 5))
        out.append((k, far))
        words = edited(far, r.sample(range(2, 128), 1)).split()
        out.append((100 + k, " ".join(words[: len(words) - r.choice([0, 1, 2, 3])])))
    return out


def test_large_buckets_make_no_row_per_kmer(spark, tmp_path, monkeypatch):
    plans, write = [], near_dedup.materialize

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(near_dedup, "materialize", noted)
    items = large_buckets()
    docs = frame(spark, [(i, t, "en", "s", 1, 1, 1, "x") for i, t in items])
    got = {r["doc_id"]: r["class_id"] for r in as_dicts(near_dedup.op3_near_dedup(spark, folder(tmp_path, spark, documents=docs)))}
    assert got == plain_classes(items) and len(set(got.values())) == len(items) / 2
    assert "dup-rest" in [label for label, _ in plans]
    # Sketch values, a fixed number a text, are the only ones that become rows.
    assert {label for label, plan in plans if "Generate explode" in plan} == {"dup-buckets"}


def test_parities_bound_what_only_one_text_has(spark):
    items = [near_dedup.kmers([t])[0] for _, t in large_buckets()[:40]] + [near_dedup.kmers([prose(4, 150)])[0]]
    assert len({len(near_dedup.parities(x)) for x in items}) == 2
    pairs = [(i, j) for i in range(len(items)) for j in range(len(items))]
    rows = [(i, j, near_dedup.parities(items[i]).tolist(), near_dedup.parities(items[j]).tolist()) for i, j in pairs]
    made = spark.createDataFrame(rows, "i int, j int, x array<bigint>, y array<bigint>")
    found = made.select("i", "j", near_dedup.apart(F.col("x"), F.col("y")).alias("n")).collect()
    differ = {(r["i"], r["j"]): r["n"] for r in found}
    for i, j in pairs:
        alone = len(np.setxor1d(items[i], items[j], assume_unique=True))
        assert 0.3 * alone <= differ[i, j] <= alone and (alone - differ[i, j]) % 2 == 0
