"""Operators made of column expressions, against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.llm import mixing, pii, quality, sharding
from tests.llm.fixture import SCHEMA, folder, frame, prose, rows


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_sharding(spark, tmp_path):
    got = as_dicts(sharding.op1_sharding(spark, folder(tmp_path, spark, documents=frame(spark))))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["law"] for r in got} == {"bytes"} and set(by_shard) <= set(range(24))


@pytest.mark.parametrize("hot", ["copies without an id", "one repeated id"])
def test_a_key_with_a_third_of_all_rows_is_dealt_to_all_shards(spark, hot):
    docs = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(5 if hot == "one repeated id" else None)).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).otherwise(F.lit("the same text " * 3)).alias("text"),
    )
    got = sharding.shard_documents(docs).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == 30_000 and len(loads) == 24 and loads.max() < 1.01 * loads.min()
    assert all(sorted(p) == list(range(len(p))) for _, p in got.groupby("shard").position)
    assert got.slot.nunique() <= sharding.N_SLOTS + sharding.MOST_PIECES
    assert got[got.doc_id.isna() | (got.doc_id == 5)].groupby("slot")["size"].sum().max() < 2 * got["size"].sum() / sharding.MOST_PIECES


def test_shards_are_even_and_maps_change_little(spark):
    rows_ = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 8).alias("size"))
    rows_ = rows_.withColumn("slot", sharding.slot_of(F.col("doc_id"), F.lit("")))
    sizes = sharding.slot_sizes(rows_).cache()
    first = sharding.first_map(sizes, 8).cache()
    loads = sorted(r[0] for r in first.join(sizes, "slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect())
    assert loads[-1] - loads[0] < 0.01 * loads[0]
    grown = sharding.rebalance(first, sizes, 9).cache()
    assert grown.count() == first.count() and grown.select("version").distinct().collect()[0][0] == 2
    moved = grown.join(first.withColumnRenamed("shard", "was"), "slot").where("shard != was").agg(F.count("*")).first()[0]
    assert moved < first.count() / 6
    new = [r[0] for r in grown.join(sizes, "slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(new) == 9 and max(new) < 1.05 * sum(new) / 9


def test_mixing_meets_targets(spark):
    some = [(i, prose(i, 20 + i % 7), ["en", "de"][i % 2], ["a", "b", "b", "b"][i % 4], 1, 1, 1, "x") for i in range(400)]
    docs = frame(spark, some)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 1.0}}
    fitted = mixing.fit(mixing.describe(docs), targets, 0.3).toPandas()
    assert abs(fitted.groupby("mix_source").share.sum()["a"] - 0.5) < 5e-3
    assert abs(fitted.groupby("mix_lang").share.sum()["en"] - 0.6) < 5e-3
    mixed = mixing.mix(docs, targets, 0.3)
    kept = mixed.where("mix_kept").count()
    assert 70 < kept < 170 and mixed.count() == 400 and set(docs.columns) <= set(mixed.columns)
    assert [r[0] for r in mixing.mix(docs, targets, 0.3).where("mix_kept").select("doc_id").collect()] == [
        r[0] for r in mixed.where("mix_kept").select("doc_id").collect()
    ]


@pytest.mark.parametrize("on_driver", [200_000, 0])
def test_mixing_keeps_the_budget_when_cells_are_whole(spark, monkeypatch, on_driver):
    """Default targets and a hot source: topics too small for their target are whole, all others meet theirs in proportion."""
    monkeypatch.setattr(mixing, "CELLS_ON_DRIVER", on_driver)
    ends = {"contact": " a@b", "legal": " License", "table": " | x", "prose": ""}
    some = []
    for i in range(1200):
        topic = "contact" if i % 40 == 0 else "legal" if i % 40 == 1 else "table" if i % 10 == 2 else "prose"
        source = "hot" if i % 3 else f"s{i % 5}"
        some.append((i, prose(i, 20 + i % 7) + ends[topic], ["en", "de", "fr"][i // 3 % 3], source, 1, 1, 1, "x"))
    described = mixing.describe(frame(spark, some))
    tokens = described.groupBy(*mixing.MARGINS).agg(F.sum("mix_tokens").alias("tokens")).toPandas()
    got = mixing.fit(described).toPandas().merge(tokens, on=mixing.MARGINS)
    assert len(got) == len(tokens) and got.mix_probability.max() <= 1 and (got.mix_probability == 1).any()
    kept, total = (got.mix_probability * got.tokens).sum(), got.tokens.sum()
    assert abs(kept / total - mixing.BUDGET) < 1e-3
    for name in mixing.MARGINS:
        by = got.assign(kept=got.mix_probability * got.tokens).groupby(name).agg(
            kept=("kept", "sum"), most=("tokens", "sum"), target=(f"{name}_target", "first"), share=(f"{name}_share", "first")
        )
        assert np.allclose(by.kept / kept, by.share)
        wanted = np.ones(len(by), bool)
        for _ in range(len(by)):  # values that stay below their part of what the others leave
            part = by.target * (kept - by.most[~wanted].sum()) / by.target[wanted].sum()
            wanted &= (part <= by.most).to_numpy()
        assert np.allclose(by.kept, np.where(wanted, part, by.most), atol=2e-4 * total)


def test_mixing_defined_rows(spark, tmp_path):
    got = as_dicts(mixing.op2_mixing(spark, folder(tmp_path, spark, documents=frame(spark))))
    assert len(got) == len(rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["kept"])
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None)
    assert all(r["source"] is not None and r["lang"] is not None for r in got)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                yield f"{kind}:{m.start()}:{m.end()}"


PII_TEXTS = [
    "a@b.c..d@e.f x_y@z.co.uk- @no.org q@r",
    "a@b.c_d@e.f.g " * 3,
    "1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1 1.1.1 é1.1.1.1\U0001f642 2.2.2.2",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1111 4111  1111 1111 1111 41111111111111111111 5 4111111111111112",
    "+1 (456) 555-2186 +49 30 1234567 +1234567 +12345678901234567 ++1 23 45 67 89 0",
    "1 2 " * 4000 + "a." * 4000 + "@x" + ".y" * 4000 + " " + "9" * 5000,
    "",
]


def test_pii_base_spans(spark, tmp_path):
    some = [(i, t, "en", "s", 1, 1, 1, "x") for i, t in enumerate(PII_TEXTS)] + [(50 + i, *r[1:]) for i, r in enumerate(rows())]
    texts = {r[0]: r[1] for r in some}
    for r in as_dicts(pii.op5_pii(spark, folder(tmp_path, spark, documents=frame(spark, some)))):
        spans = list(base_spans(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r["spans"].split(",")) or not spans


def test_pii_checks_and_context(spark):
    some = [
        "iban GB82WEST12345698765432 and GB82WEST12345698765433",
        "tel 030 123-4567",
        "number 030 123-4567",
        "card 4111 1111 1111 1111",
        "xxxx 4111 1111 1111 1111",
    ]
    found = as_dicts(pii.detect(frame(spark, [(i, t, "en", "s", 1, 1, 1, "x") for i, t in enumerate(some)])).orderBy("doc_id"))
    assert [s["m"] for s in found[0]["pii_iban"]] == ["GB82WEST12345698765432"]
    assert len(found[1]["pii_local_phone"]) == 1 and not found[2]["pii_local_phone"]
    assert found[3]["pii_card"][0]["score"] > found[4]["pii_card"][0]["score"]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_quality_measures(spark, tmp_path):
    got = as_dicts(quality.op8_quality_rules(spark, folder(tmp_path, spark, documents=frame(spark))))
    want = []
    for r in rows():
        t = r[1] or ""
        w = words_of(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append(
            (r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        )
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert any(r["kept"] for r in got)


def test_quality_learns_rules(spark):
    good = [(i, prose(i, 60), "en", "s", 1, 1, 1, "x") for i in range(150)]
    loud = [(200 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "en", "s", 1, 1, 1, "x") for i in range(12)]
    marked = [(300 + i, " ".join(w + "%%%" for w in prose(i, 60).split()), "en", "s", 1, 1, 1, "x") for i in range(12)]
    judged = {r["doc_id"]: r["kept"] for r in as_dicts(quality.judge(frame(spark, good + loud + marked)))}
    assert all(judged[i] for i in range(150)) and not any(v for k, v in judged.items() if k >= 200)
    p = quality.estimate(quality.votes(quality.measures(frame(spark, good + loud + marked))))
    # Silent on loudness, the 12 marked ones get a wrong vote from this rule: right in 162 of 174.
    assert abs(quality.accuracies(p)["shouting"] - 162 / 174) < 0.02


@pytest.mark.parametrize("make", [sharding.op1_sharding, mixing.op2_mixing, pii.op5_pii, quality.op8_quality_rules])
def test_empty_tables(spark, tmp_path, make):
    assert make(spark, folder(tmp_path, spark, documents=spark.createDataFrame([], SCHEMA))).count() == 0
