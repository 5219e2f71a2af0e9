"""The pipeline's stages against plain versions, on rows with every oddity."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from telespan.llm import decontaminate, mixing, toxicity
from tests.llm.fixture import folder, frame, prose, rows
from tests.llm.test_tasks import near_corpus, plain_classes, toxic_corpus


def corpus():
    toxic, labels = toxic_corpus()
    near = [(i + 20_000, t, "en", "src1", 1, 1, 1, "x") for i, t in near_corpus()]
    odd = [(None if r[0] is None else r[0] + 40_000, *r[1:]) for r in rows()]
    item = prose(900, 60)
    dirty = [(50_000, prose(7, 30) + " " + item, "en", "src0", 1, 1, 1, "x"), (50_001, item + " " + prose(9, 4000), "en", None, 1, 1, 1, "x")]
    return toxic[:240] + near + odd + dirty, labels[:240], [(1, item)]


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    path = folder(
        tmp_path,
        spark,
        documents=frame(spark, docs),
        labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame(items, "item_id bigint, text string"),
    )
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "mixing", "sharding"]
    now, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, path)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = Counter(r["doc_id"] for r in now.collect())
    text = {d[0]: d[1] for d in docs}

    tagger = toxicity.fit(*toxicity.sample(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    score = dict(zip(text, (s for s, _ in tagger.tag([t or "" for t in text.values()]))))
    assert kept["toxicity"] == Counter(d[0] for d in docs if score[d[0]] < 0.5)
    wrong = [i for i, _, bad in labels if (i in kept["toxicity"]) == bool(bad)]
    assert len(wrong) <= 0.03 * len(labels)

    classes = plain_classes([(i, text[i]) for i in kept["toxicity"] if i is not None])
    by_id = Counter(set(classes.values()))
    # The two rows without an id: one is a copy of an identified row, the other stays.
    assert kept["near_dedup"] == by_id + Counter({None: 1})

    tree = decontaminate.Automaton([(str(i), t) for i, t in items])
    dirty = {i for i in kept["near_dedup"] if (f := tree.scan(text[i] or ""))[1] and 20 * len(f[1]) >= f[0]}
    assert dirty == {50_000} and 50_001 in kept["decontaminate"]
    assert kept["decontaminate"] == Counter({i: n for i, n in kept["near_dedup"].items() if i not in dirty})

    cleaned = spark.read.parquet(f"{tmp_path}/out/decontaminate")
    assert kept["mixing"] == Counter(r["doc_id"] for r in mixing.mix(cleaned).where("mix_kept").select("doc_id").collect())
    assert 0.5 < sum(kept["mixing"].values()) / sum(kept["decontaminate"].values()) < 0.95

    assert kept["sharding"] == kept["mixing"]
    for shard in now.select("shard").distinct().collect():
        slots = sorted(r["slot"] for r in now.where(now.shard == shard[0]).collect())
        assert slots == list(range(len(slots)))
    assert corpus_pipeline.run(spark, path).count() == now.count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    path = folder(
        tmp_path,
        spark,
        documents=frame(spark, []),
        labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id bigint, text string"),
    )
    assert corpus_pipeline.run(spark, path).count() == 0
