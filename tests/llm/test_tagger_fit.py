"""The tagger is fitted in a task: no text of the sample comes to the driver."""

from __future__ import annotations

import numpy as np

from telespan.llm import toxicity
from tests.llm.fixture import frame, prose

LABELS = "doc_id bigint, quality int, toxic int"


def labelled_docs(spark, n=120):
    docs = [(i, prose(i, 60) + (" vilesnark grubfoul" if i % 2 else ""), "en", "s", 1, 1, 1, "x") for i in range(n)]
    return frame(spark, docs), spark.createDataFrame([(i, 1, i % 2) for i in range(n)], LABELS)


def test_fit_in_a_task_equals_the_plain_fit(spark, monkeypatch):
    docs, labels = labelled_docs(spark)
    plain = toxicity.fit(*toxicity.sample(docs, labels))

    def in_driver(*_):
        raise AssertionError("the sample was read or fitted in the driver")

    monkeypatch.setattr(toxicity, "sample", in_driver)
    monkeypatch.setattr(toxicity, "fit", in_driver)
    found = toxicity.learn(docs, labels)
    assert found.weights == plain.weights and list(found.weights) == list(plain.weights) and found.weights
    assert found.bias == plain.bias and np.array_equal(found.move, plain.move) and np.array_equal(found.heads, plain.heads)
    texts = [prose(7, 40), "vilesnark " + prose(8, 40), ""]
    assert found.tag(texts) == plain.tag(texts)


def test_one_class_gives_no_tagger(spark):
    docs, labels = labelled_docs(spark, 20)
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert toxicity.learn(docs, labels.limit(0)) is None
