"""Stages keep input columns that have the names of their own ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telespan.llm import decontaminate, mixing, toxicity
from tests.llm.fixture import frame, prose

NAMES = ["n_words", "items", "spans", "hit_words", "n_hit", "scan_0", "contaminated", "toxicity", "share", "document", "tokens", "p"]


@pytest.mark.parametrize("stage", ["decontaminate", "toxicity", "mixing"])
def test_own_names_in_the_input_survive(spark, stage):
    docs = frame(spark).withColumns({n: F.lit(f"kept {n}") for n in NAMES})
    if stage == "decontaminate":
        out = decontaminate.clean(docs, spark.createDataFrame([(1, prose(4, 80))], "item_id bigint, text string"))
    elif stage == "toxicity":
        out = toxicity.clean(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    else:
        out = mixing.sample(docs)
    assert out.columns == docs.columns
    found = out.select(*NAMES).distinct().collect()
    assert len(found) == 1 and all(found[0][n] == f"kept {n}" for n in NAMES)
