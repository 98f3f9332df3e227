import numpy as np
import pytest

from docstrata.functions import text as tx
from docstrata.operators import embedding as em
from pyspark.sql import functions as F


def test_equal_inputs_are_embedded_once(spark):
    rows = spark.createDataFrame([("t", "a b", 1), ("t", "a b", 2), (None, "c", 3), ("t", None, 4)], "title string, text string, vector int")
    got = em.embedded(rows).collect()
    assert len(got) == 2 and all(np.linalg.norm(r.vector) == pytest.approx(1) for r in got)


def test_long_inputs_are_cut():
    assert em.estimated_tokens(em.cut_to("x" * 30_000, em.estimated_tokens)) <= em.MOST_TOKENS
    assert em.cut_to("short", em.estimated_tokens) == "short"
    with pytest.raises(ValueError):
        em.cut_to("x" * 100, lambda t: 10**6)


def test_pending(spark):
    chunks = spark.createDataFrame([("1", "m"), ("2", "n"), ("3", "m")], "chunk_id string, membership string")
    state = spark.createDataFrame([("1", "A", "m"), ("2", "A", "m"), ("3", "B", "m")], "chunk_id string, model string, membership string")
    assert {r.chunk_id for r in em.pending(chunks, state, "A").collect()} == {"2", "3"}


def test_labels_and_versions(spark):
    row = spark.range(1).select(
        tx.mention_place(F.lit("compare V10 with v1"), "v1").alias("a"),
        tx.mention_place(F.lit("only v10"), "v1").alias("b"),
        tx.version_names(F.lit("v1, v10.2-rc1 and xv3")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (18, 0, ["v1", "v10.2-rc1"])
