import random

import pytest

from docstrata.operators import asked as ak
from docstrata.operators import search as se

WORDS = "clock clockwork flash bank uart reset controller spi bus timer watchdog".split()


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(WORDS, k=3)), " ".join(r.choices(WORDS, k=r.randint(1, 30)))) for i in range(200)]
    rows += [(900, None, "clock"), (901, "clock", None), (902, None, None), (903, "", ""), (904, "Clock Écran", "clock"), (905, "clock ecran", "clock")]
    return spark.createDataFrame(rows, "chunk_id long, title string, text string").repartition(3)


ASKED = {1: "Clock uart", 2: "w b", 3: "", 4: None, 5: "nothing there", 6: "clo clock clockwork", 7: "écran"}


def test_all_hits_equal_single_questions(chunks, spark, monkeypatch):
    monkeypatch.setattr(ak, "SENT", 50)
    monkeypatch.setattr(ak, "BLOCK", 3)
    questions = spark.createDataFrame(list(ASKED.items()), "query long, text string")
    got = {(r.query, r.chunk_id): r.score for r in ak.Asked(chunks, questions).hits().collect()}
    want = {(q, r.chunk_id): r.score for q, t in ASKED.items() for r in se.bm25(chunks, (t or "").split()).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_best_equal_the_first_of_all_hits(chunks, spark, monkeypatch):
    monkeypatch.setattr(ak, "BLOCK", 2)
    questions = spark.createDataFrame(list(ASKED.items()), "query long, text string")
    asked = ak.Asked(chunks, questions)
    want = {(r.query, r.chunk_id, r["rank"]) for r in se.best(asked.hits(), 7, "chunk_id").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        assert {(r.query, r.chunk_id, r["rank"]) for r in asked.best(7, "chunk_id").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_go_by_the_order_given_of_joined_rows(chunks, spark):
    asked = ak.Asked(chunks.where("chunk_id > 903"), spark.createDataFrame([("q", "ecran")], "query string, text string"))
    places = asked.rows.crossJoin(spark.createDataFrame([("b",), ("a",), ("c",)], "path string"))
    assert [(r.path, r.chunk_id) for r in asked.best(3, "path", "chunk_id", rows=places).orderBy("rank").collect()] == [("a", 904), ("a", 905), ("b", 904)]


def test_no_questions_and_no_chunks(chunks, spark):
    questions = spark.createDataFrame([(1, "clock")], "query long, text string")
    for c, q in ((chunks.limit(0), questions), (chunks, questions.limit(0)), (chunks, questions.selectExpr("query", "'' AS text"))):
        assert ak.Asked(c, q).hits().count() == ak.Asked(c, q).best(3, "chunk_id").count() == 0


def test_hits_are_not_shuffled(chunks, spark):
    """Shuffled hits of all questions outgrow the disk."""
    plan = ak.Asked(chunks, spark.createDataFrame([(1, "clock")], "query long, text string")).hits()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", "bm25_all_hits bm25_topk rrf_hybrid bm25_scoped_topk prompt_context".split())
def test_tables_of_questions_need_no_index(spark, name, tmp_path, monkeypatch):
    """Writing postings and joining them with all questions outgrows disk and the driver."""
    from docstrata.plans import registry

    monkeypatch.setattr(se, "write_index", lambda *a: pytest.fail("an index is written"))
    chunks = [("a", "p", 0, "clock", "clock bank"), ("b", "p", 1, None, "clock")]
    spark.createDataFrame(chunks, "chunk_id string, parsed_key string, ordinal int, title string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(20, "Clock", "clock"), (21, "bank", "clock")], "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, [1.0], 3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in ("kb_files", "snapshots"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert (registry.queries()[name](spark, str(tmp_path)).count() > 0) == (name != "bm25_scoped_topk")
