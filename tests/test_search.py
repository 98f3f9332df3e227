import random
import re
import sqlite3

import pytest

from docstrata.operators import search as se

WORDS = "clock clockwork flash bank uart reset controller spi bus timer watchdog".split()


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS, k=3)), " ".join(r.choices(WORDS, k=r.randint(1, 30)))) for i in range(200)]
    rows += [(900, None, "clock"), (901, "clock", None), (902, None, None), (903, "", "")]
    return rows, spark.createDataFrame(rows, "chunk_id long, title string, text string")


def fts(rows, words):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, text, tokenize=\"unicode61 tokenchars '_'\")")
    db.executemany("INSERT INTO f(rowid, title, text) VALUES (?, ?, ?)", [(i, t or "", x or "") for i, t, x in rows])
    match = " OR ".join(f'"{w}"*' for w in words)
    return {i: -s for i, s in db.execute("SELECT rowid, bm25(f, 3, 1) FROM f WHERE f MATCH ?", (match,))}


def test_bm25_equals_full_text_search_of_sqlite(chunks):
    rows, table = chunks
    words = ["clo", "uart", "absent"]
    got = {r.chunk_id: r.score for r in se.bm25(table, words).collect()}
    want = fts(rows, words)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_no_words_no_chunks(chunks, spark):
    assert se.bm25(chunks[1], []).count() == 0
    assert se.bm25(chunks[1].limit(0), ["clock"]).count() == 0


def test_written_index_gives_the_same(chunks, spark, tmp_path):
    asked = {"a": ["clock"], "b": ["Flash", "b"], "c": ["nothing"]}
    se.write_index(chunks[1], str(tmp_path))
    found = {(r.query, r.chunk_id): r.score for r in se.search_index(spark, str(tmp_path), asked).collect()}
    want = {(r.query, r.chunk_id): r.score for r in se.bm25_many(chunks[1], asked).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_prefix_search_filters_the_scan(chunks, spark, tmp_path):
    se.write_postings(chunks[1], str(tmp_path))
    from pyspark.sql import functions as F

    plan = spark.read.parquet(str(tmp_path)).where(F.col("term").startswith("clo"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(term,clo\)", plan)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.vec_id for r in se.vector_hits(table, [2.0, 1.0], 3).collect()] == [1, 2, 3]


def test_vector_answers_equal_single_questions(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(3)]) for i in range(60)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = table.where("vec_id % 10 = 0 OR vec_id > 89").selectExpr("vec_id AS query", "embedding")
    got = {}
    for row in se.vector_answers(table, asked, 7, block=4).collect():
        got.setdefault(row.query, {})[row["rank"]] = row.vec_id
    want = {i: [h.vec_id for h in se.vector_hits(table, v, 7).collect()] for i, v in rows if v and any(v) and (i % 10 == 0 or i > 89)}
    assert {q: [ids[n] for n in sorted(ids)] for q, ids in got.items()} == want
    assert se.vector_answers(table.limit(0), asked, 3).count() == se.vector_answers(table, asked.limit(0), 3).count() == 0


def test_answers_equal_single_questions(chunks, spark, tmp_path):
    asked = {1: "Clock uart", 2: "w b", 3: "", 4: None, 5: "nothing there", 6: "clo clock clockwork"}
    se.write_index(chunks[1], str(tmp_path))
    questions = spark.createDataFrame(list(asked.items()), "query long, text string")
    got = {(r.query, r.chunk_id): r.score for r in se.answers(spark, str(tmp_path), questions).collect()}
    want = {(q, r.chunk_id): r.score for q, t in asked.items() for r in se.bm25(chunks[1], (t or "").split()).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert se.answers(spark, str(tmp_path), questions.limit(0)).count() == 0


def test_an_empty_index_answers_nothing(chunks, spark, tmp_path):
    se.write_index(chunks[1].limit(0), str(tmp_path))
    questions = spark.createDataFrame([(1, "clock")], "query long, text string")
    assert se.answers(spark, str(tmp_path), questions).count() == se.search_index(spark, str(tmp_path), {"a": ["clock"]}).count() == 0


def test_index_is_written_once_and_again_for_changed_files(chunks, spark, tmp_path):
    chunks[1].limit(3).write.parquet(str(tmp_path / "t"))
    table = lambda: spark.read.parquet(str(tmp_path / "t")).select("chunk_id", "title", "text")
    first = se.index_of(table(), "t")
    assert se.index_of(table(), "t") == first
    chunks[1].limit(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert se.index_of(table(), "t") != first


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query int, k string, rank int")
    got = se.fuse(a, b, "k").orderBy("place").collect()
    assert [r.k for r in got] == ["y", "x", "z"]
    assert got[0].channels == ["keyword", "vector"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.k for r in se.fuse(a, b.limit(0), "k").orderBy("place").collect()] == ["x", "y"]


def test_context_skips_what_does_not_fit(spark):
    rows = [(7, *r) for r in [("d1", 1, 1000), ("d1", 2, 1000), ("d1", 3, 10), ("d2", 4, 1500), ("d3", 5, 800), ("d4", 6, 50), ("d5", 7, 50), ("d6", 8, 1)]]
    hits = spark.createDataFrame(rows, "query int, document string, rank int, tokens long")
    assert sorted(r["rank"] for r in se.context(hits).collect()) == [1, 2, 5, 6, 7]
    assert se.context(hits.limit(0)).count() == 0
