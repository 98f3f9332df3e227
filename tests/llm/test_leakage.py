import random
import re

import numpy as np

from docstrata.llm.leakage import INDEX_CHARS, ItemIndex, leaked_items

R = random.Random(4)
COMMON = [f"c{i}" for i in range(12)]
DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items, run=12):
    out = set()
    for i, t in items:
        w = re.findall(r"\w+", (t or "").lower())
        for d, x in docs:
            v = re.findall(r"\w+", (x or "").lower())
            runs = {tuple(v[k : k + run]) for k in range(len(v) - run + 1)}
            if any(tuple(w[k : k + run]) in runs for k in range(len(w) - run + 1)):
                out.add((d, i))
    return out


def made():
    items = [(n, " ".join(R.choice(COMMON) if R.random() < 0.6 else f"i{n}x{k}" for k in range(40))) for n in range(50)]
    items += [(900, items[0][1]), (901, "too short"), (902, None), (903, "")]
    docs = []
    for d in range(80):
        words = [R.choice(COMMON) if R.random() < 0.8 else f"d{d}y{k}" for k in range(200)]
        if d % 3 == 0:
            w = items[R.randrange(50)][1].split()
            at, n = R.randrange(28), R.choice([11, 12, 20])
            words[50:50] = w[at : at + n]
        docs.append((d, ",\n".join(words).upper() if d % 2 else " **".join(words)))
    return docs + [(500, None), (501, ""), (0, docs[0][1])], items


def test_leaks_equal_brute_force(spark):
    docs, items = made()
    documents = spark.createDataFrame([(*d, 1) for d in docs], DOCS)
    table = spark.createDataFrame([(*i, "clash") for i in items], ITEMS)
    want = brute(docs, items)
    assert want
    assert {tuple(r)[:2] for r in leaked_items(documents, table).collect()} == want
    # in several indexes too
    assert {tuple(r)[:2] for r in leaked_items(documents, table, index_chars=2_000).collect()} == want


def test_empty(spark):
    docs, items = made()
    assert leaked_items(spark.createDataFrame([], DOCS), spark.createDataFrame([(*i, "") for i in items], ITEMS)).count() == 0
    assert leaked_items(spark.createDataFrame([(*d, 1) for d in docs], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_retrieval_threshold_is_what_a_run_scores():
    items = [(1, "a b c d e f"), (2, "a a a a a a x")]
    index = ItemIndex.build(items, 3)
    assert set(index.leaks("zz a A a zz")) == {2}
    assert set(index.leaks("c d e")) == {1}
    assert index.leaks("a b") == {}


def test_question_and_passage_are_told_apart():
    item = "What is the limit of the pump? The pump takes at most five amps in spring."
    index = ItemIndex.build([(7, item)], 4)
    assert index.leaks("so what is the LIMIT then") == {7: 1}
    assert index.leaks("takes at most five") == {7: 2}
    assert index.leaks("of the pump the pump") == {7: 3}
    assert index.leaks(item) == {7: 3}


def test_skipping_loses_nothing():
    """Against scores of all items."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, weights=range(1, 61), k=r.randint(12, 60)))) for i in range(300)]
    index = ItemIndex.build(items, 5)
    for _ in range(300):
        w = items[r.randrange(300)][1].split()
        at = r.randrange(len(w) - 5)
        passage = np.array([index.terms[x] for x in (w[at : at + 5] if r.random() < 0.7 else r.choices(list(index.terms), k=5))])
        score = np.zeros(len(index.need))
        for t in passage:
            score[index.item[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        got = index.retrieved(np.stack([passage, passage[::-1]]))
        for row in (0, 1):
            assert set(got[1][got[0] == row].tolist()) == set(np.flatnonzero(score >= index.need).tolist())


def test_many_items_make_one_index():
    r = random.Random(2)
    items = [(i, " ".join(f"v{r.randrange(20_000)}" for _ in range(60))) for i in range(9_000)]
    index = ItemIndex.build(items, 12)
    words = items[77][1].split()
    assert set(index.leaks(" ".join(["x"] * 50 + words[5:20] + ["y"] * 50))) == {77}
    assert sum(len(t) for _, t in items) < INDEX_CHARS
