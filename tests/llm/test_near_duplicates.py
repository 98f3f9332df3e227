import itertools
import random
import re
import time

import pytest

from docstrata.llm import near_duplicates as nd


def grams(text, like):
    words = re.findall(r"\w+", text.lower())
    if like.unit == "char":
        joined = f" {' '.join(words)} " if words else ""
        return {joined[i : i + like.length] for i in range(len(joined) - like.length + 1)}
    return set(zip(*[words[i:] for i in range(like.length)]))


def brute(rows, like):
    rows = [(k, t) for k, t in rows if t is not None]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        x, y = grams(s, like), grams(t, like)
        same = re.findall(r"\w+", s.lower()) == re.findall(r"\w+", t.lower())
        if same or x and y and len(x & y) / len(x | y) >= like.threshold:
            parent[root(a)] = root(b)
    groups = {}
    for k, _ in rows:
        groups.setdefault(root(k), set()).add(k)
    return {frozenset(g) for g in groups.values()}


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        words = r.choices(vocabulary, k=60)
        for v in range(r.choice([1, 2, 4])):
            edited = [r.choice(vocabulary) if r.random() < 0.03 else w for w in words]
            rows.append((f"{g}-{v}", " ".join(edited)))
    rows += [("same1", "Equal, text of some length here"), ("same2", "equal TEXT of some length here!"), ("short1", "ab"), ("short2", "AB."), ("short3", "cd")]
    return rows + [("null", None), ("empty1", ""), ("empty2", " . ")]


@pytest.mark.parametrize("like", [nd.Likeness("word", 3, 0.6, rows=4), nd.Likeness("char", 3, 0.6, rows=6), nd.Likeness()])
def test_groups_equal_brute_force(spark, like):
    rows = made(1)
    got = nd.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, text string, node int, band string"), like).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute(rows, like)
    assert len(got) == len([1 for _, t in rows if t is not None])


def test_large_buckets_are_completed(spark, monkeypatch):
    monkeypatch.setattr(nd, "LARGE_BUCKET", 3)
    rows = made(2)
    like = nd.Likeness("word", 3, 0.6, rows=1)
    found = nd.near_duplicates(spark.createDataFrame(rows, "id string, text string"), like).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.group, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute(rows, like)


def test_many_unlike_texts_in_one_bucket(spark):
    """20,000 texts that share a passage, so that they meet in many buckets, but are unlike; and a few that are alike."""
    r = random.Random(6)
    common = " ".join(f"c{i}" for i in range(14))
    rows = [(f"u{i}", f"{common} " + " ".join(f"x{r.randrange(10**6)}" for _ in range(16))) for i in range(20_000)]
    rows += [(f"d{i}", f"{rows[i * 100][1]} y{i}") for i in range(5)]
    like = nd.Likeness("word", 3, 0.6, rows=2, name="hot")
    started = time.time()
    found = nd.near_duplicates(spark.createDataFrame(rows, "id string, text string").repartition(8), like)
    groups = {}
    for x in found.collect():
        groups.setdefault(x.group, set()).add(x.id)
    assert sorted(g for g in map(sorted, groups.values()) if len(g) > 1) == sorted([f"d{i}", f"u{i * 100}"] for i in range(5))
    assert time.time() - started < 240


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.group for r in nd.components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "id string, text string"), nd.Likeness()).count() == 0


def test_bands_reach_the_recall():
    for like in (nd.Likeness("word", 3, 0.6, rows=4), nd.Likeness()):
        assert 1 - (1 - like.threshold**like.rows) ** like.bands >= like.recall
