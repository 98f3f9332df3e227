from datetime import datetime, timedelta

import pytest

from docstrata.operators import scope as sc
from docstrata.operators import versions as ve

T = datetime(2024, 1, 1)
SNAPSHOTS = "snapshot_id string, source_id string, created_at timestamp, complete boolean, errors array<string>"
FILE = "file_id string, logical_key string, raw_hash string, source_id string, path string"


def test_retention_of_42_snapshots(spark):
    snapshots = spark.createDataFrame([(f"s{i:02d}", "a", T + timedelta(hours=i), True, []) for i in range(42)], SNAPSHOTS)
    pinned = spark.createDataFrame([("s00",), ("s01",)], "snapshot_id string")
    kept = ve.retained(snapshots, 30, pinned)
    assert kept.count() == 32
    files = spark.createDataFrame([(f"s{i:02d}", f"k{i}") for i in range(42)], "snapshot_id string, parsed_key string")
    parsed = files.select("parsed_key")
    assert {r.parsed_key for r in ve.orphans(parsed, ve.pruned(files, kept)).collect()} == {f"k{i}" for i in range(2, 12)}


def test_aliases_of_kept_snapshots_are_kept(spark):
    snapshots = spark.createDataFrame([("new", "a", T, True, [])], SNAPSHOTS)
    aliases = spark.createDataFrame([("new", "x"), ("x", "y"), ("other", "z"), ("y", "new")], "a string, b string")
    assert {r[0] for r in ve.retained(snapshots, 1, aliases=aliases).collect()} == {"new", "x", "y"}


def test_alignment(spark):
    before = [("1", "same", "h", "s", "p"), ("2", "gone", "h", "s", "p"), ("3", "mod", "a", "s", "p"), ("4", "twice", "h", "s", "p"), ("5", "twice", "h", "s", "q"), ("6", "null", None, "s", "r")]
    after = [("a", "same", "h", "s", "p"), ("b", "mod", "b", "s", "p"), ("c", "twice", "h", "s", "p"), ("d", "new", "h", "s", "p"), ("e", "null", None, "s", "r")]
    got = {tuple(r) for r in ve.aligned(spark.createDataFrame(before, FILE), spark.createDataFrame(after, FILE)).collect()}
    assert got == {
        ("same", "1", "a", "unchanged"), ("gone", "2", None, "removed"), ("mod", "3", "b", "modified"), ("new", None, "d", "added"), ("null", "6", "e", "unchanged"),
        ("twice", "4", None, "ambiguous"), ("twice", "5", None, "ambiguous"), ("twice", None, "c", "ambiguous"),
    }
    none = spark.createDataFrame([], FILE)
    assert ve.aligned(none, none).count() == 0


def test_a_copy_inherits_the_key_of_its_original(spark):
    old = spark.createDataFrame([("1", "K", "h", "s", "a.md"), ("2", "L", "x", "s", "b.md"), ("3", "M", "x", "s", "c.md")], FILE)
    new = spark.createDataFrame([("4", None, "h", "s", "a.md"), ("5", None, "h", "s", "copy.md"), ("6", None, "x", "s", "d.md"), ("7", None, None, "s", "e.md")], FILE)
    got = {r.path: r.inherited_key for r in sc.inherited_keys(new, old).collect()}
    assert got == {"a.md": "K", "copy.md": "K", "d.md": "s:d.md", "e.md": "s:e.md"}


def test_first_rule_wins(spark):
    rules = spark.createDataFrame(
        [("d", "M2", 1, 0, None, "**", "spec"), ("d", "M1", 0, 1, "s2", "src/**", "code"), ("d", "M0", 0, 0, None, "src/*.c", None)],
        "project_id string, module_id string, module_ord int, rule_ord int, source_id string, pattern string, role string",
    )
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("s1", "src/a.c"), ("s2", "src/x/a.c"), ("s1", "src/x/a.c"), ("s1", None)], "source_id string, path string")
    got = [tuple(r) for r in rows.select(sc.first_rule(rules, F.col("path"), F.col("source_id")).alias("r")).select("r.module_id", "r.role").collect()]
    assert got == [("M0", None), ("M1", "code"), ("M2", "spec"), (None, None)]


def test_carried_forward_only_from_incomplete_snapshots(spark):
    schema = "snapshot_id string, source_id string, path string, raw_hash string"
    now = spark.createDataFrame([("n1", "a", "p", "h"), ("n2", "b", "p", "h")], schema)
    old = spark.createDataFrame([("o1", "a", "q", "h"), ("o1", "a", "p", "z"), ("o2", "b", "q", "h")], schema)
    snapshots = spark.createDataFrame([("n1", "a", T, False, ["x"]), ("n2", "b", T, True, [])], SNAPSHOTS)
    got = {(r.source_id, r.path, r.raw_hash) for r in ve.carried_forward(now, old, snapshots).collect()}
    assert got == {("a", "p", "h"), ("b", "p", "h"), ("a", "q", "h")}


@pytest.mark.parametrize(
    ("items", "state"),
    [
        ([("DMA is  supported", "present")], "supported"),
        ([("supported", "absent")], "absent"),
        ([("supported", "present"), ("DMA is", "absent")], "conflict"),
        ([("DMA", "present")], "unknown"),
        ([("not in the text", "present")], "unknown"),
        ([(None, "present")], "unknown"),
    ],
)
def test_evidence(spark, items, state):
    rows = [("v", "The DMA is\n supported.", q, s) for q, s in items]
    got = ve.evidence_states(spark.createDataFrame(rows, "version string, text string, quote string, support string"), ["version"])
    assert got.first().state == state


def test_signature_ignores_order(spark):
    schema = "snapshot_id string, path string, raw_hash string, logical_key string"
    rows = [("a", "p", "h", "k"), ("a", "q", None, "k"), ("b", "q", None, "k"), ("b", "p", "h", "k"), ("c", "p", "h2", "k"), ("c", "q", None, "k")]
    got = {r.snapshot_id: r.signature for r in ve.signatures(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_reuse_needs_equal_listings(spark):
    order = spark.createDataFrame([("s1", "a", 0), ("s2", "a", 1), ("s3", "a", 2), ("s4", "a", 3), ("t1", "b", 0), ("t2", "b", 1), ("t3", "b", 2)], "snapshot_id string, source_id string, idx int")
    rows = [(s, p, h, "k") for s, h in (("s1", "x"), ("s2", "x"), ("s3", None), ("s4", None)) for p in ("p", "q")] + [("t1", "p", "x", None), ("t2", "p", "x", "k")]
    files = spark.createDataFrame(rows, "snapshot_id string, path string, raw_hash string, logical_key string")
    assert {tuple(r) for r in ve.reusable(files, order).collect()} == {("s2", "s1"), ("s4", "s3")}
    assert {tuple(r) for r in ve.reusable(files.limit(0), order).collect()} == {("s2", "s1"), ("s3", "s2"), ("s4", "s3"), ("t2", "t1"), ("t3", "t2")}
    assert ve.reusable(files, order.limit(0)).count() == 0


def test_frozen_takes_the_latest_complete_snapshot(spark):
    rows = [("s1", "a", 1, True), ("s2", "a", 2, True), ("s2", "a", 2, False), ("s3", "a", 9, True), ("t1", "b", 5, True), (None, "c", 1, True)]
    snapshots = spark.createDataFrame(rows, "snapshot_id string, source_id string, t int, complete boolean").selectExpr("*", "timestamp_seconds(t) AS created_at")
    at = snapshots.selectExpr("timestamp_seconds(4) AS at").first()["at"]
    assert [tuple(r) for r in ve.frozen(snapshots, at).collect()] == [("a", "s1")]


def test_vector_changes_compare_contents(spark):
    schema = "file_id string, parsed_key string"
    old = spark.createDataFrame([("1", "k1"), ("2", "k2"), ("3", None)], schema)
    now = spark.createDataFrame([("9", "k1"), ("4", "k3"), ("5", "k3")], schema)
    chunks = spark.createDataFrame([("c1", "k1"), ("c2", "k2"), ("c3", "k3"), ("c4", "k4"), ("c5", None)], "chunk_id string, parsed_key string")
    assert {tuple(r) for r in ve.vector_changes(old, now, chunks).collect()} == {("c2", "delete"), ("c3", "upsert")}


def test_hunks_are_cited_by_their_chunks(spark):
    chunks = spark.createDataFrame([("k", "c0", 0, "a\nb"), ("k", "c1", 1, "c\nd"), ("k", "c2", 2, "e")], "parsed_key string, chunk_id string, ordinal int, text string")
    placed = ve.placed_chunks(chunks)
    assert [(r.chunk_id, r.first, r.last) for r in placed.orderBy("ordinal").collect()] == [("c0", 1, 2), ("c1", 3, 4), ("c2", 5, 5)]
    assert ve.joined_texts(chunks).first().text == "a\nb\nc\nd\ne"
    hunk = "struct<before_start:int,after_start:int,removed:array<string>,added:array<string>>"
    rows = [("touches two", "k", (2, 2, ["x"], ["b", "c"])), ("only deletes", "k", (5, 5, ["x"], [])), ("deletes at the start", "k", (1, 1, ["x"], [])), ("beyond", "k", (9, 9, [], ["z"])), ("no document", "none", (1, 1, [], ["z"]))]
    found = ve.cited_hunks(spark.createDataFrame(rows, f"id string, after_key string, h {hunk}"), placed)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.chunk_id)
    assert got == {"touches two": {"c0", "c1"}, "only deletes": {"c1"}, "deletes at the start": {"c0"}, "beyond": {"c0"}, "no document": {None}}


def test_scope_comes_before_double_delivery(spark):
    rows = [("f1", "s1", "spec", "p", 1), ("f1", "s1", "code", "p", 2), ("f2", "s2", "spec", "q", 1)]
    files = spark.createDataFrame(rows, "file_id string, snapshot_id string, role string, path string, t int").selectExpr("* EXCEPT (t)", "timestamp_seconds(t) AS loaded_at")
    scope = spark.createDataFrame([("s1",)], "snapshot_id string")
    assert [r.role for r in sc.files_of(files, scope).collect()] == ["code"]
    assert sc.files_of(files, scope, role="spec").count() == 0
