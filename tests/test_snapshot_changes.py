import random
from datetime import datetime, timedelta

from docstrata.operators.snapshot_changes import snapshot_changes

FILES = "snapshot_id string, path string, raw_hash string, loaded_at timestamp, source_id string, idx int"
SNAPSHOTS = "snapshot_id string, source_id string, created_at timestamp, last string"
T = datetime(2024, 1, 1)


def brute(files, snapshots):
    once = {}
    for s, src, at, _ in snapshots:
        if s is not None:
            once.setdefault(s, (src, at))
    listing = {}
    for s, p, h, at, *_ in sorted(files, key=lambda f: (f[3] or datetime.min, f[2] or "")):
        listing.setdefault(s, {})[p] = h
    out = set()
    for src in {v[0] for v in once.values()}:
        chain = [s for s, _ in sorted(((s, v[1]) for s, v in once.items() if v[0] == src), key=lambda x: (x[1], x[0]))]
        for before, now in zip(chain, chain[1:]):
            a, b = listing.get(before, {}), listing.get(now, {})
            out |= {(now, p, "added") for p in b.keys() - a.keys()} | {(now, p, "removed") for p in a.keys() - b.keys()}
            out |= {(now, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    snapshots, files = [], []
    for src in "xyz":
        for i in range(7):
            # ties in time, rows delivered twice, and a snapshot without files
            snapshots += [(f"{src}{i}", src, T + timedelta(hours=i // 2), "extra")] * r.choice([1, 1, 2])
            for p in range(12):
                if i != 3 and r.random() < 0.7:
                    row = (f"{src}{i}", f"p{p}", r.choice([None, "h1", "h2"]), T, "clash", 7)
                    files += [row] + ([(*row[:3], T + timedelta(days=2), "clash", 7)] if r.random() < 0.2 else [])
    files += [("unknown", "p1", "h", T, "x", 1), ("x1", None, "h", T, "x", 1)]
    got = snapshot_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(snapshots, SNAPSHOTS)).collect()
    assert len(got) == len(set(got))
    assert {tuple(g) for g in got} == brute([f for f in files if f[0] != "unknown"], snapshots)


def test_empty_tables(spark):
    none = spark.createDataFrame([], FILES)
    some = spark.createDataFrame([("a", "s", T, ""), ("b", "s", T, "")], SNAPSHOTS)
    assert snapshot_changes(none, some).count() == 0
    assert snapshot_changes(spark.createDataFrame([("a", "p", "h", T, "s", 1)], FILES), spark.createDataFrame([], SNAPSHOTS)).count() == 0


def test_everything_goes_and_comes_back(spark):
    snapshots = spark.createDataFrame([(s, "s", T + timedelta(hours=i), "") for i, s in enumerate("abc")], SNAPSHOTS)
    files = spark.createDataFrame([("a", "p", "h", T, "s", 1), ("c", "p", "h", T, "s", 1)], FILES)
    assert {tuple(r) for r in snapshot_changes(files, snapshots).collect()} == {("b", "p", "removed"), ("c", "p", "added")}
