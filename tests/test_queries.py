"""Every registered query of the core against its SQL, on the smallest test tables."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

from docstrata.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = Counter(tuple(map(plain, r)) for r in found.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
