"""The registered queries of this subpackage on the smallest test tables: columns, and each row once."""

import os
from pathlib import Path

import pytest

from docstrata.llm import queries as q

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
COLUMNS = {
    "p1_found": {"rel": "string", "rec_key": "string"},
    "p2_found": {"rel": "string", "rec_key": "string"},
    "p3_found": {"doc_id": "bigint"},
    "p4_found": {"rel": "string", "key_a": "string", "key_b": "string"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "pii_type": "string", "pii_text": "string"},
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    found = q.queries()[name](spark, str(DATA))
    rows = found.collect()
    assert rows
    if name in COLUMNS:
        assert dict(found.dtypes) == COLUMNS[name]
        assert len(rows) == len({tuple(r) for r in rows})
