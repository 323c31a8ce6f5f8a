from __future__ import annotations

import pytest

from carryover.llm import queries as q

QUERIES = q.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_columns(spark, small):
    expected = {"p1_found": ["src", "id_a", "id_b"], "p4_found": ["src", "rec_key", "pii_kind", "start_pos"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos", "end_pos"]}
    for name, columns in expected.items():
        assert QUERIES[name](spark, small).columns == columns
