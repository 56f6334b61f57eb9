"""The queries of this package run on the smallest tables."""

import pytest

from docsift.llm import queries as Q


@pytest.mark.parametrize("name", sorted(n for n in Q.QUERIES if n != "p5_search"))
def test_query(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    assert df.count() >= 0
    columns = {
        "p2_found": ["section_id_a", "section_id_b"], "p3_found": ["answer_id", "defect"], "p4_found": ["section_id"], "p5_found": ["section_id_a", "section_id_b"],
        "p6_found": ["section_id", "noise"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    if name in columns:
        assert df.columns == columns[name] and df.count() == df.distinct().count()
