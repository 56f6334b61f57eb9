"""Every named query runs on the smallest tables, and equals its SQL where there is one."""

import numbers
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from docsift.plans import registry

duckdb = pytest.importorskip("duckdb")


def _rows(pdf):
    import pandas as pd

    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, numbers.Number):
            return round(float(v), 6)
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v

    pdf = pdf[sorted(pdf.columns)]
    return sorted(str(tuple(map(norm, r))) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        con.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, db, name):
    got = registry.queries()[name](spark, small).toPandas()
    if name in registry.sql():
        want = db.sql(registry.sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["query_id", "section_id", "rank", "score"]


def test_core_stands_alone():
    """Nothing in the library needs the subpackage for training data."""
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['docsift.llm'] = None; import __spark_entry__ as e; n = set(e.queries()); assert 'doc_retrieval' in n and not any(x.startswith(('p2', 'p9')) for x in n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
