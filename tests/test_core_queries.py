"""Every core query against its SQL on the smallest tables, and the registry's contract."""

import os
import subprocess
import sys

import pytest

from tests.oracle import connect, same
from tracelode.plans import core

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, name):
    same(core.QUERIES[name](spark, DATA), connect(DATA), core.SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, name):
    df = core.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(core.SQL) <= set(core.QUERIES)


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['tracelode.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith(('p1_', 'p3_', 'p8_')) for k in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
