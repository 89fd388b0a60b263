"""The training-data queries against their SQL, and the columns that are fixed for them."""

import os

import pytest

from tests.oracle import connect, same
from tracelode.llm import plans

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["example_id", "defect"], "p2_found": ["task_id", "label"], "p3_found": ["example_id_a", "example_id_b"], "p4_found": ["example_id_a", "example_id_b"],
    "p5_found": ["example_id", "group_id"], "p7_found": ["session_id", "defect"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id_a", "doc_id_b"],
}
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(plans.queries()[name](spark, DATA), connect(DATA), plans.oracle_sql()[name]) > 0


@needs_data
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_runs(spark, name):
    df = plans.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
