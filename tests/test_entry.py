import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_flagship_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["words_in_cells", "lexical_topk", "iou_pairs"])
def test_plans_make_no_products(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
