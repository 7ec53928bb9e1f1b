"""What the plans of all queries must not hold, and the same results when keys are hot."""

import re

import pytest

import __spark_entry__  # noqa: F401  (it registers the queries)
from closebook.functions import skew
from closebook.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

# Queries that look along a key that may have a long history.
CUT = ["q_cdc_history", "q_run_timeline"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "migration" not in n))
def test_plan(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert node not in plan


def test_aging_reads_few_columns(spark, folder):
    plan = plan_of(QUERIES["q_ap_aging"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all("o_orderpriority" not in s for s in orders)
    # The invoices are grouped once, without a second shuffle for the buckets.
    assert plan.count("hashpartitioning(org_id") == 1


@pytest.mark.parametrize("name", CUT)
def test_long_histories_give_the_same_rows(spark, folder, name, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    rows, problems = compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name])
    assert not problems
