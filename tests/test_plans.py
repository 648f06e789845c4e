"""Plan shape of every registered query: no Cartesian / nested-loop joins, Python only
where it is declared, and column-pruned scans."""

import re

import pytest

import __spark_entry__ as E
from armature.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL

# queries whose plans legitimately run Python: report number formatting
PYTHON_OK = {"report_rows", "p_value_rows"}
PY_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_shape(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name
    has_py = any(n in plan for n in PY_NODES)
    assert has_py == (name in PYTHON_OK), f"{name}: python in plan = {has_py}"


def test_scans_are_pruned(spark):
    df = E.queries()["mmap_condition_means"](spark, SF_SMALL)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    schemas = re.findall(r"ReadSchema: struct<([^>\n]*)>", plan)
    # lineitem has 11 columns; the flagship reads the 6 it needs
    lineitem = [s for s in schemas if "l_partkey" in s]
    assert lineitem and all(len(s.split(",")) <= 6 for s in lineitem), schemas
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", [n for n in sorted(REGISTRY) if "holm" in n or n in ("mixed_lm_pairs", "chi2_tests", "kruskal_tests")])
def test_corrections_never_gather_in_one_partition(spark, name):
    assert "SinglePartition" not in _plan(E.queries()[name](spark, SF_SMALL)), name
