"""Every registered query against its DuckDB oracle at sf0.001, and plan checks for scale."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

SQL = E.oracle_sql()
NO_SQL = sorted(set(E.queries()) - set(SQL))
# their plans are looked at where they are tested
SLOW = {n for n in E.queries() if n.startswith("op") or n == "pipeline" or n.startswith("fit_")}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], SQL[name], SF_SMALL)
    assert r["ok"], r


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns and df.count() > 0


def _children(node):
    """Children of a physical plan node, through adaptive wrappers and query stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _single_partition_faults(node) -> list[str]:
    """Exchanges to one partition that move anything but the result of an aggregate."""
    found = []
    if node.getClass().getSimpleName() == "ShuffleExchangeExec" and \
            node.outputPartitioning().getClass().getSimpleName().startswith("SinglePartition"):
        below = node
        while True:
            kids = _children(below)
            below = kids[0] if kids else None
            if below is None or below.nodeName().split(" ")[0] not in (
                    "Project", "WholeStageCodegen", "InputAdapter", "AQEShuffleRead", "Exchange", "ShuffleQueryStage",
                    "Filter", "LocalLimit", "ColumnarToRow"):
                break
        if below is None or "Aggregate" not in below.nodeName():
            found.append(node.toString()[:300])
    for kid in _children(node):
        found += _single_partition_faults(kid)
    return found


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_no_rows_meet_in_one_partition(spark, name):
    """Only results of aggregates (per-partition counts, totals) may be moved to a single partition."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan()
    assert _single_partition_faults(plan) == []


def test_the_plan_walk_sees_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(100).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert _single_partition_faults(df._jdf.queryExecution().executedPlan())


def test_column_pruning_reaches_scan(spark):
    df = E.queries()["label_threshold"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan or "p_name" not in plan
