"""The plans of the core's queries: pruned scans, equality joins, no Python where it is not needed; and their results in SQL."""

import os

import pytest
from pyspark.sql import functions as F

from verdigris.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One-row tables are joined without keys here.
ONE_ROW = {"dashboard_header", "plan_json"}
#: What Spark has no function for: the Beta quantile, XML of any depth, source items.
PYTHON = {"diff_parse", "flaky_posterior_bounds", "flaky_posterior_mean", "junit_parse", "source_items", "source_aliases"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_needless_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ONE_ROW
    assert not any(x in plan for x in ("MapInPandas", "MapInArrow", "PythonUDF", "BatchEvalPython")) or name in PYTHON


def test_scans_are_pruned(spark):
    plan = _plan(QUERIES["flaky_wilson"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThan(c_acctbal,-900.0)" in _plan(spark.read.parquet(f"{SF}/customer.parquet").where("c_acctbal < -900").select("c_custkey"))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_the_ring_limits_rows_before_the_shuffle(spark):
    plan = _plan(QUERIES["history_recent50"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_in_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def rows(table):
        table = table.select(sorted(table.column_names))
        return sorted(map(repr, zip(*(c.to_pylist() for c in table.columns), strict=True)))

    want = con.sql(ORACLE_SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    got = QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_sources_of_a_table_read_by_one_task_are_parsed_by_many(spark):
    assert spark.read.parquet(f"{SF}/part.parquet").select(F.spark_partition_id()).distinct().count() == 1
    shares = [r["count"] for r in QUERIES["source_aliases"](spark, SF).groupBy(F.input_file_name()).count().collect()]
    assert sum(shares) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert len(shares) > 4 and max(shares) < sum(shares) / 4, "aliases found by each task"
