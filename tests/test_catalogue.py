"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


JVM_ONLY = ("path_p0", "path_p1", "path_p2", "path_p3", "path_p4", "path_p5", "path_outcomes", "outcome_summary", "oracle_policy", "threshold_table", "kappa", "fold_assignment", "contract_violations", "fingerprint", "blinded_payload")


@pytest.mark.parametrize("name", JVM_ONLY)
def test_plans_stay_in_the_jvm_and_multiply_nothing(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


def test_top_k_limits_groups_before_the_exchange(spark):
    plan = entry.queries()["path_p0"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["path_p0"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(question_id)" in plan and "ingested_at" not in plan
