"""Every registered query against its SQL, and the contract of the entry points."""

import pytest

import __spark_entry__ as entry
from almanac.plans.queries import ORACLE, QUERIES
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF) as connection:
        yield connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["ticker", "name", "sector"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF)
    assert verdict == "ok"


@pytest.mark.parametrize("name", ["pit_latest", "annual_values", "crossref_flags"])
def test_selections_do_not_shuffle_the_facts(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    reference = QUERIES["reference_values"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == (reference.count("Exchange hash") if name == "crossref_flags" else 0)
