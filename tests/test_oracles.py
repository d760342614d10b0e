"""Every registered query against its SQL on whole tables; those without SQL must run and return rows."""

import pytest

import check
from poolwise.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem, _, _, _ = check.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert not problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
