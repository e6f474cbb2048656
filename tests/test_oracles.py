"""Every query with a SQL twin gives the same rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: The operators for training data have their own tests.
OWN = sorted(n for n in driver.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = driver.queries()[name](spark, sf_dir)
    assert difference(df, con, driver.oracle_sql()[name]) is None


def test_only_the_learnt_queries_lack_sql():
    lacking = set(driver.queries()) - set(driver.oracle_sql())
    learnt = {"predict_winner", "feature_importance", "projected_neighbours_recall"}
    assert {n for n in lacking if not n.startswith("op") and n != "pipeline"} == learnt
