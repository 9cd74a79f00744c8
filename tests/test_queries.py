"""Every registered query outside the training-data package against its SQL at the smallest size."""

import pytest
from oracle import DATA, connect, differences

from bulletin.plans import QUERIES, SQL

PATH = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, PATH), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, PATH).columns
