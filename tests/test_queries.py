"""Every registered query with a DuckDB counterpart has the same rows."""

import pytest

from corpusloom import plans
from tests.conftest import DATA
from tests.oracle import compare, connect

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, con, name):
    assert not compare(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


def test_every_query_has_rows(spark):
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        plans.queries()[name](spark, SF).limit(1).collect()
