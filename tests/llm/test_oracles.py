"""Queries of this subpackage that SQL can express have its rows."""

import pytest

from corpusloom.llm import registry
from tests.conftest import DATA
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    assert not compare(registry.queries()[name](spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), registry.oracle_sql()[name])
