"""The registered corpus queries against DuckDB on the smallest data."""

import oracle
import pytest

from opslens.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.duck_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, duck, name):
    assert oracle.compare(spark, duck, FOLDER, name, queries.queries()[name], queries.oracle_sql()[name]) == []


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
