"""The registered corpus queries against their SQL."""

import pytest

from entwine.llm import queries
from tests.sqlcheck import agrees, connect


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, sf, name):
    assert not agrees(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
