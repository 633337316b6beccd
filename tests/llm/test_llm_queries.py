"""The queries with SQL against it, on the smallest tables."""

import pytest
from oracle import assert_same, connection

from plumbline.llm.catalog import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    assert_same(queries()[name](spark, FOLDER), connection(FOLDER), oracle_sql()[name])


def test_names():
    assert {n.split("_")[0] for n in queries()} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
