"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import assert_same, connection

from plumbline.plans.catalog import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    if name in oracle_sql():
        assert_same(df, duck, oracle_sql()[name])
    else:
        assert df.count() > 0


def test_all_operators_have_a_query():
    spans = {"src": 14, "val": 16, "sel": 12, "jn": 12, "agg": 35, "bst": 12, "win": 10, "srt": 7, "set": 5, "fn": 30, "ana": 16, "cov": 7, "evt": 8}
    want = {f"{k}{i:02d}" for k, n in spans.items() for i in range(1, n + 1)}
    assert want <= set(queries())
