"""Training-data queries against DuckDB, where SQL expresses them."""

import pytest

SF01 = "/root/testdata/sf0.01"
from courier.llm.queries import ORACLE, QUERIES
from oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), ORACLE[name], con)
    assert ok, msg
