"""Registered queries of this subpackage that SQL can express, against their DuckDB twins."""
import pytest

from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_check import compare, duck
from visitlens.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name, sf):
    r = compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf, duck(sf))
    assert r["status"] == "match" and "types" not in r, r


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
