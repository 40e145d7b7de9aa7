"""Every registered query against its DuckDB twin on the smallest fixture."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

NAMES = sorted(E.QUERIES | E.STREAM_QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL, con)
    assert r["status"] == "match", r
    assert "types" not in r, r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["area", "product_name", "clickcount", "city_remark"]
    assert df.count() > 0
