"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from washframe.plans.catalog import ORACLE, QUERIES

from conftest import SF_SMALL
from oracle_harness import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sql = ORACLE.get(name)
    if name == "file_manifest":   # the oracle names one scale factor's folder
        sql = sql.replace("/root/testdata/sf0.01", SF_SMALL)
    res = compare(spark, con, name, QUERIES[name], sql, SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
