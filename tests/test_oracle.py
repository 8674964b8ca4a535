"""Every registered query against its DuckDB oracle (sf0.001)."""
import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from conftest import SF_SMALL

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SF_SMALL, con)
    assert ok, msg


def test_every_sql_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 14
    assert df.columns == ["label", "positives", "label_idx"]
