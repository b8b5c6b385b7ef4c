"""Every registered query against its SQL twin."""

import comparing
import pytest

import __spark_entry__ as entry_point

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return comparing.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert comparing.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r["avg_sent"], r["ticker"]))
