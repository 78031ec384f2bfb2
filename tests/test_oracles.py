"""Every registered query against its oracle SQL (small scale) or as a non-empty result."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from lanewise.plans import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    message, _, ok = compare(spark, con, name, sf)
    assert ok is not False and not message.startswith("rows 0"), message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["group_id", "n", "mean_distance", "k", "accepted", "accepted_structural"]


def test_oracle_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
