"""Queries that SQL can say, against it; the others on a small table give rows."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from lanewise.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    message, _, ok = compare(spark, connect(sf), name, sf)
    assert ok is not False and (ok or name not in ORACLES) and not message.startswith("rows 0"), message


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and "pipeline" in entry.queries()
