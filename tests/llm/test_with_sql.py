"""Queries that SQL can express, against their SQL."""
import pytest

from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
