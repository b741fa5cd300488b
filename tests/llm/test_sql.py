"""Queries of the training-data operators that SQL can express, on the smallest tables."""

import pytest

from golode.llm import registry
from tests.test_entry import SF, con, rows  # noqa: F401  con is a fixture


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):  # noqa: F811
    found = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
