"""The driver's contract: names agree, and queries equal their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from golode.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fit = lambda v: float(f"{v:.9g}") if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted((tuple(fit(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, con, name):
    found = core.QUERIES[name](spark, SF)
    cursor = con.execute(core.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want)
