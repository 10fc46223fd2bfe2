"""Every registered query returns what its SQL returns."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The text operators' queries run in tests/llm.
OWN = {k: q for k, q in entry.queries().items() if not re.match(r"op\d+_", k) and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([repr(round(r[k], 9) + 0.0) if isinstance(r[k], float) else repr(r[k]) for k in order] for r in found)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    want = rows(found.fetchall(), [c[0] for c in found.description])
    assert sorted(df.columns) == sorted(c[0] for c in found.description)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
