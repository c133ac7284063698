"""Every query that SQL can express against DuckDB, over the small tables."""

import math
import os

import duckdb
import pytest

from orevein.plans import queries

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{float(x):.10g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def _rows(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(_plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    ours = queries.QUERIES[name](spark, DATA)
    theirs = duck.sql(queries.ORACLE_SQL[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in ours.dtypes} == kinds
    assert _rows([tuple(r) for r in ours.collect()], ours.columns, order) == _rows(theirs.fetchall(), theirs.columns, order)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
