"""Every registered query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from codeloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(found, order):
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    q = duck.execute(ORACLES[name])
    columns = [d[0] for d in q.description]
    types = dict(zip(columns, [str(d[1]) for d in q.description], strict=True))
    assert sorted(df.columns) == sorted(columns)
    assert {k: TYPES.get(v, v) for k, v in df.dtypes} == types
    mine, theirs = ([c.index(x) for x in sorted(c)] for c in (df.columns, columns))
    assert rows(df.collect(), mine) == rows(q.fetchall(), theirs)
