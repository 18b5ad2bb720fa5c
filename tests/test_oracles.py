"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import os

import duckdb
import pytest

from tessella import method_queries  # noqa: F401
from tessella.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for f in os.listdir(sf_small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_small}/{f}'")
    return c


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(name, spark, con, sf_small):
    df = QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
