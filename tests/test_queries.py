"""Every query that SQL can express, against DuckDB on the smallest tables."""
import math
import os

import duckdb
import pytest

from turnloom import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=repr)
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    wanted = sorted((tuple(plain(x) for x in r) for r in con.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert found == wanted


#: Plain versions of the other queries are in test_plain.
def test_every_query_has_sql_or_a_plain_version():
    from . import test_plain

    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == set(test_plain.CHECKED)
