"""Every registered query runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, canonical

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    sql = oracle_sql().get(name)
    if sql is None:
        return
    rel = db.sql(sql)
    assert cols == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert canonical(got) == canonical(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
def test_entry(spark):
    assert entry(spark).count() > 0
