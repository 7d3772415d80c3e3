"""The registry, and the queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from crawlscan import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLES) and set(core.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = core.QUERIES[name](spark, SF)
    want = db.execute(core.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
