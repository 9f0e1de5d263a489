"""Every query runs on the smallest tables and agrees with its SQL, compared as the driver does."""

from __future__ import annotations

import glob
import os
from importlib import import_module

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of

FOLDER = "/root/testdata/sf0.001"
CORE = {name for module in entry._MODULES if module.startswith("skein.plans.") for name in import_module(module).QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for p in glob.glob(os.path.join(os.path.dirname(entry.__file__), "skein", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            with open(p) as f:
                assert "skein.llm" not in f.read(), p


def test_entry(spark):
    assert entry.entry(spark).count() > 0
