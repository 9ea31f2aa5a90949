"""Every query with an SQL twin gives the same rows; the rest run and return rows."""

import os

import pytest

import __spark_entry__ as entry
from harness import compare, duck

FOLDER = os.environ.get("TWIN_DIR", "/root/testdata/sf0.001")
# pools of one study and cities of one group leave these without a defined value at the smallest scale
WIDER = {"tau2_dl", "tau2_reml", "city_profile", "corr_pearson"}
WIDER_DIR = os.environ.get("TWIN_DIR", "/root/testdata/sf0.01")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, con, name):
    folder = WIDER_DIR if name in WIDER else FOLDER
    got = compare(entry.queries()[name](spark, folder), duck(folder) if name in WIDER else con, SQL[name])
    spark.catalog.clearCache()
    assert got in (None, "no rows")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SQL])
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.collect()
    spark.catalog.clearCache()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.converged for r in rows)
