"""Registered queries against their SQL on the smallest tables."""

import glob
import os
from functools import cache
from multiprocessing.pool import ThreadPool

import duckdb
import pytest

from check import _rows
from __spark_entry__ import entry, oracle_sql, queries
from topicdrift.catalog import ORACLE, QUERIES, models
from topicdrift.runtime import intermediate_tables

FOLDER = "/root/testdata/sf0.001"
SLOW = ("sweep_",)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def fitted_once():
    """Queries over the same model share one fit; it is made outside of the scope of the query that asks first."""
    with pytest.MonkeyPatch.context() as patch, ThreadPool(1) as outside:
        for name in ("_fitted", "_fitted_periods"):
            patch.setattr(models, name, cache(lambda spark, folder, real=getattr(models, name): outside.apply(real, (spark, folder))))
        yield


@pytest.mark.parametrize("name", [name for name in ORACLE if not name.startswith(SLOW)])
def test_equals_sql(spark, database, name):
    with intermediate_tables(spark):
        _compare(QUERIES[name](spark, FOLDER), database.execute(ORACLE[name]))


def _compare(frame, result):
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == _rows(names, result.fetchall())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[0] == "year" and frame.count() == 26


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
