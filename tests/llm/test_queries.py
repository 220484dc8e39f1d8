"""Registered queries against their SQL, on tables with the hard cases added."""

import duckdb
import pytest
from conftest_llm import EDGES, prose

from check import _rows
from topicdrift.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory, make, spark):
    base = tmp_path_factory.mktemp("tables")
    distinct = {i: t for i, t in EDGES if i is not None and i != 9}  # SQL joins by the id
    rows = [*distinct.items(), (60, prose(4, 50)), (61, "x " + prose(4, 50) + "\n" + prose(5, 30)), (62, prose(5, 30) + ".")]
    make(rows).coalesce(1).write.parquet(f"{base}/documents.parquet")
    urls = ["http://a.Example.net/en/1", "http://b.org/fr/", "http://b.org/x?y", "nothing", None, "x://c.example.com/de/", "http://b.org/z"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(1).write.parquet(f"{base}/pages.parquet")
    labels = [(1, 0, 0), (2, 1, 1), (3, None, 1), (4, 1, 0), (4, 0, 0), (None, 0, 0), (6, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "One two X " + prose(4, 40)), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{base}/benchmark.parquet")
    return str(base)


@pytest.mark.parametrize("name", list(ORACLE))
@pytest.mark.parametrize("small", [True, False])
def test_equals_sql(spark, folder, name, small):
    base = "/root/testdata/sf0.001" if small else folder
    database = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        files = f"{base}/{table}.parquet" if small else f"{base}/{table}.parquet/*.parquet"
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    result = database.execute(ORACLE[name])
    frame, names = QUERIES[name](spark, base), [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert _rows(frame.columns, frame.collect()) == _rows(names, result.fetchall())
