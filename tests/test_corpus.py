from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from topicdrift.operators import corpus
from topicdrift.runtime import broadcast_if_small, intermediate_tables, shared_folder, size_in_bytes, stored
from topicdrift.sources import pages

PAGE = '<?xml version="1.0"?><api batchcomplete=""><query><pages>{}</pages></query></api>'


@pytest.fixture()
def folder(tmp_path):
    files = {
        "A/revisions_2003.xml": '<page _idx="1" pageid="1" ns="0" title="A"><revisions>'
        '<rev timestamp="2003-12-31T23:30:00Z"> text {{x}} &lt;b&gt;\nline </rev></revisions></page>',
        "A/revisions_2004.xml": '<page _idx="1" pageid="1" ns="0" title="A"><revisions>'
        '<rev timestamp="2004-01-01T00:00:00Z">two</rev><rev timestamp="bad">three</rev></revisions></page>',
        "B/revisions_2003.xml": '<page _idx="2" pageid="2" ns="0" title="B" />',
        "C/revisions_2003.xml": '<page _idx="3" pageid="3" ns="0" title="C"><revisions><rev timestamp="2003-01-01T00:00:00Z"></rev></revisions></page>',
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(PAGE.format(body))
    return tmp_path


def test_pages_with_none_one_and_two_revisions(spark, folder):
    read = pages.read_pages(spark, f"{folder}/*/*.xml")
    assert {(row["_title"], row["_pageid"], row["__idx"]) for row in read.collect()} == {("A", 1, 1), ("B", 2, 2), ("C", 3, 3)}
    rows = sorted(tuple(row) for row in pages.revisions(read).fillna("?").collect())
    assert rows[:3] == [
        ("A", "2003-12-31T23:30:00Z", " text {{x}} <b>\nline "),
        ("A", "2004-01-01T00:00:00Z", "two"),
        ("A", "bad", "three"),
    ]
    assert rows[3] == ("B", "?", "?") and rows[4][0] == "C"


def test_one_broken_page_is_listed_and_all_others_are_read(spark, tmp_path):
    body = (
        '<page _idx="1" title="A"><revisions><rev timestamp="2003-01-01T00:00:00Z">one</rev></revisions></page>'
        '<page _idx="2" title="B"><revisions><rev timestamp="x">two</revisions></page>'
        '<page _idx="3" title="C"><revisions><rev timestamp="x">three</rev></revisions>'
        '<page _idx="4" title="D" /><page\n_idx="5" title="E"></page><page _idx="6" title="F"><revisions>'
    )
    (tmp_path / "one.xml").write_text("\n" + PAGE.format(body))
    (tmp_path / "two.xml").write_text(PAGE.format('<page _idx="7" title="G"/>'))
    read = pages.read_pages(spark, f"{tmp_path}/*.xml", lineage=True)
    assert {(row["_title"], row[pages.FILE].rsplit("/", 1)[-1]) for row in read.collect()} == {
        ("A", "one.xml"), ("D", "one.xml"), ("E", "one.xml"), ("G", "two.xml")}
    assert pages.revisions(read).columns == ["title", "timestamp", "content", pages.FILE]
    bad = pages.bad_pages(spark, f"{tmp_path}/*.xml").collect()
    assert sorted(row["record"].split('"')[3] for row in bad) == ["B", "C", "F"]
    assert all(row["file"].endswith("one.xml") and row["block_start"] == 0 for row in bad)


def test_small_splits_read_the_same(spark, folder):
    whole = sorted(map(str, pages.revisions(pages.read_pages(spark, f"{folder}/*/*.xml")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40)
    try:
        assert sorted(map(str, pages.revisions(pages.read_pages(spark, f"{folder}/*/*.xml")).collect())) == whole
        assert pages.bad_pages(spark, f"{folder}/*/*.xml").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_years_are_utc_and_bad_dates_null(spark, folder):
    rows = corpus.with_year(corpus.nonempty(pages.revisions(pages.read_pages(spark, f"{folder}/*/*.xml"))))
    found = {(row["content"].strip(), row["timestamp"], row["year"]) for row in rows.collect()}
    assert ("two", datetime(2004, 1, 1), 2004) in found and ("three", None, None) in found
    assert {year for _, _, year in found} == {2003, 2004, None} and len(found) == 3


def test_subset_counts_repeated_titles_once(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "title string")
    titles = spark.createDataFrame([("a",), ("a",), ("z",)], "title string")
    assert pages.subset(rows, titles).count() == 2
    assert pages.subset(rows, ["b", "b"]).count() == 1
    assert len(set(pages.SAMPLE_TITLES)) == 11


def test_ingest_prunes_years(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2003), ("b", 2004), ("c", 2004)], "content string, year int")
    pages.ingest(rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("year = 2004").count() == 2
    assert (tmp_path / "out" / "year=2003").exists()


def test_one_year_again_keeps_the_others(spark, tmp_path):
    path = f"{tmp_path}/out"
    pages.ingest(spark.createDataFrame([("a", 2003), ("b", 2004), ("c", 2005)], "content string, year int"), path)
    pages.ingest(spark.createDataFrame([("d", 2004), ("e", 2004)], "content string, year int"), path, given_years_only=True)
    assert sorted((row["content"], row["year"]) for row in spark.read.parquet(path).collect()) == [("a", 2003), ("c", 2005), ("d", 2004), ("e", 2004)]
    pages.ingest(spark.createDataFrame([("f", 2006)], "content string, year int"), path)
    assert [(row["content"], row["year"]) for row in spark.read.parquet(path).collect()] == [("f", 2006)]


def test_period_edges(spark):
    rows = spark.createDataFrame([(year,) for year in (2000, 2001, 2005, 2006, 2011, 2012, 2018, 2019, 2024, 2025, None)], "year int")
    found = [row["period"] for row in corpus.with_period(rows).orderBy(F.col("year").asc_nulls_last()).collect()]
    assert found == [None, "2001-2005", "2001-2005", "2006-2011", "2006-2011", "2012-2018", "2012-2018", "2019-2024", "2019-2024", None, None]


ROWS = [(i, "hot" if i % 3 else f"t{i % 7}", "p" if i % 5 else None, datetime(2001, 1, 1 + i % 4), None if i % 11 == 0 else f"text{i} " * (i % 6)) for i in range(200)]
SCHEMA = "doc_id int, title string, period string, timestamp timestamp_ntz, content string"


def joined():
    groups = {}
    for doc_id, title, period, stamp, content in sorted(ROWS, key=lambda row: (row[3], row[0])):
        texts = groups.setdefault((title, period), [])
        if content is not None:
            texts.append(content)
    return {group: " ".join(texts) for group, texts in groups.items()}


@pytest.mark.parametrize("limit", [1 << 20, 300, 40])
def test_period_documents_in_pieces_are_whole(spark, limit):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    pieces = corpus.period_pieces(df, limit).collect()
    found = {}
    for row in sorted(pieces, key=lambda row: row["piece"]):
        group = (row["title"], row["period"])
        found[group] = found[group] + " " + row["content"] if group in found else row["content"]
    assert found == joined()
    longest = max(len(row[4] or "") for row in ROWS)
    assert all(len(row["content"]) <= limit + longest + 1 for row in pieces)
    assert len(pieces) > len(found) if limit < 1000 else len(pieces) == len(found)


def test_period_documents_and_texts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    whole = corpus.period_documents(df, most_chars=1 << 20).collect()
    assert {(row["title"], row["period"]): row["content"] for row in whole} == joined() and len(whole) == len(joined())
    with pytest.raises(ValueError, match="period_texts"):
        corpus.period_documents(df, most_chars=40)
    groups = {}
    for row in sorted(corpus.period_texts(df).collect(), key=lambda row: row["position"]):
        texts = groups.setdefault((row["title"], row["period"]), [])
        assert row["position"] == len(texts)
        texts.append(row["content"])
    assert {group: " ".join(texts) for group, texts in groups.items()} == {group: text for group, text in joined().items() if group in groups}


def test_one_large_xml_file_is_read_by_many_tasks(spark, tmp_path):
    pages_text = "".join(
        f'<page _idx="{i}" pageid="{i}" ns="0" title="P &amp; {i} a/b"/>' if i % 3 == 0
        else f"<page _idx='{i}' pageid=\"{i}\" ns=\"0\" title=\"P{i}\"><revisions>"
        + "".join(f'<rev timestamp="2003-02-0{k}T00:00:00Z"> text {i}\n&lt;b&gt; {k} </rev>' for k in range(1, 1 + i % 3))
        + "</revisions></page>\n"
        for i in range(3000)
    )
    (tmp_path / "big.xml").write_text(f'<?xml version="1.0"?><api><warnings><main>page</main></warnings><query><pages>{pages_text}</pages></query></api>')
    plain = spark.read.format("xml").schema(pages.PAGE_SCHEMA).option("rowTag", "page").option("ignoreSurroundingSpaces", "false")
    expected = sorted(map(str, plain.load(f"{tmp_path}/big.xml").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        read = pages.read_pages(spark, f"{tmp_path}/*.xml")
        assert read.rdd.getNumPartitions() > 5
        assert sorted(map(str, read.collect())) == expected and len(expected) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_intermediate_tables_are_deleted(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {path.name for path in folder.iterdir()}
    with intermediate_tables(spark):
        df = stored(spark.range(5))
        assert df.count() == 5 and len({path.name for path in folder.iterdir()} - before) == 1
    assert {path.name for path in folder.iterdir()} == before


def test_running_total_equals_a_window(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("v", F.col("doc_id") % 10)
    found = {row["doc_id"]: row["total"] for row in corpus.running_total(df, "v", ["title", "period"], ["timestamp", "doc_id"]).collect()}
    totals, expected = {}, {}
    for doc_id, title, period, stamp, _ in sorted(ROWS, key=lambda row: (row[3], row[0])):
        totals[(title, period)] = totals.get((title, period), 0) + doc_id % 10
        expected[doc_id] = totals[(title, period)]
    assert found == expected


def test_broadcast_only_below_the_limit(spark):
    small = spark.createDataFrame([("x" * 100,)], "t string")
    assert 100 <= size_in_bytes(small) <= 200
    big = spark.range(1000).selectExpr("cast(id as string) as t")
    other = spark.range(10).selectExpr("cast(id as string) as t")
    hinted = other.join(broadcast_if_small(big), "t")._jdf.queryExecution().analyzed().toString()
    plain = other.join(broadcast_if_small(big, limit=1000), "t")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted and "broadcast" not in plain
