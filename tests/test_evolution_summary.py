import statistics
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from topicdrift.operators import evolution, summary


def test_shares_add_up_and_missing_topics_are_null(spark):
    rows = spark.createDataFrame([(2001, 0, 1.0), (2001, 2, 3.0), (2002, 2, 0.0), (2002, 0, 0.0), (None, 2, 5.0)], "year int, topic int, w double")
    shares = evolution.prevalence_share(evolution.prevalence_sum(rows, ["year"], "topic", "w"), ["year"])
    assert {(row["year"], row["topic"], row["share"]) for row in shares.collect()} == {
        (2001, 0, 0.25), (2001, 2, 0.75), (2002, 0, None), (2002, 2, None), (None, 2, 1.0)
    }
    wide = evolution.prevalence_pivot(shares, ["year"], "topic", [0, 1, 2])
    assert wide.columns == ["year", "topic_0", "topic_1", "topic_2"]
    assert [tuple(row) for row in wide.collect()] == [(None, None, None, 1.0), (2001, 0.25, None, 0.75), (2002, None, None, None)]


def test_mass_equals_the_long_way(spark):
    rows = spark.createDataFrame([(1, 2001, [0.2, 0.8]), (2, 2001, [0.5, 0.5]), (3, 2002, [1.0, 0.0])], "id int, year int, d array<double>")
    short = evolution.topic_mass(rows, "d", ["year"], 2)
    long = evolution.prevalence_sum(evolution.topic_long(rows, "d", ["year"]), ["year"], "topic", "share")
    show = lambda df: sorted((r["year"], r["topic"], round(r["total"], 9)) for r in df.collect())
    assert show(short) == show(long) == [(2001, 0, 0.7), (2001, 1, 1.3), (2002, 0, 1.0), (2002, 1, 0.0)]


def test_trajectory_of_unknown_titles_is_empty(spark):
    rows = spark.createDataFrame([("a", 2, [0.1, 0.9]), ("a", 1, [1.0, 0.0]), ("b", 1, [0.5, 0.5])], "title string, year int, d array<double>")
    found = evolution.title_trajectory(rows, ["a"], "d", 2)
    assert [tuple(row) for row in found.collect()] == [("a", 1, 1.0, 0.0), ("a", 2, 0.1, 0.9)]
    assert evolution.title_trajectory(rows, ["z"], "d", 2).count() == 0


REVISIONS = [
    ("a", datetime(2003, 1, 1), 10, 2), ("a", datetime(2003, 1, 1), 11, 1), ("a", datetime(2009, 5, 5), 30, 3),
    ("b", datetime(2005, 1, 1, 0, 0, 1), 7, 4), ("c", None, None, 5),
]


def test_first_last_and_summary(spark):
    rows = spark.createDataFrame(REVISIONS, "title string, timestamp timestamp_ntz, size bigint, doc_id bigint")
    pages = summary.first_last_revision(rows)
    found = {row["title"]: row for row in pages.collect()}
    assert tuple(found["a"]["earliest"]) == (datetime(2003, 1, 1), 11) and tuple(found["a"]["latest"]) == (datetime(2009, 5, 5), 30)
    assert found["b"]["earliest"] == found["b"]["latest"] and found["c"]["earliest"] is None
    row = summary.revision_summary(pages).first()
    assert row["earliest_date_mean"] == row["earliest_date_median"] == datetime(2004, 1, 1, 12, 0, 0, 500000)
    assert (row["earliest_date_min"], row["earliest_date_max"]) == (datetime(2003, 1, 1), datetime(2005, 1, 1, 0, 0, 1))
    assert (row["earliest_size_mean"], row["earliest_size_median"], row["latest_size_mean"]) == (9.0, 9.0, 18.5)


def test_summary_of_nothing_is_null(spark):
    rows = spark.createDataFrame([("c", None, None, 5)], "title string, timestamp timestamp_ntz, size bigint, doc_id bigint")
    assert set(summary.revision_summary(summary.first_last_revision(rows)).first()) == {None}


@pytest.mark.parametrize("bins", [0, summary.MEDIAN_BINS])
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**62), 2**62), st.integers(-3, 3)), min_size=1, max_size=30))
def test_medians(spark, bins, values):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(summary, "MEDIAN_BINS", bins)
        check_medians(spark, values)


def check_medians(spark, values):
    rows = spark.createDataFrame([(value, None) for value in values], "x bigint, y bigint")
    found = {row["measure"]: row["median"] for row in summary.exact_medians(summary.value_counts(rows, ["x", "y"])).collect()}
    ordered = sorted(values)
    middle = ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]
    assert found.keys() == {"x"} and found["x"] * 2 == pytest.approx(middle, abs=1e-3)
    if max(map(abs, values)) < 1000:
        assert float(found["x"]) == statistics.median(values)


def test_year_of_ntz_ignores_the_session_zone(spark):
    rows = spark.sql("select timestamp_ntz'1970-01-01 00:00:01' t")
    micros = rows.select(summary.epoch_micros("t").alias("m"))
    assert micros.first()["m"] == 1_000_000
    assert micros.select(summary.from_micros(F.col("m"))).first()[0] == datetime(1970, 1, 1, 0, 0, 1)


def test_micros_of_times_the_session_zone_skips(spark):
    rows = spark.sql("select timestamp_ntz'2003-04-06 02:30:00.25' t union all select timestamp_ntz'1969-12-31 23:59:59'")
    found = {row["m"] for row in rows.select(summary.epoch_micros("t").alias("m")).collect()}
    assert found == {1049596200250000, -1000000}
