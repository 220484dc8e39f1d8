"""Reading, dating and grouping revisions, and statistics over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as revisions
from ..operators import summary
from ..runtime import new_table_path
from ..sources import pages
from . import inputs
from .registry import query


# Three documents are the revisions of one page; web pages stand for pages without any.
XML_SQL = """
SELECT 'page ' || CAST(doc_id // 3 AS VARCHAR) AS title, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, content FROM marked
UNION ALL SELECT url, NULL, NULL FROM pages"""


def _xml_pages(spark, folder):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.floor(F.col("doc_id") / 3)
    revision = F.struct(stamp.alias("_timestamp"), F.col("content").alias("_VALUE"))
    several = inputs.marked(spark, folder).groupBy(number.alias("__idx")).agg(F.collect_list(revision).alias("rev"))
    several = several.select("__idx", F.format_string("page %d", "__idx").alias("_title"), "rev")
    nothing = F.lit(None).cast(several.schema["rev"].dataType).alias("rev")
    none = inputs.table(spark, folder, "pages").select(F.col("page_id").alias("__idx"), F.col("url").alias("_title"), nothing)
    rows = several.unionByName(none)
    return rows.select(
        "__idx", F.col("__idx").alias("_pageid"), F.lit(0).cast("bigint").alias("_ns"), "_title",
        F.when(F.col("rev").isNotNull(), F.struct("rev")).alias("revisions"), F.pmod("__idx", F.lit(4)).alias("folder"),
    )


@query("xml_scan", inputs.with_marked(XML_SQL))
def xml_scan(spark, folder):
    """Pages with no, one and several revisions, written as XML in folders and read back by a glob."""
    path = new_table_path(spark)
    pages_xml = _xml_pages(spark, folder)
    pages_xml.write.format("xml").option("rowTag", "page").option("rootTag", "pages").partitionBy("folder").save(path)
    return pages.revisions(pages.read_pages(spark, f"{path}/*/*.xml"))


@query("pages_by_file", inputs.with_corpus("""
SELECT 'folder=' || CAST(number % 4 AS VARCHAR) AS folder, count(*) AS pages, CAST(sum(revisions) AS BIGINT) AS revisions
FROM (SELECT doc_id // 3 AS number, count(*) AS revisions FROM corpus GROUP BY number
  UNION ALL SELECT page_id, 0 FROM pages) GROUP BY number % 4"""))
def pages_by_file(spark, folder):
    """Pages and their revisions by the folder of the file that they were read from."""
    path = new_table_path(spark)
    _xml_pages(spark, folder).write.format("xml").option("rowTag", "page").option("rootTag", "pages").partitionBy("folder").save(path)
    read = pages.read_pages(spark, f"{path}/*/*.xml", lineage=True)
    revisions_of = F.coalesce(F.size("revisions.rev"), F.lit(0))
    counted = read.groupBy(F.regexp_extract(pages.FILE, "(folder=[0-9]+)/[^/]*$", 1).alias("folder"))
    return counted.agg(F.count("*").alias("pages"), F.sum(F.greatest(revisions_of, F.lit(0))).cast("bigint").alias("revisions"))


def _broken_xml(spark, folder):
    """A line of XML for each document: whole, without the end of its revision, without its end, or empty."""
    title = F.format_string("page %d", "doc_id")
    start = F.concat(F.lit('<page _idx="'), F.col("doc_id").cast("string"), F.lit('" title="'), title, F.lit('">'))
    text = F.concat(F.lit('<revisions><rev timestamp="2004-01-01T00:00:00Z">'), F.regexp_replace(F.regexp_replace("content", "&", "&amp;"), "<", "&lt;"))
    kind = F.col("doc_id") % 4
    whole = F.concat(start, text, F.lit("</rev></revisions></page>"))
    line = F.when(kind == 1, F.concat(start, text, F.lit("</revisions></page>"))).when(kind == 2, F.concat(start, text, F.lit("</rev></revisions>")))
    line = line.when(kind == 3, F.concat(F.lit('<page title="'), title, F.lit('" />'))).otherwise(whole)
    return inputs.corpus(spark, folder).select(line.alias("value"))


@query("xml_bad_pages", inputs.with_corpus("""
SELECT 'page ' || CAST(doc_id AS VARCHAR) AS title, doc_id % 4 IN (1, 2) AS bad, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS revisions FROM corpus"""))
def xml_bad_pages(spark, folder):
    """Half of the pages lack an end tag, inside or at their end: they are listed by file, all others are read."""
    path = new_table_path(spark)
    _broken_xml(spark, folder).write.text(path)
    good = pages.revisions(pages.read_pages(spark, path)).select("title", F.lit(False).alias("bad"), F.col("content").isNotNull().cast("int").alias("revisions"))
    bad = pages.bad_pages(spark, path).where(F.col("file").contains(path.rsplit("/", 1)[-1]))
    return good.union(bad.select(F.regexp_extract("record", 'title="([^"]*)"', 1), F.lit(True), F.lit(0)))


# Whole revisions, plus pages without any revision and blanked pages.
PAGES_SQL = """,
pages_seen AS (
  SELECT title, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, content FROM corpus
  UNION ALL SELECT url, NULL, NULL FROM pages
  UNION ALL SELECT text, 'no date', '' FROM benchmark)"""


def _pages_seen(spark, folder):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    nothing = F.lit(None).cast("string")
    dated = inputs.corpus(spark, folder).select("title", stamp, "content")
    absent = inputs.table(spark, folder, "pages").select(F.col("url").alias("title"), nothing.alias("timestamp"), nothing.alias("content"))
    blank = inputs.table(spark, folder, "benchmark").select(F.col("text").alias("title"), F.lit("no date").alias("timestamp"), F.lit("").alias("content"))
    return dated.unionByName(absent).unionByName(blank)


@query("nonempty", inputs.with_corpus(PAGES_SQL + "\nSELECT title, content FROM pages_seen WHERE content IS NOT NULL AND length(content) > 0"))
def nonempty(spark, folder):
    return revisions.nonempty(_pages_seen(spark, folder)).select("title", "content")


@query("revision_year", inputs.with_corpus(PAGES_SQL + """
SELECT title, CAST(epoch_us(t) AS BIGINT) AS micros, CAST(year(t) AS BIGINT) AS year
FROM (SELECT title, TRY_CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) AS t FROM pages_seen)"""))
def revision_year(spark, folder):
    """Strings to timestamps and years; no date gives NULL."""
    dated = revisions.with_year(_pages_seen(spark, folder))
    return dated.select("title", summary.epoch_micros("timestamp").alias("micros"), F.col("year").cast("bigint").alias("year"))


@query("period_bucket", inputs.with_corpus(f"""
SELECT doc_id, year, {inputs.PERIOD_SQL} AS period FROM corpus"""))
def period_bucket(spark, folder):
    return revisions.with_period(inputs.corpus(spark, folder)).select("doc_id", "year", "period")


LISTED = ("src0_en", "src3_en", "src5_de", "src5_de", "src8_fr", "src11_es", "no such title")
LISTED_SQL = "(" + ", ".join(f"'{title}'" for title in LISTED) + ")"


@query("corpus_subset", inputs.with_corpus(f"\nSELECT doc_id, title, content FROM corpus WHERE title IN {LISTED_SQL}"))
def corpus_subset(spark, folder):
    """Sub-corpus by a table of titles, one of them listed twice."""
    titles = spark.createDataFrame([(title,) for title in LISTED], "title string")
    return pages.subset(inputs.corpus(spark, folder), titles).select("doc_id", "title", "content")


@query("corpus_subset_literal", inputs.with_corpus(f"\nSELECT doc_id, title, content FROM corpus WHERE title IN {LISTED_SQL}"))
def corpus_subset_literal(spark, folder):
    return pages.subset(inputs.corpus(spark, folder), LISTED).select("doc_id", "title", "content")


@query("period_documents", inputs.with_corpus(f"""
SELECT title, {inputs.PERIOD_SQL} AS period, string_agg(content, ' ' ORDER BY timestamp, doc_id) AS content
FROM corpus GROUP BY ALL"""))
def period_documents(spark, folder):
    return revisions.period_documents(revisions.with_period(inputs.corpus(spark, folder)), most_chars=1 << 30)


@query("period_texts", inputs.with_corpus(f"""
SELECT title, {inputs.PERIOD_SQL} AS period,
  CAST(row_number() OVER (PARTITION BY title, {inputs.PERIOD_SQL} ORDER BY timestamp, doc_id) - 1 AS BIGINT) AS position, content
FROM corpus WHERE content IS NOT NULL"""))
def period_texts(spark, folder):
    """The same in long form, for groups of any size."""
    return revisions.period_texts(revisions.with_period(inputs.corpus(spark, folder)))


@query("period_documents_in_pieces", inputs.with_corpus(f""",
placed AS (SELECT title, {inputs.PERIOD_SQL} AS period, timestamp, doc_id, content, length(content) + 1 AS chars FROM corpus),
ends AS (SELECT *, sum(chars) OVER (PARTITION BY title, period ORDER BY timestamp, doc_id) AS total FROM placed)
SELECT title, period, CAST((total - chars) // 20000 AS BIGINT) AS piece, string_agg(content, ' ' ORDER BY timestamp, doc_id) AS content
FROM ends GROUP BY ALL"""))
def period_documents_in_pieces(spark, folder):
    return revisions.period_pieces(revisions.with_period(inputs.corpus(spark, folder)), piece_chars=20000)


@query("running_total", inputs.with_corpus("""
SELECT title, doc_id, length(content) AS chars,
       CAST(sum(length(content)) OVER (PARTITION BY title ORDER BY timestamp, doc_id) AS BIGINT) AS total
FROM corpus"""))
def running_total(spark, folder):
    sized = inputs.corpus(spark, folder).withColumn("chars", F.length("content").cast("bigint"))
    totals = revisions.running_total(sized, "chars", ["title"], ["timestamp", "doc_id"])
    return totals.select("title", "doc_id", "chars", "total")


ENDS_SQL = """,
sized AS (SELECT title, epoch_us(timestamp) AS micros, length(content) AS size, doc_id FROM corpus),
placed AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY micros, doc_id) AS first,
                  row_number() OVER (PARTITION BY title ORDER BY micros DESC, doc_id DESC) AS last FROM sized),
ends AS (SELECT f.title, f.micros AS earliest_date, f.size AS earliest_size, l.micros AS latest_date, l.size AS latest_size
         FROM placed f JOIN placed l ON f.title = l.title AND f.first = 1 AND l.last = 1)"""


def _ends(spark, folder):
    return summary.first_last_revision(inputs.corpus(spark, folder).withColumn("size", F.length("content").cast("bigint")))


@query("first_last_revision", inputs.with_corpus(ENDS_SQL + "\nSELECT * FROM ends"))
def first_last_revision(spark, folder):
    return _ends(spark, folder).select(
        "title",
        *[
            column
            for side in ("earliest", "latest")
            for column in (
                summary.epoch_micros(f"{side}.timestamp").alias(f"{side}_date"),
                F.col(f"{side}.size").alias(f"{side}_size"),
            )
        ],
    )


def _summary_sql() -> str:
    columns = []
    for side in ("earliest", "latest"):
        date, size = f"{side}_date", f"{side}_size"
        columns += [
            f"CAST((2 * sum(CAST({date} AS HUGEINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS {date}_mean",
            f"CAST(median({date}) AS BIGINT) AS {date}_median",
            f"min({date}) AS {date}_min",
            f"max({date}) AS {date}_max",
            f"round(avg({size}), 3) AS {size}_mean",
            f"CAST(median({size}) AS DOUBLE) AS {size}_median",
        ]
    return "\nSELECT " + ", ".join(columns) + " FROM ends"


@query("revision_summary", inputs.with_corpus(ENDS_SQL + _summary_sql()))
def revision_summary(spark, folder):
    """Mean, median and range of first and last dates and sizes; dates as microseconds."""
    row = summary.revision_summary(_ends(spark, folder))
    shown = [
        summary.epoch_micros(name).alias(name) if "_date_" in name
        else (F.round(name, 3) if name.endswith("_mean") else F.col(name)).alias(name)
        for name in row.columns
    ]
    return row.select(*shown)


@query("event_value_medians", """
SELECT 'event_id' AS measure, median(event_id) AS median FROM events
UNION ALL SELECT 'user_id', median(user_id) FROM events
UNION ALL SELECT 'micros', median(epoch_us(ts)) FROM events
UNION ALL SELECT 'below_zero', median(-user_id) FROM events""")
def event_value_medians(spark, folder):
    """The exact median search on its own, over times, ids and negative numbers."""
    events = inputs.table(spark, folder, "events").select(
        "event_id", "user_id", summary.epoch_micros("ts").alias("micros"), (-F.col("user_id")).alias("below_zero")
    )
    medians = summary.exact_medians(summary.value_counts(events, events.columns))
    return medians.withColumn("median", F.col("median").cast("double"))
