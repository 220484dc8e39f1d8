"""Page revisions from XML exports, and sub-corpora by title."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..runtime import broadcast_if_small

# One row per <page>. Attributes carry the reader's prefix "_", so the attribute
# "_idx" is "__idx". An array of revisions reads pages with none, one or many.
REVISION = T.StructType([T.StructField("_timestamp", T.StringType()), T.StructField("_VALUE", T.StringType())])
PAGE_SCHEMA = T.StructType([
    T.StructField("__idx", T.LongType()),
    T.StructField("_pageid", T.LongType()),
    T.StructField("_ns", T.LongType()),
    T.StructField("_title", T.StringType()),
    T.StructField("revisions", T.StructType([T.StructField("rev", T.ArrayType(REVISION))])),
])

# The eleven titles of the test sub-corpus.
SAMPLE_TITLES = (
    "Feminism", "Gender studies", "Cancel culture", "Equal opportunity",
    "Gender pay gap", "Intersectionality", "LGBTQ", "Glass ceiling",
    "Transphobia", "Identity politics", "Racism in the United States",
)


# A page without content is one empty element; others end at their own end tag.
PAGE = "<page"
AFTER_START = r"^(?:\s*/?>|\s+[\w:])"
ONE_PAGE = r"""(?s)^(?:<page(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?/>|<page[\s>].*?</page>)"""

#: Column of `read_pages` with the file of a page.
FILE = "_file"


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """``(page, bad, file, block_start)``: parsed pages, and the text of those that are no XML.

    Files are cut where a page starts, so a large file is read by many tasks, and a page without an
    end does not swallow the next one.
    """
    chunks = spark.read.option("lineSep", PAGE).text(path).where(F.col("value").rlike(AFTER_START))
    pieces = chunks.select(
        F.concat(F.lit(PAGE), "value").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    found = F.regexp_extract("piece", ONE_PAGE, 0)
    schema = T.StructType([*PAGE_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_xml(F.when(found != "", found), schema, {"ignoreSurroundingSpaces": "false"})
    # A generator keeps the parsed page together: no later filter parses it again.
    rows = pieces.select("file", "block_start", F.explode(F.array(F.struct(parsed.alias("page"), F.when(found == "", F.col("piece")).alias("open")))).alias("read"))
    return rows.select("read.page", F.coalesce("read.open", "read.page._corrupt_record").alias("bad"), "file", "block_start")


def read_pages(spark: SparkSession, path: str, lineage: bool = False) -> DataFrame:
    """Page rows of all XML files under a path or glob; the schema is given, not inferred.

    What stands before the first page and after the last is left out, and so are malformed pages,
    which `bad_pages` lists. ``lineage`` adds the file of each page (`FILE`).
    """
    rows = _scanned(spark, path).where("bad IS NULL")
    names = [F.col(f"page.{field.name}") for field in PAGE_SCHEMA.fields]
    return rows.select(*names, *[F.col("file").alias(FILE)] * lineage)


def bad_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block_start, record)``: the text of each malformed page, its file, and the byte at which the task that read it began."""
    return _scanned(spark, path).where("bad IS NOT NULL").select("file", "block_start", F.col("bad").alias("record"))


def revisions(pages: DataFrame) -> DataFrame:
    """``(title, timestamp, content)``, one row per revision, and the file, if the pages have it.

    A page without revisions keeps one row of NULLs. Timestamps are strings ending
    in ``Z``; see ``operators.corpus.with_year`` for their parsing.
    """
    kept = [name for name in (FILE,) if name in pages.columns]
    exploded = pages.select(F.col("_title").alias("title"), F.explode_outer("revisions.rev").alias("rev"), *kept)
    return exploded.select(
        "title",
        F.col("rev._timestamp").alias("timestamp"),
        F.col("rev._VALUE").alias("content"),
        *kept,
    )


def subset(df: DataFrame, titles: Sequence[str] | DataFrame, column: str = "title") -> DataFrame:
    """Rows whose title is listed; titles listed twice count once.

    A Python list becomes a predicate that reaches the scan. A frame with a column of
    the same name becomes a semi join, broadcast if it measures small.
    """
    if not isinstance(titles, DataFrame):
        return df.where(F.col(column).isin(list(titles)))
    listed = broadcast_if_small(titles.select(column).distinct())
    return df.join(listed, column, "left_semi")


def ingest(df: DataFrame, path: str, given_years_only: bool = False) -> None:
    """Write dated revisions as parquet, one directory per year, in place of what is there.

    ``given_years_only`` replaces the years that ``df`` has and keeps all others. The rebalance hint
    lets adaptive execution split a year that holds most rows and join small ones, so files
    come out even in size.
    """
    writer = df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year")
    if given_years_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
