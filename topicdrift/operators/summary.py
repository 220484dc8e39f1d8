"""First and last revisions of pages, and statistics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stored

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# Bits left open after each step of the median search, so that a step counts at most 2^22
# bins per measure. With no more distinct values than that, one step counts the values.
MEDIAN_SHIFTS = (42, 21, 0)
MEDIAN_BINS = 1 << 22


def epoch_micros(timestamp: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session zone.

    Put together from date and time of day: a difference of timestamps would go through
    the session zone and move times that its clock changes skip.
    """
    days = F.datediff(F.col(timestamp).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(timestamp)) * 60 + F.minute(timestamp)
    seconds = F.date_part(F.lit("SECOND"), F.col(timestamp))
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def from_micros(micros: Column) -> Column:
    """Timestamp without zone from whole microseconds since the epoch."""
    seconds = (micros.cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(secs=seconds)


def first_last_revision(
    df: DataFrame, title: str = "title", timestamp: str = "timestamp", size: str = "size", tie: str = "doc_id"
) -> DataFrame:
    """``(title, earliest, latest)``, each a struct ``(timestamp, size)``; NULL without revisions.

    Partial minima and maxima are taken before the shuffle, so a page with very many
    revisions sends one row per task. Equal times are ordered by ``tie``.
    """
    revision = F.struct(F.col(timestamp).alias("timestamp"), F.col(size).alias("size"))
    place = F.when(F.col(timestamp).isNotNull(), F.struct(timestamp, tie))
    return df.groupBy(title).agg(
        F.min_by(revision, place).alias("earliest"), F.max_by(revision, place).alias("latest")
    )


def value_counts(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``(measure, value, m)``: how often each value of some integer columns occurs, as a
    stored table; NULLs do not count."""
    entries = [F.struct(F.lit(name).alias("measure"), F.col(name).cast("bigint").alias("value")) for name in measures]
    values = df.select(F.inline(F.array(*entries))).where("value is not null")
    return stored(values.groupBy("measure", "value").agg(F.count("*").alias("m")))


def exact_medians(counts: DataFrame) -> DataFrame:
    """``(measure, median)`` of ``value_counts``, the middle two values averaged.

    Of many distinct values, three steps look for the middle ones, 21 bits at a time:
    each counts bins inside the bin found before and keeps the one with the wanted rank.
    So no task holds more than ``MEDIAN_BINS`` rows of a measure.
    """
    ranks = F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1)
    wanted = (
        counts.groupBy("measure")
        .agg(F.sum("m").alias("total"))
        .select("measure", F.lit(0).cast("bigint").alias("bin"), F.posexplode(ranks).alias("side", "rank"))
    )
    outer = F.lit(0).cast("bigint")
    shifts = MEDIAN_SHIFTS if counts.count() > MEDIAN_BINS else (0,)
    for shift in shifts:
        inner = F.shiftright("value", shift)
        bins = counts.groupBy("measure", outer.alias("bin"), inner.alias("inner")).agg(F.sum("m").alias("m"))
        upto = Window.partitionBy("measure", "side").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            bins.join(F.broadcast(wanted), ["measure", "bin"])
            .withColumn("upto", F.sum("m").over(upto))
            .where("upto >= rank and upto - m < rank")
        )
        wanted = found.select("measure", F.col("inner").alias("bin"), "side", (F.expr("rank - (upto - m)")).alias("rank"))
        outer = inner
    return wanted.groupBy("measure").agg((F.sum(F.col("bin").cast("decimal(20,0)")) / 2).alias("median"))


def measure_statistics(counts: DataFrame) -> DataFrame:
    """``(measure, mean, median, min, max)`` of ``value_counts``; means are exact decimals."""
    weighted = F.col("value").cast("decimal(20,0)") * F.col("m")
    totals = counts.groupBy("measure").agg(
        (F.sum(weighted) / F.sum("m")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return totals.join(exact_medians(counts), "measure")


def revision_summary(pages: DataFrame) -> DataFrame:
    """One row of statistics over ``first_last_revision``: mean, median, least and greatest
    date, mean and median size, each of the first and of the last revisions.

    Pages without revisions do not count, and without any page all columns are NULL.
    """
    flat = pages.select(
        *[
            column
            for side in ("earliest", "latest")
            for column in (
                epoch_micros(f"{side}.timestamp").alias(f"{side}_date"),
                F.col(f"{side}.size").cast("bigint").alias(f"{side}_size"),
            )
        ]
    )
    known = measure_statistics(value_counts(flat, flat.columns))
    columns = []
    for side in ("earliest", "latest"):
        for statistic in ("mean", "median", "min", "max"):
            micros = F.max(F.when(F.col("measure") == f"{side}_date", F.round(statistic, 0)))
            columns.append(from_micros(micros).alias(f"{side}_date_{statistic}"))
        for statistic in ("mean", "median"):
            size = F.max(F.when(F.col("measure") == f"{side}_size", F.col(statistic)))
            columns.append(size.cast("double").alias(f"{side}_size_{statistic}"))
    return known.agg(*columns)
