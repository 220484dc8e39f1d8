"""Dated revisions: filters, derived columns, one document per title and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stored

# The four periods, both ends included.
PERIODS = (
    (2001, 2005, "2001-2005"),
    (2006, 2011, "2006-2011"),
    (2012, 2018, "2012-2018"),
    (2019, 2024, "2019-2024"),
)


def nonempty(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(F.length(column) > 0)


def with_year(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Timestamp without zone, and its year; a string that is no timestamp gives NULL.

    Export timestamps are UTC ("...Z"), so years do not depend on the session zone.
    """
    parsed = F.col(timestamp).try_cast("timestamp_ntz")
    return df.withColumn(timestamp, parsed).withColumn("year", F.year(timestamp))


def period_label(year: Column, periods: Sequence[tuple[int, int, str]] = PERIODS) -> Column:
    """Label of the range that holds the year; NULL outside all of them."""
    label = F.lit(None).cast("string")
    for first, last, name in reversed(periods):
        label = F.when(year.between(first, last), F.lit(name)).otherwise(label)
    return label


def with_period(df: DataFrame, periods: Sequence[tuple[int, int, str]] = PERIODS) -> DataFrame:
    return df.withColumn("period", period_label(F.col("year"), periods))


def _join(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, NULL being equal to NULL; the right copies are dropped."""
    copies = {name: f"_right_{name}" for name in columns}
    right = right.withColumnsRenamed(copies)
    condition = F.lit(True)
    for name, copy in copies.items():
        condition = condition & F.col(name).eqNullSafe(F.col(copy))
    return left.join(right, condition, how).drop(*copies.values())


def running_total(
    df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], name: str = "total", keep: Sequence[str] = ()
) -> DataFrame:
    """``(group, order, value, keep, name)`` with the running total of ``value`` inside each group.

    No task sees a whole group: rows are range-partitioned by group and order, each
    slice sums its own rows, and the slices' sums, one row per group and slice, give
    the offsets. The order must be unique inside a group.
    """
    group, order, keep = list(group), list(order), list(keep)
    ranged = df.select(*group, *order, value, *keep).repartitionByRange(*group, *order)
    slices = stored(ranged.withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slices.groupBy(*group, "_slice")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = slices.withColumn("_inside", F.sum(value).over(inside))
    return _join(rows, offsets, [*group, "_slice"], "inner").select(
        *group, *order, value, *keep, (F.col("_inside") + F.col("_before")).alias(name)
    )


def _joined(rows: DataFrame, group: list[str], order: list[str], content: str) -> DataFrame:
    text = F.when(F.col(content).isNotNull(), F.struct(*order, F.col(content)))
    texts = F.transform(F.array_sort(F.collect_list(text)), lambda row: row[content])
    return rows.groupBy(*group).agg(F.concat_ws(" ", texts).alias(content))


GROUP, ORDER = ("title", "period"), ("timestamp", "doc_id")


def period_texts(
    df: DataFrame, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER, content: str = "content"
) -> DataFrame:
    """Texts of a group in order, one row each: ``(group, position, content)``, positions from 0.

    The form for groups of any size: nothing is put together, and positions come from a
    distributed running total over the keys alone. NULL texts are left out, a NULL period is
    a group. The order must be unique inside a group.
    """
    group, order = list(group), list(order)
    texts = df.select(*group, *order, content).where(F.col(content).isNotNull())
    counted = running_total(texts.select(*group, *order, F.lit(1).cast("bigint").alias("_one")), "_one", group, order, "_place")
    placed = _join(texts, counted.drop("_one"), [*group, *order], "inner")
    return placed.select(*group, (F.col("_place") - 1).alias("position"), content)


def period_pieces(
    df: DataFrame, piece_chars: int, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER, content: str = "content"
) -> DataFrame:
    """Texts of a group joined in pieces: ``(group, piece, content)``; joined by a blank they are the whole.

    A text belongs to the piece in which it starts, counted in characters; pieces of all groups
    are cut alike. NULL texts are skipped. The order must be unique inside a group.
    """
    group, order = list(group), list(order)
    chars = F.coalesce(F.length(content) + 1, F.lit(0)).cast("bigint")
    sized = stored(df.select(*group, *order, chars.alias("_chars")))
    ends = running_total(sized, "_chars", group, order, "_end")
    piece = F.floor((F.col("_end") - F.col("_chars")) / piece_chars).cast("bigint")
    pieces = ends.select(*group, *order, piece.alias("piece"))
    placed = _join(df.select(*group, *order, content), pieces, [*group, *order], "inner")
    return _joined(placed, [*group, "piece"], order, content)


def period_documents(
    df: DataFrame, most_chars: int, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER, content: str = "content"
) -> DataFrame:
    """Texts of a group joined by a blank, in order: ``(group, content)``, one row per group.

    Raises if a group has more than ``most_chars`` characters: such groups are for
    `period_texts` or `period_pieces`. Lengths are added up in a pass of their own, before any
    text is moved. NULL texts are skipped, a NULL period is a group.
    """
    group, order = list(group), list(order)
    chars = F.coalesce(F.length(content) + 1, F.lit(0)).cast("bigint")
    totals = df.groupBy(*group).agg(F.sum(chars).alias("_total"))
    longest = totals.agg(F.max("_total")).first()[0] or 0
    if longest > most_chars:
        raise ValueError(f"a group has {longest} characters, more than {most_chars}; use period_texts or period_pieces")
    return _joined(df.select(*group, *order, content), group, order, content)
