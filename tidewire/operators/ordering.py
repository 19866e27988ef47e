"""Sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.filters import topic_filter
from tidewire.session import Scratch

READ_ORDERS = {
    "file": ["split", "arrival_seq"],
    "time": ["log_time_ns", "split", "arrival_seq"],
}
_ROW_BITS = 33  # monotonically_increasing_id() is the partition above so many bits, and the row's place in it


def topics_distinct(df: DataFrame) -> DataFrame:
    return df.select("topic").distinct()


def topics_sorted(df: DataFrame) -> DataFrame:
    return topics_distinct(df).orderBy("topic")


def endpoints_by_guid(df: DataFrame) -> DataFrame:
    """Byte-wise GUID order, which is the order of the fixed-width hex text."""
    return df.orderBy("guid")


def _order_by(order: str) -> list[Column]:
    if order == "reverse_time":
        return [F.col(name).desc() for name in READ_ORDERS["time"]]
    return [F.col(name).asc() for name in READ_ORDERS[order]]


def read_order(df: DataFrame, order: str = "file") -> DataFrame:
    """``file``, ``time`` or ``reverse_time``; equal times keep (or reverse) their file position."""
    return df.orderBy(*_order_by(order))


def read_positions(df: DataFrame, order: str = "file") -> DataFrame:
    """:func:`read_order` as a column: ``position`` counts all rows from 0, those of several recordings that tie by recording."""
    return numbered(df, [*_order_by(order), F.col("recording_id").asc()])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Rows with their place in a total order, from 0.

    Rows are dealt to tasks by ranges of the order and sorted there, once, into a written table; rows before a range are the sum of the
    counts of the ranges before it. No task sees more than its range, and no row is shuffled again. Rows that tie in ``order`` are
    numbered one after the other, in an order that the written table fixes.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.keep(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", _ROW_BITS), F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    counts = sorted(placed.groupBy(part.alias("_part")).count().collect())  # a row a task
    before = accumulate((row["count"] for row in counts), initial=0)
    starts = df.sparkSession.createDataFrame([(row["_part"], rows) for row, rows in zip(counts, before)], "_part bigint, _before bigint")
    return (placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_before") + place)
            .drop("_part", "_place", "_before"))


def first_n(df: DataFrame, n: int = 0) -> DataFrame:
    """First ``n`` rows by arrival; 0 means all."""
    ordered = df.orderBy("arrival_seq")
    return ordered.limit(n) if n else ordered


def include_minus_exclude(df: DataFrame, topics: list[str], exclude: str, regex: bool = False) -> DataFrame:
    names = topics_distinct(df)
    included = names.where(topic_filter(topics, regex=regex))
    return included.subtract(names.where(topic_filter([exclude], regex=True)))
