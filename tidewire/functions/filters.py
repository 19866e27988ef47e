"""Predicates on messages, endpoints and participants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _full_match(topic: Column, pattern: str) -> Column:
    return topic.rlike(rf"\A(?:{pattern})\z")


def topic_filter(topics: Sequence[str] = (), *, regex: bool = False, exclude: str = "",
                 column: Column | str = "topic") -> Column:
    """Include list (exact names or full-match patterns) minus an exclude pattern.

    An empty include list keeps every topic; the exclude pattern is a regex either way and wins.
    """
    topic = _column(column)
    if not topics:
        keep = F.lit(True)
    elif regex:
        keep = reduce(lambda a, b: a | b, [_full_match(topic, pattern) for pattern in topics])
    else:
        keep = topic.isin(*topics)
    return ~_full_match(topic, exclude) & keep if exclude else keep


def not_system(column: Column | str = "topic") -> Column:
    """Drops empty names, built-in topics and the ``rt/`` namespace."""
    topic = _column(column)
    return (topic != "") & ~topic.startswith("DCPS") & ~topic.startswith("rt/")


def not_builtin(column: Column | str = "topic") -> Column:
    topic = _column(column)
    return topic.isNotNull() & ~topic.startswith("DCPS")


def by_topic_substring(df: DataFrame, text: str) -> DataFrame:
    """Participants with a published or subscribed topic that contains ``text``; empty text keeps all."""
    if not text:
        return df

    def hit(name: str) -> Column:
        return F.coalesce(F.exists(name, lambda topic: topic.contains(text)), F.lit(False))

    return df.where(hit("pub_topics") | hit("sub_topics"))


def exclude_guid(df: DataFrame, guid: str, show_self: bool = False) -> DataFrame:
    return df if show_self else df.where(F.col("guid") != guid)


def valid_only(df: DataFrame) -> DataFrame:
    return df.where("valid")


def alive_only(df: DataFrame) -> DataFrame:
    """Valid samples of live instances; feeds without a ``valid`` flag are valid throughout."""
    return df.where("valid and alive" if "valid" in df.columns else "alive")


def time_range(df: DataFrame, start: int = 0, end: int | None = None, column: str = "log_time_ns") -> DataFrame:
    """Half-open range ``start <= time < end``; without ``end`` up to the last representable time."""
    if end is not None and start > end:
        raise ValueError("start time must be before end time")
    late = F.col(column) >= start
    return df.where(late if end is None else late & (F.col(column) < end))


def writers(df: DataFrame) -> DataFrame:
    return df.where("is_writer")


def has_payload(column: Column | str = "payload") -> Column:
    """Longer than the 4-byte header."""
    return F.octet_length(_column(column)) > 4
