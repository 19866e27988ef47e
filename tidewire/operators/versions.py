"""First and last of repeated announcements.

``max_by`` over text or structs cannot use hash aggregation, so a plain one sorts every row. Announcements repeat:
equal ones collapse first in a hash aggregation that keeps only their first or last number, and the few distinct
ones left per key go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], facts: Sequence[str], order: str, fold, pick) -> DataFrame:
    distinct = df.groupBy(*keys, *facts).agg(fold(order).alias(order))
    picked = distinct.groupBy(*keys).agg(pick(F.struct(*facts, order), order).alias("_one"))
    return picked.select(*keys, "_one.*")


def last_version(df: DataFrame, keys: Sequence[str], facts: Sequence[str], order: str = "seq") -> DataFrame:
    """``keys``, the ``facts`` of the row with the highest ``order``, and that order."""
    return _pick(df, keys, facts, order, F.max, F.max_by)


def first_version(df: DataFrame, keys: Sequence[str], facts: Sequence[str], order: str = "seq") -> DataFrame:
    """``keys``, the ``facts`` of the row with the lowest ``order``, and that order."""
    return _pick(df, keys, facts, order, F.min, F.min_by)
