"""Running results over one ordered key, without putting the key into one task.

A window partitioned by topic (or recording) alone would send a hot topic to a single task. Here rows are
grouped by (key, block of the arrival order): a small per-block summary is scanned in order, joined back, and
the row-level window runs inside the block only.

Blocks are intervals of the arrival order of about equal depth (:func:`equal_blocks`), whether the sequence counts rows, time or
bytes, and however unevenly: a block of more than twice ``block_rows`` rows is cut again until none is left. Only rows of one
key that share one value of the sequence stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.scalars import floor_div
from tidewire.session import Scratch

BLOCK_ROWS = 1 << 18
BLOCK = "_block"
_SAMPLE = 1024
_FINER = 64
# Per fact of a block: what it is of a row, and how those of rows, and of neighbouring blocks, come together.
Facts = dict[str, tuple[Column, Callable[[str], Column]]]


def _first_width(rows: DataFrame, order: str, block_rows: int) -> int:
    """``block_rows`` times the usual step between values of the sequence that lie together in the input; no more than a first guess."""
    some = rows.select(F.col(order).cast("long").alias("v")).where("v is not null").limit(_SAMPLE).toArrow().column(0).to_numpy()
    steps = np.diff(np.unique(some))
    return max(1, min(int(np.median(steps)) if len(steps) else 1, (1 << 62) // block_rows) * block_rows)


def _summed(blocked: DataFrame, keys: Sequence[str], facts: Facts, order: str) -> DataFrame:
    at = F.col(order).cast("long")
    given = blocked.select(*keys, BLOCK, "_width", at.alias("_low"), at.alias("_high"), F.lit(1).cast("long").alias("_rows"),
                           *[of_row.alias(name) for name, (of_row, _) in facts.items()])
    return _folded(given, keys, facts)


def _folded(given: DataFrame, keys: Sequence[str], facts: Facts) -> DataFrame:
    return given.groupBy(*keys, BLOCK, "_width").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_rows").alias("_rows"),
        *[fold(name).alias(name) for name, (_, fold) in facts.items()])


def _is(left: DataFrame, right: DataFrame, names: Sequence[str], of: str = "_of_") -> Column:
    return reduce(lambda a, b: a & b, [left[name].eqNullSafe(right[f"{of}{name}"]) for name in names])


def equal_blocks(rows: DataFrame, keys: Sequence[str], order: str, block_rows: int, facts: Facts, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the column ``BLOCK``, and the table of blocks: key, ``BLOCK``, ``_low`` and ``_high`` of the sequence, ``_rows``, facts.

    ``BLOCK`` is where the block's interval begins, so blocks of a key are in order. The rows are read once for the table; if blocks are
    nearly empty, neighbours are put together in the table alone; if one is too full, its rows alone are read again and cut finer.
    Rows without a place in the sequence have the block null.
    """
    width = _first_width(rows, order, block_rows)

    def cut(width: int) -> DataFrame:
        return rows.withColumn(BLOCK, floor_div(order, width) * width)

    blocked = cut(width)
    table = scratch.keep(_summed(blocked.withColumn("_width", F.lit(width)), keys, facts, order))
    found = table.agg(F.count("*").alias("blocks"), F.sum("_rows").alias("rows"), F.max("_rows").alias("fullest")).first()
    if found["blocks"] > 64 and found["rows"] * _FINER < found["blocks"] * block_rows:
        per_key = table.groupBy(*keys).agg(F.sum("_rows").alias("rows"), (F.max("_high") - F.min("_low") + 1).alias("extent"))
        gap = F.min(F.when(F.col("rows") >= block_rows, F.col("extent") / F.col("rows")))
        best = per_key.agg(gap.alias("gap"), F.max("extent").alias("extent")).first()
        wanted = int(best["gap"] * block_rows) if best["gap"] is not None else int(best["extent"] or 1)
        if wanted >= 2 * width:
            width *= min(wanted, 1 << 61) // width
            blocked, fine = cut(width), table
            wide = fine.withColumns({BLOCK: floor_div(BLOCK, width) * width, "_width": F.lit(width)})
            table = scratch.keep(_folded(wide, keys, facts))
            scratch.drop(fine)
            found = table.agg(F.max("_rows").alias("fullest")).first()
    while found["fullest"] is not None and found["fullest"] > 2 * block_rows:
        full = F.coalesce((F.col("_rows") > 2 * block_rows) & (F.col("_low") < F.col("_high")), F.lit(False))
        even = F.floor((F.col("_high") - F.col("_low") + 1) / F.col("_rows") * block_rows)
        finer = F.greatest(F.lit(1), F.least(even, F.floor(F.col("_width") / _FINER))).cast("long")
        heavy = scratch.keep(table.where(full).select(*[F.col(name).alias(f"_of_{name}") for name in (*keys, BLOCK)], finer.alias("_finer")))
        if not heavy.limit(1).count():
            break
        inner = F.col(BLOCK) + F.call_function("div", F.col(order).cast("long") - F.col(BLOCK), F.col("_finer")) * F.col("_finer")
        same = _is(blocked, heavy, (*keys, BLOCK))
        again = blocked.join(heavy, same).withColumns({BLOCK: inner, "_width": F.col("_finer")})
        left = table.where(~full)
        parts = left.unionByName(_summed(again, keys, facts, order).select(*table.columns))
        blocked = blocked.join(heavy, same, "left").withColumn(BLOCK, F.coalesce(inner, BLOCK)).select(*rows.columns, BLOCK)
        whole = table
        table = scratch.keep(parts)
        scratch.drop(whole)
        found = table.where("_low < _high").agg(F.max("_rows").alias("fullest")).first()
    return blocked, table.drop("_width")


def block_carry(table: DataFrame, keys: Sequence[str], combine, fact: str = "_own") -> DataFrame:
    """The table of blocks with the combination ``_carry`` of a fact of all earlier blocks of the key."""
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return table.withColumn("_carry", combine(fact).over(earlier))


def inside_block(keys: Sequence[str], order: str):
    return W.partitionBy(*keys, BLOCK).orderBy(order)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names that come once; null keys are a key like any other."""
    other = right.select(*[F.col(name).alias(f"_of_{name}") if name in keys else F.col(name) for name in right.columns])
    same = reduce(lambda a, b: a & b, [left[name].eqNullSafe(other[f"_of_{name}"]) for name in keys])
    return left.join(other, same, how).drop(*[f"_of_{name}" for name in keys])


def with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the blocks in ``carry``, each with its ``_carry``; null keys are a key like any other."""
    right = carry.select(*[F.col(name).alias(f"_of_{name}") for name in (*keys, BLOCK)], "_carry")
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(right[f"_of_{k}"]) for k in keys], rows[BLOCK] == right[f"_of_{BLOCK}"])
    return rows.join(right, same).select(*[rows[name] for name in rows.columns], "_carry")
