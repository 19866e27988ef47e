"""Publishing-rate statistics per stream: a topic of one recording, or whatever columns ``keys`` name.

A timestamp counts only if it is greater than every earlier one of its stream in arrival order, so the last
counted timestamp is always the running maximum: one running maximum gives both the filter and the interval.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.filters import valid_only
from tidewire.functions.scalars import NANOS, effective_time, floor_div
from tidewire.operators.blocks import BLOCK, BLOCK_ROWS, block_carry, equal_blocks, inside_block, with_carry
from tidewire.session import Scratch

DEFAULT_WINDOW = 100
TILE_ROWS = 1 << 17
# smaller blocks leave fewer rows to look at behind the first pass, for more summary rows
LATEST_BLOCK_ROWS = 1 << 16
STREAM = ("recording_id", "topic")


def stamps(msgs: DataFrame, keys: Sequence[str] = STREAM) -> DataFrame:
    """The header columns the statistics need; payloads are never read."""
    return valid_only(msgs).select(
        *keys, "arrival_seq", "log_time_ns",
        effective_time("source_time_ns", "log_time_ns").alias("t"))


def window_size(window: int) -> int:
    return max(2, window)


def _kept(blocked: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows above everything before them; ``dt`` is the step up (null for a stream's first)."""
    before = F.max("t").over(inside_block(keys, "arrival_seq").rowsBetween(W.unboundedPreceding, -1))
    return (with_carry(blocked, carry, keys)
            .withColumn("dt", F.col("t") - F.greatest(F.col("_carry"), before))
            .where(F.col("dt").isNull() | (F.col("dt") > 0))
            .drop("_carry"))


def _raises(stamped: DataFrame, block_rows: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in blocks, and per block the greatest timestamp of its own and of all blocks before."""
    blocked, table = equal_blocks(stamped, keys, "arrival_seq", block_rows, {"_own": (F.col("t"), F.max)}, Scratch(stamped.sparkSession, "rates"))
    return blocked, block_carry(table, keys, F.max)


def _intervals(msgs: DataFrame, block_rows: int, keys: Sequence[str]) -> DataFrame:
    blocked, raises = _raises(stamps(msgs, keys), block_rows, keys)
    return _kept(blocked, raises, keys)


def intervals(msgs: DataFrame, block_rows: int = BLOCK_ROWS, keys: Sequence[str] = STREAM) -> DataFrame:
    """Counted timestamps with the gap ``dt`` to the one before."""
    return _intervals(msgs, block_rows, keys).drop(BLOCK)


def monotone(msgs: DataFrame, block_rows: int = BLOCK_ROWS, keys: Sequence[str] = STREAM) -> DataFrame:
    """Counted timestamps: late and duplicate source times are dropped."""
    return intervals(msgs, block_rows, keys).drop("dt")


def last_n(df: DataFrame, n: int, keys: Sequence[str] = STREAM, order: str = "arrival_seq") -> DataFrame:
    """The latest ``n`` rows per key. Each task first trims its own rows to ``n`` (window group limit)."""
    newest_first = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= n).drop("_rank")


def latest_stamps(stamped: DataFrame, window: int = DEFAULT_WINDOW, block_rows: int = LATEST_BLOCK_ROWS,
                  keys: Sequence[str] = STREAM) -> DataFrame:
    """The last ``window`` counted timestamps per stream, out of :func:`stamps`.

    A block raises the running maximum exactly when it holds at least one counted timestamp, so the newest
    ``window`` raising blocks are enough. The first pass moves one row per (stream, block); only rows of the
    chosen blocks are shuffled in the second.
    """
    window = window_size(window)
    blocked, raises = _raises(stamped, block_rows, keys)
    raising = raises.where(F.col("_carry").isNull() | (F.col("_own") > F.col("_carry")))
    chosen = last_n(raising, window, keys, order=BLOCK)
    return last_n(_kept(blocked, chosen, keys), window, keys, order="t").select(*keys, "t")


def summarize(latest: DataFrame, keys: Sequence[str] = STREAM) -> DataFrame:
    """Rate statistics of at most one window of counted timestamps per stream."""
    newest_first = W.partitionBy(*keys).orderBy(F.col("t").desc())
    step = (F.col("t") - F.lead("t").over(newest_first)) / NANOS
    mean, dt = F.avg("dt"), F.col("dt")
    return (latest.withColumn("dt", step).groupBy(*keys)
            .agg((1 / mean).alias("avg_hz"), (1 / F.max(dt)).alias("min_hz"), (1 / F.min(dt)).alias("max_hz"),
                 (F.stddev_pop(dt) / (mean * mean)).alias("stddev_hz"), F.count("*").alias("window"))
            .where("window >= 2"))


def hz(msgs: DataFrame, window: int = DEFAULT_WINDOW, block_rows: int = LATEST_BLOCK_ROWS,
       keys: Sequence[str] = STREAM) -> DataFrame:
    """Average, minimum, maximum and spread of the rate over the last ``window`` counted timestamps."""
    return summarize(latest_stamps(stamps(msgs, keys), window, block_rows, keys), keys)


def _tiles(msgs: DataFrame, window: int, block_rows: int, tile_rows: int, keys: Sequence[str]) -> DataFrame:
    """Counted rows at a dense position ``_k`` per stream, cut into tiles of ``tile_rows``.

    Each tile also gets the last ``window - 2`` rows of the tile before, so a frame never leaves its tile.
    """
    tile_rows = max(tile_rows, window)
    kept = _intervals(msgs, block_rows, keys)
    # counting a column the rows carry anyway keeps both uses of ``kept`` alike, so its shuffle is reused
    offsets = block_carry(kept.groupBy(*keys, BLOCK).agg(F.count("log_time_ns").alias("_own")), keys, F.sum)
    place = F.coalesce("_carry", F.lit(0)) + F.row_number().over(inside_block(keys, "arrival_seq")) - 1
    placed = (with_carry(kept, offsets, keys)
              .withColumn("_k", place).withColumn("_home", floor_div("_k", tile_rows)))
    in_halo = F.col("_k") % tile_rows >= tile_rows - (window - 2)
    return placed.withColumn("_tile", F.explode(
        F.when(in_halo, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))


_RATES = ["avg_hz", "min_hz", "max_hz", "stddev_hz"]
_REPORT = [*_RATES, "window"]
_SLAB = 4096
_FULL = (np.mean, np.max, np.min, np.std)
_SHORT = (np.nanmean, np.nanmax, np.nanmin, np.nanstd)


def _roll(tiles: DataFrame, window: int, keys: Sequence[str], every_ns: int = 0) -> DataFrame:
    """Rates over the ``window`` timestamps up to each row of a tile.

    A window function would go through every frame once per aggregate; numpy takes all frames of a slab at once.
    With ``every_ns`` only the last row of each report interval is worked out.
    """

    def rates_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_k")
        place = rows["_k"].to_numpy()
        wanted = (rows["_home"].to_numpy() == rows["_tile"].to_numpy()) & (place >= 1)
        if every_ns:
            tick = rows["log_time_ns"].to_numpy() // every_ns
            wanted &= np.append(tick[1:] != tick[:-1], True)
        at = np.flatnonzero(wanted)
        steps = rows["dt"].to_numpy().astype(np.float64) / NANOS  # NaN for a stream's first
        frames = sliding_window_view(np.append(np.full(window - 2, np.nan), steps), window - 1)
        out = np.empty((4, len(at)))
        early = int(np.searchsorted(place[at], window - 1))  # frames cut short by the stream's beginning
        for begin in [*range(0, early, _SLAB), *range(early, len(at), _SLAB)]:
            end = min(begin + _SLAB, early if begin < early else len(at))
            some = frames[at[begin:end]]
            mean, high, low, spread = (fold(some, axis=1) for fold in (_SHORT if begin < early else _FULL))
            out[:, begin:end] = 1 / mean, 1 / high, 1 / low, spread / (mean * mean)
        own = rows.take(at)
        return pa.table({
            **{name: own[name] for name in (*keys, "arrival_seq", "log_time_ns")},
            **dict(zip(_RATES, out)), "window": np.minimum(place[at] + 1, window)})

    kinds = dict(tiles.dtypes)
    schema = (", ".join(f"{name} {kinds[name]}" for name in keys) + ", arrival_seq bigint, log_time_ns bigint, "
              + ", ".join(f"{name} double" for name in _RATES) + ", window bigint")
    return tiles.groupBy(*keys, "_tile").applyInArrow(rates_of, schema)


def rolling_hz(msgs: DataFrame, window: int = DEFAULT_WINDOW, block_rows: int = BLOCK_ROWS,
               tile_rows: int = TILE_ROWS, keys: Sequence[str] = STREAM) -> DataFrame:
    """:func:`hz` as of every counted timestamp."""
    window = window_size(window)
    return _roll(_tiles(msgs, window, block_rows, tile_rows, keys), window, keys)


def hz_reports(msgs: DataFrame, every_ns: int = NANOS, window: int = DEFAULT_WINDOW, block_rows: int = BLOCK_ROWS,
               tile_rows: int = TILE_ROWS, repeat_idle: bool = False, keys: Sequence[str] = STREAM) -> DataFrame:
    """Statistics as of the end of each report interval in which the stream moved.

    ``repeat_idle`` also repeats a stream's last report for intervals without a new timestamp, up to the last
    interval of its own.
    """
    window = window_size(window)
    # an interval that runs over several tiles has a candidate in each
    rolled = _roll(_tiles(msgs, window, block_rows, tile_rows, keys), window, keys, every_ns)
    reports = (rolled.withColumn("tick", floor_div("log_time_ns", every_ns)).groupBy(*keys, "tick")
               .agg(F.max_by(F.struct(*_REPORT), "arrival_seq").alias("last"))
               .select(*keys, "tick", "last.*"))
    if not repeat_idle:
        return reports
    following = F.lead("tick").over(W.partitionBy(*keys).orderBy("tick"))
    return (reports.withColumn("_until", F.coalesce(following - 1, F.col("tick")))
            .withColumn("tick", F.explode(F.sequence("tick", "_until"))).drop("_until"))
