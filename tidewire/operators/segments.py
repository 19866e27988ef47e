"""Greedy cuts of an ordered stream: start a new segment when a byte or time limit is reached, then count
afresh. The result depends on every earlier cut, so it is no plain window; yet no task goes through a whole stream:

1. Blocks of equal depth, each with its place and the bytes before it. A stream of one block is cut in one task.
2. Per block: the segments that can be open at its end, and in which later block each of them is cut. That block looks up the row.
   Rows that are looked up are the *entries* of their block; each leads to one entry of a later block.
3. The path from the stream's first row along these pointers is marked: in a task where a stream has few of them, else by doubling
   the pointers with joins and marking the longest jumps first. A block on the path is entered once, which gives the segment
   open at the beginning of every block.
4. Per block: mark where segments begin. A window inside the block hands the markers on to the rows.

Steps 2 and 4 run on all blocks at once, step 3 takes at most log2(blocks) joins of the entries. Entries of a block are no more than
the rows of its first segment, so they are few where a block holds several segments, and rows of a table where it does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.operators.blocks import BLOCK, equal_blocks, join_keys
from tidewire.session import Scratch

SEGMENT_BLOCK_ROWS = 1 << 18
_NEVER = np.int64(2**62)
PATH_ROWS = 1 << 20
_MARK = ["segment", "_base", "segment_start"]


class _Cuts:
    """Where each segment of a block would end, had it begun at a given row."""

    def __init__(self, size, clock, target: int, span: int, close_before: bool):
        self.size_of = np.concatenate(([0], np.cumsum(size)))
        # bytes a limit is compared with when a row arrives: with or without the row itself
        self.seen = self.size_of[1:] if close_before else self.size_of[:-1]
        self.clock, self.target, self.span = clock, target, span
        rows = len(size)
        self.following = np.maximum(self._reach(self.size_of[:-1], clock), np.arange(1, rows + 1))

    def _reach(self, size_at_start, clock_at_start):
        ends = np.full(np.shape(size_at_start), len(self.seen), dtype=np.int64)
        if self.target:
            ends = np.minimum(ends, np.searchsorted(self.seen, size_at_start + self.target))
        if self.span:
            ends = np.minimum(ends, np.searchsorted(self.clock, clock_at_start + self.span))
        return ends

    def first_cut(self, open_size: int, open_clock: int) -> int:
        """Row of the first cut for a segment already open at the block start; the row count if none."""
        return int(self._reach(np.int64(-open_size), np.int64(open_clock)))

    def tails(self) -> tuple[np.ndarray, np.ndarray]:
        """For a cut at each row: the last cut of the block that follows from it, and how many cuts there are up to that one."""
        rows = len(self.seen)
        jump = np.where(self.following < rows, self.following, np.arange(rows))
        more = (self.following < rows).astype(np.int64)
        while True:
            onward = jump[jump]
            if np.array_equal(onward, jump):
                return jump, more + 1
            more = more + more[jump]
            jump = onward

    def markers(self, segment: int, open_size: int, open_clock: int, fresh: bool):
        """Rows where a segment begins, and the first row: the segment, what to add to the bytes before a row in the
        block to get those before it in the segment, and the segment's start."""
        cut = 0 if fresh else self.first_cut(open_size, open_clock)
        at = []
        while cut < len(self.seen):
            at.append(cut)
            cut = int(self.following[cut])
        at = np.array(at, np.int64)
        number = segment + np.arange(len(at)) + (0 if fresh else 1)
        base, begin = -self.size_of[at], self.clock[at]
        if not len(at) or at[0] > 0:
            at, number = np.append(0, at), np.append(segment, number)
            base, begin = np.append(open_size, base), np.append(open_clock, begin)
        return at, number, base, begin


_STATE = ["segment", "open_size", "open_clock", "fresh"]
_PROBE = ["tail", "by_size", "by_clock", BLOCK, "_next", "_next_place"]


def _reached(ends: np.ndarray, until: np.ndarray, by_size, by_clock) -> np.ndarray:
    """The first block at whose end one of the limits has been reached; the number of blocks if none."""
    return np.minimum(np.searchsorted(ends, by_size), np.searchsorted(until, by_clock))


class _Limits:
    """The limits of one call; what is absolute counts from a stream's first row."""

    def __init__(self, keys: list[T.StructField], target: int, span: int, close_before: bool):
        self.fields, self.keys = keys, [field.name for field in keys]
        self.target, self.span, self.close_before = target, span, close_before

    def schema(self, *names: str) -> T.StructType:
        return T.StructType([*self.fields, *[T.StructField(name, T.LongType()) for name in names]])

    def cuts(self, rows: pa.Table) -> _Cuts:
        return _Cuts(rows["_size"].to_numpy(), rows["_clock"].to_numpy(), self.target, self.span, self.close_before)

    def thresholds(self, size, clock) -> tuple[np.ndarray, np.ndarray]:
        """When a segment that begins after ``size`` bytes at ``clock`` is full and when it is old."""
        size, clock = np.asarray(size, np.int64), np.asarray(clock, np.int64)
        return (size + self.target if self.target else np.full(size.shape, _NEVER),
                clock + self.span if self.span else np.full(clock.shape, _NEVER))

    def head(self, rows: pa.Table, count: int) -> dict[str, pa.ChunkedArray]:
        return {name: rows[name].take(pa.array(np.zeros(count, np.int64))) for name in self.keys}

    def look_ahead(self, rows: pa.Table) -> pa.Table:
        """Per block of a stream, the later blocks that can cut a segment open at its end, and one more; for an opened stream also what
        cuts the segment it goes on with. Blocks only, never rows."""
        rows = rows.sort_by(BLOCK)
        block, place, before, until = (rows[name].to_numpy() for name in (BLOCK, "_place", "_before", "_until"))
        ends = before + rows["_bytes"].to_numpy()
        first = np.maximum(_reached(ends, until, *self.thresholds(before, rows["_from"].to_numpy())), np.arange(len(block)) + 1)
        last = np.minimum(_reached(ends, until, *self.thresholds(ends, until)) + 2, len(block))
        spans = [slice(a, max(a, b)) for a, b in zip(first.tolist(), last.tolist())]
        return rows.select([*self.keys, BLOCK, "_place", "_before"]).append_column("ahead", pa.array(
            [[{"block": int(block[i]), "place": int(place[i]), "end": int(ends[i]), "until": int(until[i])} for i in range(s.start, s.stop)]
             for s in spans], _AHEAD))

    def opened(self, rows: pa.Table) -> pa.Table:
        """Where the segment a stream goes on with is cut: a probe with the tail -1."""
        rows = rows.sort_by(BLOCK)
        block, place = rows[BLOCK].to_numpy(), rows["_place"].to_numpy()
        ends = rows["_before"].to_numpy() + rows["_bytes"].to_numpy()
        by_size, by_clock = self.thresholds([-rows["open_size"][0].as_py()], [rows["open_clock"][0].as_py()])
        at = _reached(ends, rows["_until"].to_numpy(), by_size, by_clock)
        return self._probes(rows, np.array([-1]), by_size, by_clock, at, block, place)

    def _probes(self, rows: pa.Table, tails, by_size, by_clock, at, block, place) -> pa.Table:
        """Probes of the tails that are cut in one of the given blocks, with the block after it where there is one."""
        held = at < len(block)
        at, follows = at[held], at[held] + 1
        after = np.minimum(follows, len(block) - 1)
        none = follows >= len(block)
        numbers = [tails[held], by_size[held], by_clock[held], block[at], pa.array(block[after], mask=none), pa.array(place[after], mask=none)]
        return pa.table({**self.head(rows, len(at)), **dict(zip(_PROBE, map(pa.array, numbers)))})

    def leave(self, rows: pa.Table) -> pa.Table:
        """The segments that can be open at a block's end, and the blocks that cut them."""
        rows = rows.sort_by("_order")
        cuts, place, before = self.cuts(rows), rows["_place"][0].as_py(), rows["_before"][0].as_py()
        ahead = rows["ahead"][0].as_py()
        block, places, ends, until = (np.array([a[name] for a in ahead], np.int64) for name in ("block", "place", "end", "until"))
        jump, _ = cuts.tails()
        tails = np.unique(jump[:min(int(cuts.following[0]) + 1, len(jump))])
        by_size, by_clock = self.thresholds(before + cuts.size_of[tails], cuts.clock[tails])
        return self._probes(rows, place + tails, by_size, by_clock, _reached(ends, until, by_size, by_clock), block, places)

    def look_up(self, key, probes: pa.Table, rows: pa.Table) -> pa.Table:
        """The rows at which probes find their limits: of this block, or the first of the next one."""
        rows = rows.sort_by("_order_")
        cuts = _Cuts(rows["_size_"].to_numpy(), rows["_clock_"].to_numpy(), self.target, self.span, self.close_before)
        place, before = rows["_place_"][0].as_py(), rows["_before_"][0].as_py()
        at = _reached(before + cuts.seen, cuts.clock, probes["by_size"].to_numpy(), probes["by_clock"].to_numpy())
        inside = at < len(cuts.seen)
        entry = pc.if_else(inside, pa.array(place + at), probes["_next_place"])
        there = pc.if_else(inside, probes[BLOCK], probes["_next"])
        found = pa.table({**{name: probes[name] for name in self.keys}, "tail": probes["tail"], "entry": entry, BLOCK: there})
        return found.filter(pc.is_valid(found["entry"]))

    def enter(self, key, entries: pa.Table, rows: pa.Table) -> pa.Table:
        """What follows from each entry inside its block: the last cut, how many there are, and what the segment open at the end counts from."""
        rows = rows.sort_by("_order_")
        cuts = _Cuts(rows["_size_"].to_numpy(), rows["_clock_"].to_numpy(), self.target, self.span, self.close_before)
        place, before = rows["_place_"][0].as_py(), rows["_before_"][0].as_py()
        at = entries["entry"].to_numpy() - place
        jump, count = cuts.tails()
        tail = jump[at]
        return pa.table({**{name: entries[name] for name in self.keys}, "entry": entries["entry"], BLOCK: entries[BLOCK], "tail": place + tail,
                         "cuts": count[at], "tail_before": before + cuts.size_of[tail], "tail_clock": cuts.clock[tail]})


_AHEAD = pa.list_(pa.struct([(name, pa.int64()) for name in ("block", "place", "end", "until")]))


def _followed(pointers: pa.Table, keys: list[str]) -> pa.Table:
    """The entries on the path of one stream, whose pointers are few enough for a task."""
    entry, onward = pointers["entry"].to_numpy(), pointers["onward"].to_numpy()
    order = np.argsort(entry)
    entry, onward = entry[order], onward[order]
    path, at = [], int(entry[0]) if len(entry) and entry[0] <= 0 else None
    while at is not None:
        path.append(at)
        place = int(np.searchsorted(entry, at))
        at = int(onward[place]) if place < len(entry) and entry[place] == at else None
    head = {name: pointers[name].take(pa.array(np.zeros(len(path), np.int64))) for name in keys}
    return pa.table({**head, "entry": pa.array(path, pa.int64())})


def _path(pointers: DataFrame, starts: DataFrame, limits: _Limits, scratch: Scratch) -> DataFrame:
    """The entries on the paths from ``starts`` (entry 0, or -1 before it) along ``pointers`` (entry, onward).

    Streams of up to ``PATH_ROWS`` pointers are followed in a task each; if one has more, all are, by pointer doubling.
    """
    keys = limits.keys
    if not pointers.groupBy(*keys).count().where(F.col("count") > PATH_ROWS).limit(1).count():
        followed = pointers.groupBy(*keys).applyInArrow(lambda rows: _followed(rows, limits.keys), limits.schema("entry"))
        return followed.unionByName(starts).distinct()
    jumps = [pointers]
    while True:
        second = jumps[-1].select(*keys, F.col("entry").alias("onward"), F.col("onward").alias("_then"))
        longer = scratch.keep(join_keys(jumps[-1], second, [*keys, "onward"]).select(*keys, "entry", F.col("_then").alias("onward")))
        if not longer.where("entry <= 0").limit(1).count():
            scratch.drop(longer)
            break
        jumps.append(longer)
    marked = starts
    for jump in reversed(jumps):
        onward = join_keys(marked, jump, [*keys, "entry"]).select(*keys, F.col("onward").alias("entry"))
        before, marked = marked, scratch.keep(marked.unionByName(onward))
        if before is not starts:
            scratch.drop(before)
    scratch.drop(*jumps)
    return marked


def _states(blocked: DataFrame, frames: DataFrame, limits: _Limits, scratch: Scratch) -> DataFrame:
    """The blocks with the segment that is open where each begins: ``_STATE``."""
    keys, block_keys = limits.keys, [*limits.keys, BLOCK]
    first = F.col("_place") == 0
    simple = frames.withColumns({
        "open_size": F.coalesce("open_size", F.lit(0)), "open_clock": F.coalesce("open_clock", "_from"),
        "fresh": F.col("segment").isNull(), "segment": F.coalesce("segment", F.lit(0))}).select(*block_keys, *_STATE)
    if not frames.where(~first).limit(1).count():
        return simple
    several = frames.where("_blocks > 1")
    ahead = T.StructType([*limits.schema(BLOCK, "_place", "_before").fields, T.StructField("ahead", T.ArrayType(T.StructType(
        [T.StructField(name, T.LongType()) for name in ("block", "place", "end", "until")])))])
    routes = scratch.keep(several.groupBy(*keys).applyInArrow(lambda rows: limits.look_ahead(rows), ahead))
    narrow = blocked.select(*block_keys, "_order", "_size", "_clock")
    probes = (join_keys(narrow, routes.where(F.size("ahead") > 0), block_keys).groupBy(*block_keys)
              .applyInArrow(lambda rows: limits.leave(rows), limits.schema(*_PROBE)))
    going_on = several.where(F.col("segment").isNotNull()).groupBy(*keys).applyInArrow(lambda rows: limits.opened(rows), limits.schema(*_PROBE))
    probes = probes.unionByName(going_on)
    placed = join_keys(narrow, routes.drop("ahead"), block_keys)
    # new names: a cogroup drops columns of its right side that are also on the left
    right = placed.select(*[F.col(name).alias(f"{name}_") for name in placed.columns]).groupBy(*[f"{name}_" for name in block_keys])

    def beside(left: DataFrame, work, schema: T.StructType) -> DataFrame:
        """``work`` on the rows of ``left`` and those of their block."""
        return left.groupBy(*block_keys).cogroup(right).applyInArrow(
            lambda key, mine, rows: work(key, mine, rows) if mine.num_rows and rows.num_rows else _empty(schema), schema)

    found = scratch.keep(beside(probes, limits.look_up, limits.schema("tail", "entry", BLOCK)))
    starts = several.where(first & F.col("segment").isNull()).select(*keys, F.lit(0).cast("long").alias("entry"), BLOCK)
    entries = found.select(*keys, "entry", BLOCK).unionByName(starts).distinct()
    entered = scratch.keep(beside(entries, limits.enter, limits.schema("entry", BLOCK, "tail", "cuts", "tail_before", "tail_clock")))
    onward = found.select(*keys, "tail", F.col("entry").alias("onward"))
    pointers = join_keys(entered.select(*keys, "entry", "tail"), onward, [*keys, "tail"]).select(*keys, "entry", "onward")
    opened = onward.where("tail = -1").select(*keys, F.col("tail").alias("entry"), "onward")
    begun = starts.select(*keys, "entry").unionByName(
        several.where(first & F.col("segment").isNotNull()).select(*keys, F.lit(-1).cast("long").alias("entry")))
    path = _path(scratch.keep(pointers.unionByName(opened)), begun, limits, scratch)
    taken = join_keys(entered, path, [*keys, "entry"]).select(*block_keys, "cuts", "tail_before", "tail_clock")
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("cuts").isNotNull(), F.struct("tail_before", "tail_clock")), ignorenulls=True).over(earlier)
    states = join_keys(several, taken, block_keys, "left").withColumns({
        "_open": last, "_cuts": F.coalesce(F.sum("cuts").over(earlier), F.lit(0))})
    states = states.select(
        *block_keys, (F.coalesce("segment", F.when(first, F.lit(0)).otherwise(-1)) + F.col("_cuts")).cast("long").alias("segment"),
        F.coalesce(F.col("_before") - F.col("_open.tail_before"), F.col("_before") + F.coalesce("open_size", F.lit(0))).alias("open_size"),
        F.coalesce("_open.tail_clock", "open_clock", "_from").alias("open_clock"),
        (first & F.col("segment").isNull()).alias("fresh"))
    return join_keys(simple, several.select(*block_keys), block_keys, "left_anti").unionByName(states)


def _empty(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def greedy_segments(units: DataFrame, keys: list[str], order: str, size: str, *, target: int = 0,
                    clock: str | None = None, span: int = 0, close_before: bool = False,
                    block_rows: int = SEGMENT_BLOCK_ROWS, opened: DataFrame | None = None) -> DataFrame:
    """The units with ``segment``, the bytes before them in it (``offset``) and its ``segment_start``.

    ``target`` limits the bytes and ``span`` the time (on ``clock``, which must not fall along ``order``); 0 is
    no limit. A segment is cut before a unit once the bytes already in it reach ``target``, or, with
    ``close_before``, once they would reach it with the unit. ``opened`` may hold one row per key with
    ``segment, open_size, open_clock`` to go on with a segment left open by earlier units. Null keys are a key like any other.
    """
    clock_column = F.col(clock) if clock else F.lit(0)
    scratch = Scratch(units.sparkSession, "segments")
    numbered = units.withColumns({"_order": F.col(order).cast("long"), "_size": F.coalesce(F.col(size).cast("long"), F.lit(0)),
                                  "_clock": clock_column.cast("long")}).where("_order is not null")
    block_keys = [*keys, BLOCK]
    blocked, table = equal_blocks(numbered, keys, "_order", block_rows, {
        "_bytes": (F.col("_size"), F.sum), "_from": (F.col("_clock"), F.min), "_until": (F.col("_clock"), F.max)}, scratch)
    limits = _Limits([numbered.schema[name] for name in keys], target, span if clock else 0, close_before)
    whole, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    frames = table.withColumns({"_place": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
                                "_before": F.coalesce(F.sum("_bytes").over(before), F.lit(0)), "_blocks": F.count("*").over(whole)})
    if opened is None:
        frames = frames.withColumns({name: F.lit(None).cast("long") for name in _STATE[:3]})
    else:
        frames = join_keys(frames, opened.select(*keys, *_STATE[:3]), keys, "left")
    states = _states(blocked, frames, limits, scratch)

    def mark(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_order")
        at, *facts = limits.cuts(rows).markers(*[rows[name][0].as_py() for name in _STATE])
        own = rows.take(at)
        return pa.table({**{name: own[name] for name in block_keys}, order: own["_order"], **dict(zip(_MARK, facts))})

    narrow = blocked.select(*block_keys, "_order", "_size", "_clock")
    marks = (join_keys(narrow, states, block_keys).groupBy(*block_keys)
             .applyInArrow(mark, limits.schema(BLOCK, order, *_MARK)))
    return _number(blocked.drop("_order", "_size", "_clock"), marks, block_keys, order, size)


def _number(rows: DataFrame, marks: DataFrame, block_keys: list[str], order: str, size: str) -> DataFrame:
    """Each row takes over the last marker at or before it in its block. Markers are few, one per segment and block,
    and travel in the same shuffle as the rows."""
    both = (rows.withColumn("_is_row", F.lit(True))
            .unionByName(marks.withColumn("_is_row", F.lit(False)), allowMissingColumns=True))
    in_block = W.partitionBy(*block_keys).orderBy(order, "_is_row")
    so_far = in_block.rowsBetween(W.unboundedPreceding, 0)
    earlier = in_block.rowsBetween(W.unboundedPreceding, -1)
    return (both.withColumns({
        **{name: F.last(name, ignorenulls=True).over(so_far) for name in _MARK},
        "_before": F.coalesce(F.sum(size).over(earlier), F.lit(0)),
    }).where("_is_row").withColumn("offset", F.col("_before") + F.col("_base"))
        .drop("_is_row", "_before", "_base", BLOCK))
