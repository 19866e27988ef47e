"""Bulk decoding of binary payloads into typed columns.

A batch is decoded column by column: every row has its own read position, and each member is read for all rows
of the batch at once. Fixed members, strings and sequences of primitives are single numpy gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.filters import topic_filter
from tidewire.functions.render import render_json
from tidewire.functions.scalars import sec_nsec
from tidewire.functions.wire import PRIMITIVES, Array, Enum, Primitive, Sequence, Struct, Text, Union, WireType, catalog
from tidewire.operators.blocks import join_keys
from tidewire.operators.ordering import first_n
from tidewire.operators.types import TypeTables
from tidewire.session import Scratch, scratch_path

# Second header byte -> (big endian, widest alignment, structs carry their size).
LAYOUTS = {
    0x00: (True, 8, False), 0x01: (False, 8, False),
    0x06: (True, 4, False), 0x07: (False, 4, False),
    0x08: (True, 4, True), 0x09: (False, 4, True),
}
MUTABLE = (0x0A, 0x0B)
HEADER = 4
# Payload bytes decoded at once: positions and copies take a multiple of them.
BATCH_BYTES = 32 << 20
TOO_SHORT, BAD_HEADER, UNSUPPORTED, MALFORMED = "too short", "bad header", "unsupported layout", "malformed"

_CHARS = pa.array([chr(code) for code in range(256)])


class _Cursor:
    """Read positions of a set of rows over one shared buffer."""

    def __init__(self, data, base, pos, end, ok, layout):
        self.data, self.base, self.pos, self.end, self.ok, self.layout = data, base, pos, end, ok, layout

    def __len__(self) -> int:
        return len(self.pos)

    def rows(self, index) -> _Cursor:
        return _Cursor(self.data, self.base[index], self.pos[index], self.end[index], self.ok[index], self.layout)

    def put_back(self, index, part: _Cursor) -> None:
        self.pos[index], self.ok[index] = part.pos, part.ok

    def align(self, width: int, where=True) -> None:
        step = min(width, self.layout[1])
        self.pos = np.where(where, self.pos + (self.base - self.pos) % step, self.pos)

    def claim(self, sizes) -> np.ndarray:
        """Start of the next ``sizes`` bytes of each row; rows that do not have them are marked."""
        self.ok &= (sizes >= 0) & (self.pos + sizes <= self.end)
        start = np.where(self.ok, self.pos, 0)
        self.pos = np.where(self.ok, self.pos + sizes, self.pos)
        return start

    def values(self, start, code: str) -> np.ndarray:
        dtype = np.dtype(code).newbyteorder(">" if self.layout[0] else "<")
        raw = sliding_window_view(self.data, dtype.itemsize)[start]
        return raw.view(dtype).reshape(len(start)).astype(dtype.newbyteorder("="), copy=False)

    def number(self, code: str) -> np.ndarray:
        width = np.dtype(code).itemsize
        self.align(width)
        return self.values(self.claim(np.int64(width)), code)

    def length(self) -> np.ndarray:
        return np.where(self.ok, self.number("u4").astype(np.int64), 0) * self.ok


def _spread(start, count, width=1) -> np.ndarray:
    """Positions ``start, start + width, ...``, ``count`` of them per row, all rows in one array."""
    before = np.cumsum(count) - count
    return np.repeat(start - before * width, count) + np.arange(int(count.sum())) * width


def _runs(data: np.ndarray, start, size) -> pa.Array:
    """``size`` bytes from ``start`` of each row as a column. Rows lie in the order of the buffer, so it is cut at their borders and the
    gaps are left out: whole runs are copied, without an index per byte."""
    ends = np.maximum.accumulate(np.where(size > 0, start + size, 0)) if len(size) else size
    begins = np.where(size > 0, start, ends)
    borders = np.stack([begins, ends], axis=1).ravel()
    low = int(borders[0]) if len(borders) else 0
    wide = len(borders) and int(borders[-1]) - low > 2**31 - 1
    offsets = (borders - low).astype(np.int64 if wide else np.int32)
    pieces = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), max(0, len(borders) - 1),
                                   [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[low:])])
    return pieces.take(pa.array(np.arange(0, max(0, len(borders) - 1), 2))).cast(pa.binary())


def _offsets(count) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(count))).astype(np.int32)


def _to_arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "boolean":
        return pa.array(values != 0)
    if kind == "char":
        return _CHARS.take(pa.array(values))
    return pa.array(values).cast(PRIMITIVES[kind][2])


def _text(cursor: _Cursor) -> pa.Array:
    size = cursor.length()
    start = cursor.claim(size)
    size = np.where(cursor.ok, np.maximum(size - 1, 0), 0)
    raw = _runs(cursor.data, start, size)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([_checked_text(cursor, row, value) for row, value in enumerate(raw.to_pylist())], pa.string())


def _checked_text(cursor: _Cursor, row: int, value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError:
        cursor.ok[row] = False
        return ""


def _literals(cursor: _Cursor, kind: Enum) -> pa.Array:
    codes, place = np.unique(cursor.number("i4"), return_inverse=True)
    names = dict(kind.literals)
    return pa.array([names.get(int(code), str(code)) for code in codes], pa.string()).take(pa.array(place))


def _items(cursor: _Cursor, kind: Sequence | Array) -> pa.Array:
    item = kind.item
    simple = isinstance(item, Primitive)
    if cursor.layout[1] == 4 and not simple:
        cursor.length()  # newer layouts put the byte size in front of non-primitive items
    if isinstance(kind, Array):
        count = np.where(cursor.ok, kind.length, 0)
    else:
        count = cursor.length()
        cursor.ok &= count <= cursor.end - cursor.pos
        count = np.where(cursor.ok, count, 0)
    if simple:
        code = PRIMITIVES[item.kind][0]
        width = np.dtype(code).itemsize
        cursor.align(width, count > 0)
        start = cursor.claim(count * width)
        count = np.where(cursor.ok, count, 0)
        if width == 1:
            body = _runs(cursor.data, start, count).buffers()[2]
            found = np.frombuffer(body, np.uint8)[:int(count.sum())] if body else np.empty(0, np.uint8)
        else:
            found = cursor.values(_spread(start, count, width), code)
        values = _to_arrow(found, item.kind)
    else:
        values, count = _nested_items(cursor, item, count)
    return pa.ListArray.from_arrays(_offsets(count), values, type=kind.arrow())


def _fixed_width(kind: WireType, layout) -> int | None:
    """The widest alignment inside a type whose items all take the same room, else nothing."""
    if isinstance(kind, Primitive):
        return min(np.dtype(PRIMITIVES[kind.kind][0]).itemsize, layout[1])
    if isinstance(kind, Enum):
        return min(4, layout[1])
    if isinstance(kind, Array) and isinstance(kind.item, Primitive) and kind.length:
        return _fixed_width(kind.item, layout)
    if isinstance(kind, Struct) and not layout[2] and kind.fields:
        widths = [_fixed_width(field, layout) for _, field in kind.fields]
        return None if None in widths else max(widths)
    return None


def _nested_items(cursor: _Cursor, item: WireType, count) -> tuple[pa.Array, np.ndarray]:
    """Items that are not primitive: the first of every row, then the second of every row that has one, ...

    Items of a type of fixed size come at one distance from the second on, so all that are left are read in a single step.
    """
    parts, owners, nth = [], [], 0
    width = _fixed_width(item, cursor.layout)
    index = np.flatnonzero(count > 0)
    while len(index):
        part = cursor.rows(index)
        before = part.pos.copy()
        parts.append(_value(part, item))
        owners.append(index)
        cursor.put_back(index, part)
        nth += 1
        step = cursor.pos[index] - before
        more = (count[index] > nth) & cursor.ok[index]
        index, step = index[more], step[more]
        if width and nth == 2 and len(index) and not (step % width).any():
            left = count[index] - nth
            rest = cursor.rows(np.repeat(index, left))
            rest.pos = _strided(cursor.pos[index], left, step)
            parts.append(_value(rest, item))
            owners.append(np.repeat(index, left))
            cursor.pos[index] += left * step
            cursor.ok[index] &= np.logical_and.reduceat(rest.ok, np.cumsum(left) - left)
            break
    if not parts:
        return pa.array([], item.arrow()), np.zeros_like(count)
    owner = np.concatenate(owners)
    read = np.bincount(owner, minlength=len(cursor))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable"))), read


def _strided(start, count, step) -> np.ndarray:
    """Positions ``start, start + step, ...`` of each row, ``count`` of them."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + nth * np.repeat(step, count)


def _struct(cursor: _Cursor, kind: Struct) -> pa.Array:
    size = cursor.length() if cursor.layout[2] else None
    begin = cursor.pos
    children = [_value(cursor, field) for _, field in kind.fields]
    if size is not None:  # skip members a newer sender appended
        cursor.ok &= (cursor.pos <= begin + size) & (begin + size <= cursor.end)
        cursor.pos = np.where(cursor.ok, begin + size, cursor.pos)
    return pa.StructArray.from_arrays(children, fields=list(kind.arrow()))


def _union(cursor: _Cursor, kind: Union) -> pa.Array:
    if cursor.layout[2]:
        cursor.length()
    disc = kind.discriminator
    tag = cursor.number("i4" if isinstance(disc, Enum) else PRIMITIVES[disc.kind][0]).astype(np.int32)
    children = [pa.array(tag)]
    for labels, _, case in kind.cases:
        index = np.flatnonzero(np.isin(tag, labels) & cursor.ok)
        part = cursor.rows(index)
        values = _value(part, case)
        cursor.put_back(index, part)
        place = np.full(len(tag), -1)
        place[index] = np.arange(len(index))
        children.append(values.take(pa.array(place, mask=place < 0)))
    return pa.StructArray.from_arrays(children, fields=list(kind.arrow()))


def _value(cursor: _Cursor, kind: WireType) -> pa.Array:
    if isinstance(kind, Primitive):
        return _to_arrow(cursor.number(PRIMITIVES[kind.kind][0]), kind.kind)
    if isinstance(kind, Text):
        return _text(cursor)
    if isinstance(kind, Enum):
        return _literals(cursor, kind)
    if isinstance(kind, Struct):
        return _struct(cursor, kind)
    if isinstance(kind, Union):
        return _union(cursor, kind)
    return _items(cursor, kind)


def decode_batch(payloads: pa.Array, kind: Struct) -> tuple[pa.Array, pa.Array]:
    """Decoded structs and, where decoding failed, the reason."""
    payloads = payloads.cast(pa.binary())
    if payloads.null_count:
        payloads = payloads.fill_null(b"")
    rows = len(payloads)
    bounds = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset:payloads.offset + rows + 1].astype(np.int64)
    body = payloads.buffers()[2]
    own = np.frombuffer(body, np.uint8)[bounds[0]:bounds[-1]] if body else np.empty(0, np.uint8)
    data, bounds = np.concatenate((own, np.zeros(16, np.uint8))), bounds - bounds[0]
    start, end = bounds[:-1], bounds[1:]
    long_enough = end - start > HEADER
    code = np.where(long_enough & (data[start] == 0), data[np.minimum(start + 1, len(data) - 1)], 0xFF)
    error = np.where(long_enough, BAD_HEADER, TOO_SHORT).astype(object)
    error[np.isin(code, MUTABLE)] = UNSUPPORTED
    parts, places = [], []
    for layout_code, layout in LAYOUTS.items():
        index = np.flatnonzero(code == layout_code)
        if not len(index):
            continue
        begin = start[index] + HEADER
        cursor = _Cursor(data, begin, begin, end[index], np.ones(len(index), bool), layout)
        parts.append(_value(cursor, kind))
        places.append(index)
        error[index] = np.where(cursor.ok, None, MALFORMED)
    place = np.full(rows, -1)
    if not parts:
        return pa.nulls(rows, kind.arrow()), pa.array(error, pa.string())
    found = np.concatenate(places)
    place[found] = np.arange(len(found))
    failed = pa.array(error, pa.string())
    place[~np.equal(error, None)] = -1
    return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0)), failed


def bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose binary column holds about ``BATCH_BYTES`` at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows or low == batch.num_rows == 0:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield batch.slice(low, high - low)
            low = high


def decode_tagged(df: DataFrame, kind: Struct, payload: str = "payload") -> DataFrame:
    """All rows with ``decoded`` (null where it failed) and ``error``."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, names.index(payload)):
            decoded, error = decode_batch(batch.column(names.index(payload)), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded, error], names=[*names, "decoded", "error"])

    schema = T.StructType(df.schema.fields + [
        T.StructField("decoded", kind.spark()), T.StructField("error", T.StringType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, kind: Struct, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Decoded rows, members as columns in place of the payload; and the rows that failed, with the reason."""
    tagged = decode_tagged(df, kind, payload)
    good = tagged.where(F.col("error").isNull()).select(
        *[name for name in df.columns if name != payload], "decoded.*")
    return good, tagged.where(F.col("error").isNotNull()).drop("decoded")


def echo(msgs: DataFrame, topic: str, kind: Struct, n: int = 0) -> DataFrame:
    """The first ``n`` valid messages of a topic (0 = all) with their source time and their value as JSON; a message
    that cannot be decoded keeps its row, with the reason."""
    own = msgs.where(topic_filter([topic]) & F.col("valid")).select("arrival_seq", "source_time_ns", "payload")
    tagged = decode_tagged(first_n(own, n), kind)
    value = tagged.select("decoded.*")
    members = {name: F.col(f"decoded.{name}") for name in value.columns}
    lifted = tagged.withColumns(members)
    text = F.when(F.col("error").isNull(), render_json(lifted, value.columns))
    return lifted.select("arrival_seq", sec_nsec("source_time_ns").alias("stamp"), text.alias("json"), "error")


def decode_all(df: DataFrame, kinds: dict[str, Struct], type_column: str = "type_name",
               payload: str = "payload") -> dict[str, tuple[DataFrame, DataFrame]]:
    """Decodes a table of mixed types: one pair of outputs per type of ``kinds``, as of :func:`decode`.

    The table is read and decoded once, whatever the number of types. The result is stored in a folder per type, each row with
    the struct of its own type alone, and every output reads its folder. Rows of other types are in no output here;
    :func:`decode_discovered` returns them too.
    """
    names, values = df.columns, {name: f"_value_{place}" for place, name in enumerate(kinds)}
    at_type, at_payload = names.index(type_column), names.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at_payload):
            types, body = batch.column(at_type), batch.column(at_payload)
            error, columns = pa.nulls(batch.num_rows, pa.string()), []
            for name, kind in kinds.items():
                own = np.flatnonzero(pc.equal(types, name).to_numpy(zero_copy_only=False))
                if not len(own):
                    columns.append(pa.nulls(batch.num_rows, kind.arrow()))
                    continue
                place = np.full(batch.num_rows, -1)
                place[own] = np.arange(len(own))
                back = pa.array(place, mask=place < 0)
                decoded, failed = decode_batch(body.take(pa.array(own)), kind)
                columns.append(decoded.take(back))
                error = pc.coalesce(error, failed.take(back))
            kept = [column for name, column in zip(names, batch.columns) if name != payload]
            # a payload is only needed again where it could not be read
            unread = pc.if_else(pc.is_valid(error), body, pa.scalar(None, body.type))
            yield pa.RecordBatch.from_arrays([*kept, unread, *columns, error], names=tagged.fieldNames())

    fields = [field for field in df.schema.fields if field.name != payload] + [df.schema[payload]]
    tagged = T.StructType(fields + [T.StructField(values[name], kind.spark()) for name, kind in kinds.items()]
                          + [T.StructField("error", T.StringType())])
    path = scratch_path(df.sparkSession, "decoded")
    (df.where(F.col(type_column).isin(*kinds)).mapInArrow(run, tagged)
     .write.partitionBy(type_column).parquet(path))
    every = df.sparkSession.read.schema(tagged).parquet(path)
    out = {}
    for name, value in values.items():
        own = every.where(F.col(type_column) == name)
        good = own.where(F.col("error").isNull()).select(*[n for n in names if n != payload], f"{value}.*")
        out[name] = good, own.where(F.col("error").isNotNull()).select(*names, "error")
    return out


def decode_discovered(msgs: DataFrame, topic_types: DataFrame, types: TypeTables,
                      payload: str = "payload") -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
    """Decodes messages by the type their topic was announced with, as described by the type tables.

    ``topic_types`` has a type per topic. Decoders are built on the driver out of the types in use and what they need, a few rows per
    type; each row's is chosen by its topic. The types of the topics in use are stored first, so that their measured size decides how
    messages find them: sent by topic, all messages of a topic would meet in one task. Returns :func:`decode_all` of all types that are described, and the rows of all
    others with a ``problem``, so every message is in exactly one output.
    """
    in_use = Scratch(msgs.sparkSession, "topics").keep(
        join_keys(msgs.select("topic").distinct(), topic_types.select("topic", "type_name"), ["topic"]))
    used = in_use.select("type_name").distinct()
    names = [row["type_name"] for row in used.where("type_name is not null and type_name <> ''").collect()]
    known = {name: kind for name, kind in catalog(names, *types, skip_unknown=True).items() if isinstance(kind, Struct)}
    typed = join_keys(msgs.drop("type_name"), in_use, ["topic"], "left")
    described = F.coalesce(F.col("type_name").isin(*known), F.lit(False)) if known else F.lit(False)
    unknown = typed.where(~described).withColumn("problem", F.when(
        F.coalesce(F.col("type_name"), F.lit("")) == "", "topic without a type").otherwise(F.concat(F.lit("no description of "), "type_name")))
    return decode_all(typed, known, payload=payload) if known else {}, unknown
