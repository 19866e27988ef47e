"""Test-only encoder of payloads, the opposite of ``tidewire.operators.decode``."""

from __future__ import annotations

import struct

import pyarrow as pa

from tidewire.functions.wire import PRIMITIVES, Array, Enum, Primitive, Sequence, Struct, Text, Union

_CODES = {"u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "i8": "q", "u8": "Q", "f4": "f", "f8": "d"}


def encode(value, kind, header: int = 1) -> bytes:
    big = header % 2 == 0
    version2, delimited = header >= 6, header in (8, 9)
    out = bytearray()
    order = ">" if big else "<"

    def align(width):
        step = min(width, 4 if version2 else 8)
        out.extend(b"\0" * (-len(out) % step))

    def number(code, x):
        align(struct.calcsize(code))
        out.extend(struct.pack(order + code, x))

    def sized(write):
        number("I", 0)
        at = len(out)
        write()
        struct.pack_into(order + "I", out, at - 4, len(out) - at)

    def put(x, t):
        if isinstance(t, Primitive):
            if t.kind == "char":
                x = ord(x)
            number(_CODES[PRIMITIVES[t.kind][0]], int(x) if t.kind == "boolean" else x)
        elif isinstance(t, Text):
            raw = x if isinstance(x, bytes) else x.encode()
            number("I", len(raw) + 1)
            out.extend(raw + b"\0")
        elif isinstance(t, Enum):
            number("i", x)
        elif isinstance(t, Struct):
            sized(lambda: fields(x, t)) if delimited else fields(x, t)
        elif isinstance(t, Union):
            sized(lambda: union(x, t)) if delimited else union(x, t)
        else:
            def items():
                if isinstance(t, Sequence):
                    number("I", len(x))
                for item in x:
                    put(item, t.item)
            sized(items) if version2 and not isinstance(t.item, Primitive) else items()

    def fields(x, t):
        for name, kind in t.fields:
            put(x[name], kind)

    def union(x, t):
        tag, case = x
        number("i" if isinstance(t.discriminator, Enum) else _CODES[PRIMITIVES[t.discriminator.kind][0]], tag)
        for labels, _, kind in t.cases:
            if tag in labels:
                put(case, kind)

    assert not isinstance(kind, Array)
    put(value, kind)
    return bytes([0, header, 0, 0]) + bytes(out)


def encode_column(kind: Struct, header_of):
    """mapInArrow function: adds ``payload`` made from the columns the type names."""
    names = [name for name, _ in kind.fields]

    def run(batches):
        for batch in batches:
            rows = batch.select(names).to_pylist()
            payload = pa.array([encode(row, kind, header_of(i)) for i, row in enumerate(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, payload], names=[*batch.schema.names, "payload"])

    return run
