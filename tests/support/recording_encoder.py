"""Test-only writer of small recording files in the public format."""

from __future__ import annotations

import struct
from itertools import islice

import pyarrow as pa

MAGIC = b"\x89MCAP0\r\n"


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def _pairs(entries: list[bytes]) -> bytes:
    raw = b"".join(entries)
    return struct.pack("<I", len(raw)) + raw


def _record(tag: int, body: bytes) -> bytes:
    return struct.pack("<BQ", tag, len(body)) + body


def encode_file(messages, channels, schemas, **options) -> bytes:
    """A whole file, see :func:`encoded`."""
    return b"".join(encoded(messages, channels, schemas, **options))


def _slices(items, step: int):
    items = iter(items)
    while held := list(islice(items, step)):
        yield held


def encoded(messages, channels, schemas, *, chunk_rows=10, compression="", summary=True, repeat_dims=True,
            message_index=True, statistics=True, chunked=True, attachments=(), metadata=()):
    """The pieces of a file in order, the footer last. ``messages``: (channel_id, sequence, log_time, payload); ``channels``: id ->
    (topic, encoding, schema_id, metadata); ``schemas``: id -> (name, encoding, data).

    Any iterable will do for the messages: one chunk of them is held at a time. Channels and schemas may be added while they are
    iterated, and attachments and metadata are asked for after the last of them.
    """
    size = 0

    def put(data: bytes) -> bytes:
        nonlocal size
        size += len(data)
        return data

    def dim(kind: str, key: int) -> bytes | None:
        if kind == "s" and key in schemas:
            name, encoding, data = schemas[key]
            return _record(3, struct.pack("<H", key) + _text(name) + _text(encoding) + struct.pack("<I", len(data)) + data)
        if kind == "c" and key in channels:
            topic, encoding, schema_id, meta = channels[key]
            return _record(4, struct.pack("<HH", key, schema_id) + _text(topic) + _text(encoding)
                           + _pairs([_text(k) + _text(v) for k, v in meta.items()]))
        return None

    yield put(MAGIC + _record(1, _text("") + _text("test")))
    written, indexes, counts, used = set(), [], {}, {"s": set(), "c": set()}
    total, first, last = 0, None, None
    for part in _slices(messages, chunk_rows if chunked else 1 << 12):
        body, index = bytearray(), {}
        for channel_id, sequence, log_time, payload in part:
            schema_id = channels[channel_id][2] if channel_id in channels else 0
            for key in (("s", schema_id), ("c", channel_id)):
                if key not in written and (record := dim(*key)) is not None:
                    body += record
                    written.add(key)
                    used[key[0]].add(key[1])
            index.setdefault(channel_id, []).append((log_time, len(body)))
            counts[channel_id] = counts.get(channel_id, 0) + 1
            body += _record(5, struct.pack("<HIQQ", channel_id, sequence, log_time, log_time) + payload)
        times = [message[2] for message in part]
        low, high = min(times), max(times)
        total, first, last = total + len(part), low if first is None else min(first, low), high if last is None else max(last, high)
        if not chunked:
            yield put(bytes(body))
            continue
        packed = pa.Codec(compression).compress(bytes(body), asbytes=True) if compression else bytes(body)
        start = size
        chunk = put(_record(6, struct.pack("<QQQI", low, high, len(body), 0) + _text(compression)
                            + struct.pack("<Q", len(packed)) + packed))
        yield chunk
        offsets, index_start = [], size
        for channel_id, entries in index.items() if message_index else ():
            offsets.append(struct.pack("<HQ", channel_id, size))
            yield put(_record(7, struct.pack("<H", channel_id) + _pairs([struct.pack("<QQ", *e) for e in entries])))
        indexes.append(_record(8, struct.pack("<QQQQ", low, high, start, len(chunk)) + _pairs(offsets)
                               + struct.pack("<Q", size - index_start) + _text(compression)
                               + struct.pack("<QQ", len(packed), len(body))))
    index_records, attached, told = [], 0, 0
    for name, media, log_time, data in attachments:
        body = (struct.pack("<QQ", log_time, log_time) + _text(name) + _text(media)
                + struct.pack("<Q", len(data)) + data + struct.pack("<I", 0))
        index_records.append(_record(10, struct.pack("<QQQQQ", size, len(body) + 9, log_time, log_time, len(data))
                                     + _text(name) + _text(media)))
        attached += 1
        yield put(_record(9, body))
    for name, pairs in metadata:
        body = _text(name) + _pairs([_text(k) + _text(v) for k, v in pairs.items()])
        index_records.append(_record(13, struct.pack("<QQ", size, len(body) + 9) + _text(name)))
        told += 1
        yield put(_record(12, body))
    yield put(_record(15, struct.pack("<I", 0)))
    summary_start = size if summary else 0
    if summary:
        if repeat_dims:
            yield b"".join([*(dim("s", key) for key in schemas), *(dim("c", key) for key in channels)])
        if statistics:
            yield _record(11, struct.pack("<QHIIIIQQ", total, len(used["s"]), len(used["c"]), attached,
                                          told, len(indexes), first or 0, last or 0)
                          + _pairs([struct.pack("<HQ", *c) for c in counts.items()]))
        yield from indexes
        yield from index_records
    yield _record(2, struct.pack("<QQI", summary_start, 0, 0)) + MAGIC
