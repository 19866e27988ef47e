"""Recording files (``.mcap``, public format version 0) as a Spark data source.

    read_recordings(spark, "/data/run1.mcap", "/data/night").where("topic = '/imu' and log_time_ns >= 5")
    read_recordings(spark, "/data", table="chunks")

A file is cut into byte ranges by its size alone, so the driver opens no file. A task reads the summary at the
end of its file and then only those chunks that begin in its range and can hold a wanted time and topic. Without
a chunk index it walks over the record headers from the file's beginning instead, unless :func:`index_recordings` has stored
where the records of each range begin. Records are parsed by columns: borders first, then every header field and payload at once.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tidewire.sources.files import listed, located

# The file format's magic bytes, record tags and compression names.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06
CHUNK_INDEX, ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA = 0x08, 0x09, 0x0A, 0x0B, 0x0C
METADATA_INDEX, DATA_END = 0x0D, 0x0F
CODECS = {"zstd": "zstd", "lz4": "lz4"}
TAG_BYTES = 9
FOOTER_BYTES = TAG_BYTES + 20 + len(MAGIC)

RANGE_BYTES = 128 << 20
# Read-ahead grows while reads follow each other and starts small again after a jump over a chunk.
_LOOK_AHEAD, _MAX_LOOK_AHEAD = 4 << 10, 1 << 20
# Bytes of unchunked records parsed at once, and rows and payload bytes of a batch.
_WINDOW, _BATCH_ROWS, _BATCH_BYTES = 4 << 20, 4096, 16 << 20
_MESSAGE_HEADER = 22
LATEST = 2**63 - 1  # the last time that a bigint holds; files have unsigned times

TABLES = {
    "messages": """file string, chunk_offset bigint, offset bigint, channel_id int, topic string,
        message_encoding string, schema_id int, schema_name string, sequence bigint, log_time_ns bigint,
        publish_time_ns bigint, payload binary""",
    "dangling": "file string, chunk_offset bigint, offset bigint, channel_id int, log_time_ns bigint, problem string",
    "problems": "file string, offset bigint, problem string",
    "schemas": "file string, schema_id int, name string, encoding string, data binary",
    "channels": """file string, channel_id int, topic string, message_encoding string, schema_id int,
        metadata map<string,string>""",
    "chunks": """file string, chunk_offset bigint, chunk_bytes bigint, start_time_ns bigint, end_time_ns bigint,
        compression string, compressed_bytes bigint, uncompressed_bytes bigint, channel_ids array<int>""",
    "statistics": """file string, messages bigint, schemas int, channels bigint, attachments bigint,
        metadata bigint, chunks bigint, start_time_ns bigint, end_time_ns bigint,
        channel_messages map<int,bigint>, from_summary boolean""",
    "attachments": """file string, offset bigint, bytes bigint, log_time_ns bigint, create_time_ns bigint,
        data_bytes bigint, name string, media_type string""",
    "metadata": "file string, offset bigint, bytes bigint, name string",
    "borders": "file string, range_bytes bigint, low bigint, offset bigint, tag int, body binary",
    "declared": "file string, range_bytes bigint, low bigint, offset bigint, tag int, body binary",
}
# Tables whose files are read range by range.
BY_RANGE = ("messages", "dangling", "problems", "declared")
# How the summary tables come about: the summary or a scan, the summary only, or a scan only.
SUMMARY_MODES = ("auto", "strict", "scan")


class _Fields:
    """Reads the fields of one record in order."""

    def __init__(self, body):
        self.body, self.at = body, 0

    def take(self, layout: str) -> tuple:
        values = struct.unpack_from("<" + layout, self.body, self.at)
        self.at += struct.calcsize("<" + layout)
        return values

    def data(self, size_layout: str = "I") -> bytes:
        (size,) = self.take(size_layout)
        self.at += size
        return bytes(self.body[self.at - size:self.at])

    def text(self) -> str:
        return self.data().decode()

    def pairs(self, read) -> dict:
        (size,) = self.take("I")
        end, out = self.at + size, {}
        while self.at < end:
            key, value = read(self)
            out[key] = value
        return out


def _text_pair(f: _Fields):
    return f.text(), f.text()


def _id_pair(f: _Fields):
    return f.take("HQ")


class _File:
    """Ranged reads with a window, so walking over small records does not cost a request each."""

    def __init__(self, path: str):
        system, inner = located(path)
        self.path = path
        self.handle = system.open_input_file(inner)
        self.size = self.handle.size()
        self.window_at, self.window, self.ahead = 0, b"", _LOOK_AHEAD

    def bytes_at(self, offset: int, count: int) -> memoryview:
        inside = offset - self.window_at
        if not (0 <= inside and inside + count <= len(self.window)):
            near = 0 <= inside <= len(self.window)
            self.ahead = min(self.ahead * 2, _MAX_LOOK_AHEAD) if near else _LOOK_AHEAD
            self.handle.seek(offset)
            self.window_at, self.window = offset, self.handle.read(max(count, self.ahead))
            inside = 0
        return memoryview(self.window)[inside:inside + count]

    def records(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Tag, offset and body length of the whole records between two offsets."""
        while start + TAG_BYTES <= end:
            tag, size = struct.unpack("<BQ", self.bytes_at(start, TAG_BYTES))
            if start + TAG_BYTES + size > end:
                return
            yield tag, start, size
            start += TAG_BYTES + size

    def body(self, offset: int, size: int) -> memoryview:
        return self.bytes_at(offset + TAG_BYTES, size)

    def read(self, offset: int, count: int) -> np.ndarray:
        """Bytes of a run of records, past the window."""
        self.handle.seek(offset)
        return np.frombuffer(self.handle.read(count), np.uint8)


_RECORD = struct.Struct("<xQ")


@dataclass
class _Records:
    """The whole records of a buffer: where each begins, its tag and the length of its body."""

    data: np.ndarray
    starts: np.ndarray
    tags: np.ndarray
    sizes: np.ndarray

    def some(self, low: int, high: int) -> _Records:
        return _Records(self.data, self.starts[low:high], self.tags[low:high], self.sizes[low:high])

    def field(self, at: int, kind: str, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The number ``at`` bytes into the body of each record, gathered out of the buffer."""
        kind = np.dtype(kind)
        places = self.starts[rows, None] + (TAG_BYTES + at + np.arange(kind.itemsize))
        return np.ascontiguousarray(self.data[places]).view(kind)[:, 0]

    def body(self, at: int) -> memoryview:
        start = int(self.starts[at]) + TAG_BYTES
        return self.data[start:start + int(self.sizes[at])].data

    @property
    def end(self) -> int:
        return int(self.starts[-1] + TAG_BYTES + self.sizes[-1]) if len(self.starts) else 0

    def bodies_from(self, at: int, rows: np.ndarray) -> pa.Array:
        """The bytes of bodies from ``at`` on as a column: the buffer cut at their borders, gaps between them left out."""
        first = self.starts[rows] + TAG_BYTES + at
        borders = np.stack([first, self.starts[rows] + TAG_BYTES + self.sizes[rows]], axis=1).ravel()
        base = int(borders[0]) if len(rows) else 0
        wide = len(rows) and int(borders[-1]) - base > 2**31 - 1
        offsets = pa.py_buffer((borders - base).astype(np.int64 if wide else np.int32).tobytes())
        kind = pa.large_binary() if wide else pa.binary()
        pieces = pa.Array.from_buffers(kind, max(0, len(borders) - 1), [None, offsets, pa.py_buffer(self.data[base:])])
        return pieces.take(pa.array(np.arange(0, max(0, len(borders) - 1), 2)))


def _records_in(data) -> _Records:
    """One pass over the lengths of a buffer's records. Runs of records of one length, which a fixed-size type makes, are compared
    as a matrix, twice as many each time."""
    data = np.frombuffer(data, np.uint8)
    size_at, total = _RECORD.unpack_from, len(data)
    starts: list[np.ndarray | list[int]] = []
    single: list[int] = []
    at, before, step = 0, -1, 8
    while at + TAG_BYTES <= total:
        (size,) = size_at(data, at)
        width = TAG_BYTES + size
        if at + width > total:
            break
        single.append(at)
        at += width
        if size != before:
            before, step = size, 8
            continue
        while (count := min(step, (total - at) // width)) > 1:
            rows = data[at:at + count * width].reshape(count, width)[:, 1:TAG_BYTES]
            other = np.flatnonzero((rows != data[at - width + 1:at - width + TAG_BYTES]).any(axis=1))
            same = int(other[0]) if len(other) else count
            starts += [single, at + width * np.arange(same)]
            single, at, step = [], at + same * width, step * 2
            if same < count:
                before = -1
                break
    starts.append(single)
    places = np.concatenate([np.asarray(part, np.int64) for part in starts])
    records = _Records(data, places, data[places], np.zeros(0, np.int64))
    records.sizes = np.diff(np.append(places, at)) - TAG_BYTES
    return records


def _problems(file: _File) -> Iterator[tuple[str, int, str]]:
    """What a reader would pass over without a word: a foreign or cut-off file, torn records, a missing end."""
    if file.size < len(MAGIC) or file.bytes_at(0, len(MAGIC)) != MAGIC:
        yield file.path, 0, "not a recording file"
        return
    at, ended = len(MAGIC), False
    while at + TAG_BYTES <= file.size and not ended:
        tag, size = struct.unpack("<BQ", file.bytes_at(at, TAG_BYTES))
        if at + TAG_BYTES + size > file.size:
            yield file.path, at, f"record {tag} of {size} bytes is cut off"
            return
        ended = tag == FOOTER
        at += TAG_BYTES + size
    if not ended:
        yield file.path, at, "no footer" if at == file.size else f"{file.size - at} bytes are no record"
    elif file.size - at < len(MAGIC) or file.bytes_at(at, len(MAGIC)) != MAGIC:
        yield file.path, at, "no closing mark"


def _chunk_problem(file: _File, offset: int, size: int) -> str | None:
    """What is wrong with the contents of a chunk."""
    try:
        data = _read_chunk(file, offset, size)
    except Exception as wrong:  # whatever the codec makes of damaged bytes
        return f"chunk is damaged: {wrong}"
    if len(data) != _chunk_header(file, offset, size).uncompressed:
        return f"chunk holds {len(data)} bytes, not as many as it says"
    records = _records_in(data)
    if records.end != len(data):
        return f"chunk ends in {len(data) - records.end} bytes that are no record"
    short = (records.tags == MESSAGE) & (records.sizes < _MESSAGE_HEADER)
    return f"chunk has {int(short.sum())} messages without a whole header" if short.any() else None


@dataclass
class _Chunk:
    offset: int
    size: int
    start: int
    end: int
    compression: str
    compressed: int
    uncompressed: int
    channels: list[int] | None = None  # unknown without message indexes


def _read_chunk(file: _File, offset: int, size: int) -> bytes | memoryview:
    f = _Fields(file.body(offset, size))
    _, _, uncompressed, _ = f.take("QQQI")
    codec = f.text()
    records = f.data("Q")
    if not codec:
        return records
    if codec not in CODECS:
        raise ValueError(f"{file.path}: unknown chunk compression {codec!r}")
    return pa.Codec(CODECS[codec]).decompress(records, decompressed_size=uncompressed, asbytes=True)


@dataclass
class _Summary:
    """What a file declares about itself."""

    schemas: dict[int, tuple] = field(default_factory=dict)
    channels: dict[int, tuple] = field(default_factory=dict)
    chunks: dict[int, _Chunk] = field(default_factory=dict)
    attachments: list[tuple] = field(default_factory=list)
    metadata: list[tuple] = field(default_factory=list)
    statistics: tuple | None = None
    from_summary: bool = True

    def declare(self, tag: int, body) -> None:
        """A schema or channel record; the first of an id counts."""
        f = _Fields(body)
        if tag == SCHEMA:
            (schema_id,) = f.take("H")
            self.schemas.setdefault(schema_id, (f.text(), f.text(), f.data()))
        elif tag == CHANNEL:
            channel_id, schema_id = f.take("HH")
            self.channels.setdefault(channel_id, (f.text(), f.text(), schema_id, f.pairs(_text_pair)))


def _from_summary(file: _File) -> _Summary | None:
    """The summary section, or nothing if it is missing, damaged or without statistics."""
    if file.size < len(MAGIC) + FOOTER_BYTES:
        return None
    tail = file.bytes_at(file.size - FOOTER_BYTES, FOOTER_BYTES)
    if tail[0] != FOOTER or tail[-len(MAGIC):] != MAGIC:
        return None
    start, offsets_start, _ = struct.unpack_from("<QQI", tail, TAG_BYTES)
    end = offsets_start or file.size - FOOTER_BYTES
    if not start or start > end or end > file.size:
        return None
    out = _Summary()
    for tag, at, size in file.records(start, end):
        f = _Fields(file.body(at, size))
        if tag in (SCHEMA, CHANNEL):
            out.declare(tag, f.body)
        elif tag == CHUNK_INDEX:
            first, last, offset, length = f.take("QQQQ")
            index = f.pairs(_id_pair)
            (index_bytes,) = f.take("Q")
            chunk = _Chunk(offset, length, first, last, f.text(), *f.take("QQ"))
            chunk.channels = sorted(index) if index_bytes else None
            out.chunks.setdefault(offset, chunk)
        elif tag == ATTACHMENT_INDEX:
            out.attachments.append((*f.take("QQQQQ"), f.text(), f.text()))
        elif tag == METADATA_INDEX:
            out.metadata.append((*f.take("QQ"), f.text()))
        elif tag == STATISTICS:
            out.statistics = (*f.take("QHIIIIQQ"), f.pairs(_id_pair))
    return out if out.statistics else None


@dataclass
class _Run:
    """Neighbouring messages, schemas and channels outside chunks; ``at`` is where their buffer begins in the file."""

    at: int
    records: _Records


def _walked(file: _File, at: int, end: int) -> Iterator[_Run | tuple[int, int, int]]:
    """The records of the data section that begin between two record borders: runs parsed at once, all others as (tag, offset, length)."""
    if at <= len(MAGIC) and file.bytes_at(0, len(MAGIC)) != MAGIC:
        raise ValueError(f"{file.path} is not a recording file")
    while at < end and at + TAG_BYTES <= file.size:
        tag, size = struct.unpack("<BQ", file.bytes_at(at, TAG_BYTES))
        if tag in (DATA_END, FOOTER) or at + TAG_BYTES + size > file.size:
            return
        if tag not in _RUN_TAGS:
            yield tag, at, size
            at += TAG_BYTES + size
            continue
        records = _records_in(file.read(at, max(TAG_BYTES + size, min(_WINDOW, end - at))))
        other = np.flatnonzero(~np.isin(records.tags, _RUN_TAGS) | (at + records.starts >= end))
        records = records.some(0, int(other[0]) if len(other) else len(records.starts))
        yield _Run(at, records)
        at += records.end


_RUN_TAGS = (SCHEMA, CHANNEL, MESSAGE)


def _chunk_header(file: _File, offset: int, size: int) -> _Chunk:
    f = _Fields(file.body(offset, size))
    start, end, uncompressed, _ = f.take("QQQI")
    return _Chunk(offset, TAG_BYTES + size, start, end, f.text(), f.take("Q")[0], uncompressed)


def _from_scan(file: _File) -> _Summary:
    """The same facts from the data section."""
    out = _Summary(from_summary=False)
    counts: dict[int, int] = {}
    first, last = None, 0

    def count(records: _Records) -> None:
        nonlocal first, last
        message = np.flatnonzero(records.tags == MESSAGE)
        if len(message):
            times = records.field(6, "<u8", message)
            first, last = min(first if first is not None else LATEST * 2, int(times.min())), max(last, int(times.max()))
            for channel_id, rows in zip(*np.unique(records.field(0, "<u2", message), return_counts=True)):
                counts[int(channel_id)] = counts.get(int(channel_id), 0) + int(rows)
        for at in np.flatnonzero(np.isin(records.tags, (SCHEMA, CHANNEL))):
            out.declare(int(records.tags[at]), records.body(at))

    for part in _walked(file, len(MAGIC), file.size):
        if isinstance(part, _Run):
            count(part.records)
            continue
        tag, at, size = part
        if tag == CHUNK:
            out.chunks[at] = _chunk_header(file, at, size)
            count(_records_in(_read_chunk(file, at, size)))
        elif tag == ATTACHMENT:
            f = _Fields(file.body(at, size))
            log_time, created = f.take("QQ")
            name, media = f.text(), f.text()
            out.attachments.append((at, TAG_BYTES + size, log_time, created, f.take("Q")[0], name, media))
        elif tag == METADATA:
            out.metadata.append((at, TAG_BYTES + size, _Fields(file.body(at, size)).text()))
    out.statistics = (sum(counts.values()), len(out.schemas), len(out.channels), len(out.attachments),
                      len(out.metadata), len(out.chunks), first or 0, last, counts)
    return out


def summarize(file: _File, mode: str) -> _Summary:
    found = None if mode == "scan" else _from_summary(file)
    if found is None and mode == "strict":
        raise ValueError(f"{file.path} has no usable summary")
    return found or _from_scan(file)


@dataclass
class _Wanted:
    """Time range and topics, as far as filters told."""

    start: int = 0
    end: int | None = None
    topics: set[str] | None = None

    def time(self, first: int, last: int) -> bool:
        """Whether some time from ``first`` to ``last`` is asked for."""
        return last >= self.start and (self.end is None or first < self.end)

    def narrow_topics(self, topics) -> None:
        self.topics = set(topics) if self.topics is None else self.topics & set(topics)

    def chunk(self, chunk: _Chunk, channels: dict[int, tuple]) -> bool:
        if not self.time(chunk.start, chunk.end):
            return False
        if self.topics is None or chunk.channels is None:
            return True
        return any(c not in channels or channels[c][0] in self.topics for c in chunk.channels)


class _RangeReader:
    """Messages of one file whose chunk (or record) begins in a byte range.

    ``known`` is what an index says about the file: where the range's first record begins, and what is declared where.
    """

    def __init__(self, file: _File, low: int, high: int, wanted: _Wanted, dangling: bool, known: dict | None = None):
        self.file, self.low, self.high, self.wanted, self.dangling = file, low, high, wanted, dangling
        self.summary = _from_summary(file) or _Summary(from_summary=False)
        self.unread: list[tuple[int, int]] = []  # earlier chunks that may declare channels
        self.known = known
        # (place, tag, body) of an index, latest place first, so that the next one in order is at the end
        self.told = sorted(((place, tag, base64.b64decode(body)) for place, tag, body in known["declared"]), reverse=True) if known else []

    def _start(self) -> int:
        return len(MAGIC) if self.known is None else self.known["starts"].get(str(self.low), self.file.size)

    def chunks(self) -> Iterator[tuple[int, int, _Chunk]]:
        """Offset, length and header of the range's chunks, as the index lists them or as a walk meets them."""
        if self.summary.chunks:
            yield from ((c.offset, c.size - TAG_BYTES, c) for c in self.summary.chunks.values() if self.low <= c.offset < self.high)
            return
        for part in _walked(self.file, self._start(), self.high):
            if not isinstance(part, _Run) and part[0] == CHUNK and part[1] >= self.low:
                yield part[1], part[2], _chunk_header(self.file, *part[1:])

    def batches(self) -> Iterator[dict[str, pa.Array]]:
        if self.summary.chunks:
            for chunk in sorted(self.summary.chunks.values(), key=lambda c: c.offset):
                size = chunk.size - TAG_BYTES
                if self.low <= chunk.offset < self.high and self.wanted.chunk(chunk, self.summary.channels):
                    yield from self._columns(_records_in(_read_chunk(self.file, chunk.offset, size)), chunk.offset, 0)
                else:
                    self.unread.append((chunk.offset, size))
            return
        for part in _walked(self.file, self._start(), self.high):
            if isinstance(part, _Run):
                yield from self._columns(part.records, None, part.at)
            elif part[0] == CHUNK:
                _, at, size = part
                if at >= self.low and self.wanted.chunk(_chunk_header(self.file, at, size), {}):
                    yield from self._columns(_records_in(_read_chunk(self.file, at, size)), at, 0)
                elif self.known is None:
                    self.unread.append((at, size))

    def _columns(self, records: _Records, chunk_offset: int | None, base: int) -> Iterator[dict[str, pa.Array]]:
        """The wanted messages of a buffer, in runs between the declarations it holds."""
        said = np.flatnonzero((records.tags == SCHEMA) | (records.tags == CHANNEL))
        message = np.flatnonzero(records.tags == MESSAGE)
        if chunk_offset is None:
            message = message[base + records.starts[message] >= self.low]
        borders = [0, *np.searchsorted(message, said).tolist(), len(message)]
        for part, (low, high) in enumerate(zip(borders, borders[1:])):
            if part:
                self.summary.declare(int(records.tags[said[part - 1]]), records.body(said[part - 1]))
            if high > low:
                before = base + int(records.starts[message[low]]) if chunk_offset is None else chunk_offset
                yield from self._messages(records, message[low:high], chunk_offset, base, before)

    def _declared(self, table: dict, key: int, before: int):
        """A channel or schema by id, looked for in earlier chunks when the summary did not repeat it."""
        while key not in table and self.told and self.told[-1][0] <= before:
            _, tag, body = self.told.pop()
            self.summary.declare(tag, body)
        if key not in table:
            earlier = [c for c in self.unread if c[0] < before]
            self.unread = [c for c in self.unread if c[0] >= before]
            for offset, size in earlier:
                records = _records_in(_read_chunk(self.file, offset, size))
                for at in np.flatnonzero((records.tags == SCHEMA) | (records.tags == CHANNEL)):
                    self.summary.declare(int(records.tags[at]), records.body(at))
        return table.get(key)

    def _channel(self, channel_id: int, before: int) -> tuple[tuple | None, tuple | None, str | None]:
        """Channel, schema and what is missing."""
        channel = self._declared(self.summary.channels, channel_id, before)
        if channel is None:
            return None, None, f"missing channel {channel_id}"
        schema = self._declared(self.summary.schemas, channel[2], before) if channel[2] else None
        return channel, schema, f"missing schema {channel[2]}" if channel[2] and schema is None else None

    def _messages(self, records: _Records, rows: np.ndarray, chunk_offset: int | None, base: int, before: int) -> Iterator[dict[str, pa.Array]]:
        if (records.sizes[rows] < _MESSAGE_HEADER).any():
            raise ValueError(f"{self.file.path}: a message at or after {before} has no whole header")
        log_time = records.field(6, "<u8", rows)
        asked = log_time >= np.uint64(max(0, self.wanted.start))
        if self.wanted.end is not None:
            asked &= log_time < np.uint64(max(0, min(self.wanted.end, 2**64 - 1)))
        rows, log_time = rows[asked], log_time[asked]
        if not len(rows):
            return
        channel_id, publish_time = records.field(0, "<u2", rows), records.field(14, "<u8", rows)
        ids, of = np.unique(channel_id, return_inverse=True)
        facts = [self._channel(int(i), before) for i in ids]
        late = np.maximum(log_time, publish_time) > np.uint64(LATEST)
        bad = late | np.array([problem is not None for _, _, problem in facts])[of]
        if self.dangling:
            take = np.flatnonzero(bad)
        else:
            topics = self.wanted.topics
            take = np.flatnonzero(~bad & np.array([channel is not None and (topics is None or channel[0] in topics) for channel, _, _ in facts])[of])
        for at in self._slices(records.sizes[rows[take]]):
            some = take[at]
            mine, which = rows[some], pa.array(of[some])
            columns = {
                "file": pa.array([self.file.path]).take(pa.array(np.zeros(len(some), np.int64))),
                "chunk_offset": pa.array(np.full(len(some), chunk_offset or 0), mask=np.full(len(some), chunk_offset is None)),
                "offset": pa.array(base + records.starts[mine]), "channel_id": pa.array(channel_id[some].astype(np.int32)),
                "log_time_ns": pa.array(log_time[some].astype(np.int64), mask=log_time[some] > np.uint64(LATEST))}
            if self.dangling:
                texts = pa.array([problem or "" for _, _, problem in facts], pa.string()).take(which)
                latest = pa.array([f"time {t} does not fit a bigint" for t in np.maximum(log_time, publish_time)[some][late[some]].tolist()], pa.string())
                yield columns | {"problem": pc.replace_with_mask(texts, pa.array(late[some]), latest)}
                continue
            for name, values, kind in (("topic", [c and c[0] for c, _, _ in facts], pa.string()),
                                       ("message_encoding", [c and c[1] for c, _, _ in facts], pa.string()),
                                       ("schema_id", [c and c[2] for c, _, _ in facts], pa.int32()),
                                       ("schema_name", [s and s[0] for _, s, _ in facts], pa.string())):
                columns[name] = pa.array(values, kind).take(which)
            columns["sequence"] = pa.array(records.field(2, "<u4", mine).astype(np.int64))
            columns["publish_time_ns"] = pa.array(publish_time[some].astype(np.int64))
            columns["payload"] = lambda mine=mine: records.bodies_from(_MESSAGE_HEADER, mine)
            yield columns

    @staticmethod
    def _slices(sizes: np.ndarray) -> Iterator[slice]:
        """Runs of rows of bounded number and payload."""
        ends = np.cumsum(sizes)
        low = 0
        while low < len(sizes):
            before = int(ends[low - 1]) if low else 0
            high = min(low + _BATCH_ROWS, max(low + 1, int(np.searchsorted(ends, before + _BATCH_BYTES, side="right"))))
            yield slice(low, high)
            low = high


def _borders(file: _File, step: int) -> Iterator[tuple]:
    """For a file without a chunk index: the first record of each range, and what is declared outside chunks."""
    summary = _from_summary(file)
    if (summary and summary.chunks) or file.size < len(MAGIC) or file.bytes_at(0, len(MAGIC)) != MAGIC:
        return
    low = 0
    for part in _walked(file, len(MAGIC), file.size):
        records = part.records if isinstance(part, _Run) else None
        starts = part.at + records.starts if records else np.array([part[1]])
        for at in range(low, int(starts[-1]) + 1, step):
            place = int(starts[np.searchsorted(starts, at)])
            if place < at + step:
                yield file.path, step, at, place, None, None
            low = at + step
        for at in np.flatnonzero((records.tags == SCHEMA) | (records.tags == CHANNEL)) if records else ():
            yield file.path, step, None, int(starts[at]), int(records.tags[at]), bytes(records.body(at))


def _summary_rows(file: _File, found: _Summary, table: str) -> Iterator[tuple]:
    path = file.path
    if table == "schemas":
        yield from ((path, key, *value) for key, value in found.schemas.items())
    elif table == "channels":
        yield from ((path, key, topic, encoding, schema_id, metadata)
                    for key, (topic, encoding, schema_id, metadata) in found.channels.items())
    elif table == "chunks":
        yield from ((path, c.offset, c.size, c.start, c.end, c.compression, c.compressed, c.uncompressed, c.channels)
                    for c in found.chunks.values())
    elif table == "statistics":
        yield (path, *found.statistics, found.from_summary)
    else:
        yield from ((path, *row) for row in (found.attachments if table == "attachments" else found.metadata))


@dataclass
class _Range(ds.InputPartition):
    path: str
    low: int
    high: int
    known: dict | None = None


class _Reader(ds.DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema = options, schema
        self.table = options.get("table", "messages")
        self.mode = options.get("summary", "auto")
        if self.mode not in SUMMARY_MODES:
            raise ValueError(f"summary must be one of {SUMMARY_MODES}")
        self.wanted = _Wanted(int(options.get("start", 0)), int(options["end"]) if "end" in options else None)
        if self.wanted.end is not None and self.wanted.start > self.wanted.end:
            raise ValueError("start time must be before end time")

    def pushFilters(self, filters):
        """Time and topic filters also choose chunks; Spark still applies every filter itself."""
        for f in filters:
            if self.table == "messages":
                self._note(f)
            yield f

    def _note(self, f) -> None:
        name = getattr(f, "attribute", None)
        if name == ("topic",):
            if isinstance(f, ds.EqualTo):
                self.wanted.narrow_topics([f.value])
            elif isinstance(f, ds.In):
                self.wanted.narrow_topics(f.value)
        elif name == ("log_time_ns",):
            if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                least = f.value + 1 if isinstance(f, ds.GreaterThan) else f.value
                self.wanted.start = max(self.wanted.start, least)
            if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                beyond = f.value if isinstance(f, ds.LessThan) else f.value + 1
                self.wanted.end = beyond if self.wanted.end is None else min(self.wanted.end, beyond)

    def partitions(self):
        step = int(self.options.get("rangeBytes", RANGE_BYTES))
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        found = sorted({entry for path in paths for entry in listed(path, ".mcap")})
        if self.table not in BY_RANGE:
            return [_Range(path, 0, size) for path, size in found]
        index = json.loads(self.options.get("index", "{}"))
        for known in index.values():
            if known["step"] != step:
                raise ValueError(f"the index was made for ranges of {known['step']} bytes")
        return [_Range(path, low, low + step, index.get(path)) for path, size in found for low in range(0, max(size, 1), step)]

    def read(self, part):
        file = _File(part.path)
        if self.table == "problems":
            if part.low == 0:
                yield from _problems(file)
            if file.size >= len(MAGIC) and file.bytes_at(0, len(MAGIC)) == MAGIC:
                for offset, size, _ in _RangeReader(file, part.low, part.high, self.wanted, False, part.known).chunks():
                    problem = _chunk_problem(file, offset, size)
                    if problem:
                        yield file.path, offset, problem
            return
        if self.table == "borders":
            yield from _borders(file, int(self.options.get("rangeBytes", RANGE_BYTES)))
            return
        reader = _RangeReader(file, part.low, part.high, self.wanted, self.table == "dangling", getattr(part, "known", None))
        if self.table == "declared":
            # a chunk index without message indexes or repeated channels still leaves the chunks to look into
            for offset, size, _ in reader.chunks():
                records = _records_in(_read_chunk(file, offset, size))
                for at in np.flatnonzero((records.tags == SCHEMA) | (records.tags == CHANNEL)):
                    yield file.path, part.high - part.low, None, offset, int(records.tags[at]), bytes(records.body(at))
            return
        if self.table not in ("messages", "dangling"):
            yield from _summary_rows(file, summarize(file, self.mode), self.table)
            return
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(self.schema)
        for columns in reader.batches():
            values = [columns[name]() if name == "payload" else columns[name] for name in schema.names]
            yield pa.RecordBatch.from_arrays([v.cast(schema.field(n).type) for n, v in zip(schema.names, values)], schema=schema)


class RecordingFiles(ds.DataSource):
    @classmethod
    def name(cls):
        return "mcap"

    def schema(self):
        columns = TABLES[self.options.get("table", "messages")]
        return columns.replace(", payload binary", "") if self.options.get("payload") == "false" else columns

    def reader(self, schema):
        return _Reader(self.options, schema)


def read_recordings(spark: SparkSession, *paths: str, table: str = "messages", index: str | None = None, **options) -> DataFrame:
    """One of ``TABLES`` over recording files or folders of them.

    ``start`` and ``end`` bound the log time; ``summary`` is one of ``SUMMARY_MODES``. ``payload="false"`` leaves
    out the payloads, for statistics that need the headers only. ``index`` is a table that :func:`index_recordings` wrote:
    ranges of files without a chunk index then begin at their own first record, and look up what is declared before them.
    """
    if table not in TABLES:
        raise ValueError(f"table must be one of {sorted(TABLES)}")
    if index is not None:
        options["index"] = json.dumps(_known(spark.read.parquet(index)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingFiles)
    return (spark.read.format("mcap").options(table=table, paths=json.dumps(list(paths)), **options).load())


def _known(index: DataFrame) -> dict[str, dict]:
    """Per file the first record of each range and the declarations; as many as a plan has ranges, and files have channels."""
    out: dict[str, dict] = {}
    for row in index.collect():
        known = out.setdefault(row.file, {"step": row.range_bytes, "starts": {}, "declared": []})
        if row.tag is None:
            known["starts"][str(row.low)] = row.offset
        else:
            known["declared"].append((row.offset, row.tag, base64.b64encode(row.body).decode()))
    return out


def index_recordings(spark: SparkSession, *paths: str, path: str, **options) -> None:
    """Store under ``path``, for files without a chunk index, where the first record of each range begins and what is declared.

    Records have no marks to start at, so one task a file walks over its record lengths, once; with the result all later
    reads are split by range and read each byte once. What chunks declare inside is then collected by range. Damaged files are
    indexed as far as their records go. Files with a chunk index need no rows here. The option ``rangeBytes`` must be the reader's.
    """
    read_recordings(spark, *paths, table="borders", **options).write.parquet(path)
    listed_files = spark.read.parquet(path)
    first = W.partitionBy("file", "tag", F.substring("body", 1, 2)).orderBy("offset")
    inside = read_recordings(spark, *paths, table="declared", index=path, **options).join(
        listed_files.select("file").distinct(), "file", "left_semi")
    (inside.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").write.mode("append").parquet(path))


# --- canonical tables out of files ------------------------------------------------------------------------------


def file_messages(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Messages of recording files as the operators want them; every file is a recording.

    ``arrival_seq`` counts a file's messages in the order of their records, from 0. Chunks (of unchunked files: ranges of
    ``RANGE_BYTES``) are counted first, so a row is only numbered among those of its chunk. Options as in :func:`read_recordings`.
    """
    rows = read_recordings(spark, *paths, **options).withColumn(
        "_part", F.coalesce("chunk_offset", F.floor(F.col("offset") / RANGE_BYTES) * RANGE_BYTES))
    counts = rows.groupBy("file", "_part").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("file").alias("_file"), F.col("_part").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("file", "_part").orderBy("offset")) - 1
    body = [F.col("payload"), F.length("payload").alias("payload_bytes")] if "payload" in rows.columns else []
    return (rows.withColumn("_inside", inside).join(starts, (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_at")))
            .select(F.col("file").alias("recording_id"), "topic", (F.col("_before") + F.col("_inside")).alias("arrival_seq"), "log_time_ns",
                    F.col("publish_time_ns").alias("source_time_ns"), F.lit(True).alias("valid"), "channel_id", "schema_id",
                    F.coalesce("schema_name", F.lit("")).alias("type_name"), *body))


def file_channels(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Channels of recording files by recording and id."""
    return read_recordings(spark, *paths, table="channels", **options).withColumnRenamed("file", "recording_id")


def file_schemas(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Schemas of recording files by recording and id."""
    return read_recordings(spark, *paths, table="schemas", **options).withColumnRenamed("file", "recording_id")
