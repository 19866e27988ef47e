"""WARC archives: a writer of one gzip member per record, and a sequential reader that verifies what it reads.

The reader decompresses in pieces, cuts each block by its content length and hashes as it goes, so a record takes no memory of its
own unless its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import Scratch
from tidewire.sources.files import located

PIECE = 1 << 18
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 1000
MAX_HEAD = 1 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """Control characters and blanks would break the header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record_bytes(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"),
              ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _uri(url)),
              ("WARC-Profile", None if refers_to is None else PROFILE),
              ("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>"),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
              ("Content-Type", HTTP), ("Content-Length", str(len(block)))]
    lines = [VERSION, *[f"{name}: {value}" for name, value in fields if value is not None]]
    packer = zlib.compressobj(level, wbits=31)
    return b"".join([packer.compress("\r\n".join(lines).encode() + END), packer.compress(block), packer.compress(END), packer.flush()])


def record_id(key: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("null")))


def page_id(column: Column, kind: str = "long") -> Column:
    """The page's id out of a record id; null where the page had none."""
    text = F.regexp_extract(column, r"^urn:page:(.*)$", 1)
    return F.when(~text.isin("", "null"), text.cast(kind))


def with_revisits(pages: DataFrame, scratch: Scratch, key: str, payload: str, url: str, min_bytes: int) -> DataFrame:
    """(record, url, payload, refers_to): of equal payloads the smallest id is the response, the others refer to it.

    Only digests found twice are grouped into a written table, so its size is known when the rows are joined with it.
    """
    rows = pages.select(pages[key].alias("id"), pages[url].cast("string").alias("url"),
                        F.coalesce(pages[payload].cast("binary"), F.lit(b"")).alias("payload"))
    digests = rows.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    shared = scratch.keep(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.withColumn("digest", F.sha1("payload")).join(shared, "digest", "left")
    refers = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(record_id(F.col("id")).alias("record"), "url", "payload",
                         F.when(refers, record_id(F.col("first"))).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, key: str = "page_id", payload: str = "html", url: str = "url",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write a record per row into archives under ``folder``; returns the written table (file, records, bytes).

    Each task writes its own archives, a new one after ``ARCHIVE_BYTES``. Their names are new for every attempt and only those of
    successful attempts are in the table, so a lost executor leaves files that nobody reads.

    Null payloads are empty ones. Rows without a url have no target line, rows without an id the record id ``urn:page:null``; they
    are never what others refer to. Rows that repeat the smallest id of their payload are all responses. An empty table writes
    nothing. Other columns do not matter.
    """
    typed = with_revisits(pages, scratch, key, payload, url, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = located(folder)
        system.create_dir(inner, recursive=True)
        part, sink, name, done, records, size = TaskContext.get().partitionId(), None, "", [], 0, 0
        for batch in batches:
            for rec, link, body, refers in zip(*[column.to_pylist() for column in batch.columns]):
                if sink is None:
                    name, records, size = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{inner}/{name}", compression=None)
                member = record_bytes(rec, link, body, refers, date, level)
                sink.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = done.append((f"{folder}/{name}", records, size))
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*done)], ["file", "records", "bytes"])

    return scratch.keep(typed.mapInArrow(run, "file string, records long, bytes long"))


class _Member:
    """One gzip member, decompressed piece by piece out of a stream whose unread bytes are handed on."""

    def __init__(self, stream, ahead: bytes):
        self.stream, self.raw, self.plain = stream, ahead, b""
        self.unpacker, self.taken, self.given = zlib.decompressobj(wbits=31), 0, len(ahead)

    def more(self) -> bool:
        """Another piece of plain bytes; False at the member's end."""
        while not self.unpacker.eof:
            piece = self.unpacker.decompress(self.raw, PIECE)
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if piece:
                self.plain += piece
                return True
            if not self.unpacker.eof and not self.raw:
                self.raw = self.stream.read(PIECE)
                self.given += len(self.raw)
                if not self.raw:
                    raise EOFError("archive ends inside a record")
        return False

    def head(self) -> bytes:
        """Bytes up to an empty line."""
        while (at := self.plain.find(END)) < 0:
            if len(self.plain) > MAX_HEAD:
                raise ValueError("header without end")
            if not self.more():
                raise ValueError("record ends inside its header")
        found, self.plain = self.plain[:at], self.plain[at + len(END):]
        return found

    def take(self, count: int) -> Iterator[bytes]:
        """The next ``count`` bytes in pieces."""
        while count:
            if not self.plain and not self.more():
                raise ValueError("record is shorter than its content length")
            piece, self.plain = self.plain[:count], self.plain[count:]
            count -= len(piece)
            yield piece


@dataclass
class Record:
    record_id: str | None = None
    record_type: str | None = None
    target_uri: str | None = None
    refers_to: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    digest_ok: bool | None = None
    problem: str | None = None
    offset: int = 0
    payload: bytes | None = None


SCHEMA = ("file string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
          "payload_digest string, digest_ok boolean, problem string, offset long")
_FIELDS = ("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "problem", "offset")


def _named(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digest(value: str | None) -> str | None:
    return value.partition(":")[2] if value and value.lower().startswith("sha1:") else None


def _read_record(member: _Member, record: Record, keep: bool) -> None:
    lines = member.head()
    if not lines.startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    fields = _named(lines)
    record.record_type = fields.get("warc-type")
    record.record_id = fields.get("warc-record-id", "").strip("<>") or None
    record.target_uri = fields.get("warc-target-uri")
    record.refers_to = fields.get("warc-refers-to", "").strip("<>") or None
    length = int(fields["content-length"])
    told, told_block = _digest(fields.get("warc-payload-digest")), _digest(fields.get("warc-block-digest"))
    block, body, size, kept, http = hashlib.sha1(), hashlib.sha1(), 0, [], b""
    in_head = fields.get("content-type", "").startswith("application/http")
    for piece in member.take(length):
        block.update(piece)
        if in_head:
            http += piece
            if (at := http.find(END)) < 0:
                if len(http) > MAX_HEAD:
                    raise ValueError("HTTP header without end")
                continue
            http, piece, in_head = http[:at], http[at + len(END):], False
        body.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if b"".join(member.take(len(END))) != END or member.plain or member.more():
        raise ValueError("record does not end where its content length says")
    found = base64.b32encode(body.digest()).decode()
    record.digest_ok = told_block in (None, base64.b32encode(block.digest()).decode())
    if record.record_type == "revisit":
        record.payload_digest = told
        record.payload_bytes = int(_named(http).get("content-length", 0))
        return
    record.digest_ok = record.digest_ok and told in (None, found)
    record.payload_digest, record.payload_bytes, record.payload = found, size, b"".join(kept) if keep else None


def records(stream, keep: bool = False) -> Iterator[Record]:
    """The records of one archive in order. A damaged one is reported; after a broken gzip member nothing can be told apart."""
    ahead, at = b"", 0
    while ahead or (ahead := stream.read(PIECE)):
        member, record = _Member(stream, ahead), Record(offset=at)
        try:
            try:
                _read_record(member, record, keep)
            except (ValueError, KeyError) as wrong:
                record.problem = str(wrong) if isinstance(wrong, ValueError) else "no content length"
                member.plain = b""
                while member.more():
                    member.plain = b""
        except (zlib.error, EOFError) as wrong:
            record.problem = f"{record.problem or ''} {wrong}".strip()
            yield record
            return
        if record.digest_ok is False:
            record.problem = "digest differs"
        yield record
        ahead = member.raw
        at += member.given - len(ahead)


def read_warc(files: DataFrame, payload: bool = False) -> DataFrame:
    """The records of all archives named in column ``file``, one archive read in order by one task at a time.

    ``problem`` says what is wrong with a record: cut off, not as long as told, digest differs. A revisit has the digest that its
    header tells and the length that its HTTP head tells. No files, no rows.
    """
    fields = _FIELDS + ("payload",) * payload
    kinds = dict(part.rsplit(" ", 1) for part in SCHEMA.split(", "))
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def batch_of(file: str, found: list[Record]) -> pa.RecordBatch:
        arrays = [pa.array([file] * len(found))]
        arrays += [pa.array([getattr(r, n) for r in found], arrow[kinds[n]] if n in kinds else pa.binary()) for n in fields]
        return pa.RecordBatch.from_arrays(arrays, ["file", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, inner = located(file)
                with system.open_input_stream(inner, compression=None) as stream:
                    found, size = [], 0
                    for record in records(stream, payload):
                        found.append(record)
                        size += len(record.payload or b"")
                        if size >= BATCH_BYTES or len(found) >= BATCH_RECORDS:
                            yield batch_of(file, found)
                            found, size = [], 0
                    if found:
                        yield batch_of(file, found)

    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInArrow(run, SCHEMA + ", payload binary" * payload)
