import gzip
import io
import re

import pytest

from tidewire.llm import warc
from tidewire.session import Scratch, scratch_path

SCHEMA = "page_id long, url string, html string, file string, record string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/", "x"), (1, "http://b/ \r\nbad", "x"), (2, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 200_000),
            (None, "u", "x"), (None, "u", "alone"), (1, "http://b/", "x"), (7, "u", "y\r\n\r\nz")]
    return spark.createDataFrame([(*r, "f", "r", "p") for r in rows], SCHEMA)


def archive(spark, pages, **options):
    return warc.write_warc(pages, scratch_path(spark, "warc"), Scratch(spark, "warc"), **options)


def test_round_trip(spark, pages):
    files = archive(spark, pages)
    rows = warc.read_warc(files, payload=True).select("*", warc.page_id(warc.F.col("record_id")).alias("id"),
                                                      warc.page_id(warc.F.col("refers_to")).alias("first")).collect()
    assert len(rows) == pages.count() and not [r for r in rows if r.problem or not r.digest_ok]
    texts = {3: "x", 1: "x", 2: "x", 4: "", 5: "", 6: "é" * 200_000, 7: "y\r\n\r\nz"}
    for r in rows:
        if r.id is None:
            continue
        data = texts[r.id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.base32_sha1(data))
        want = {3: 1, 2: 1, 5: 4}.get(r.id)
        assert (r.record_type, r.first) == (("revisit", want) if want else ("response", None))
        assert r.payload is None if want else bytes(r.payload) == data
    unknown = sorted((r.record_type, r.first or 0) for r in rows if r.id is None)
    assert unknown == [("response", 0), ("revisit", 1)]


def test_small_payloads_are_not_revisited(spark, pages):
    rows = warc.read_warc(archive(spark, pages, min_bytes=2)).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_archives_roll_over(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    files = archive(spark, pages.coalesce(1))
    assert files.count() >= 1 and warc.read_warc(files).count() == pages.count()


def test_empty(spark, pages):
    assert warc.read_warc(archive(spark, pages.limit(0))).count() == 0


def record(body=b"hello", **extra):
    return warc.record_bytes("urn:page:1", "u", body, extra.get("refers"), "1970-01-01T00:00:00Z", 6)


def test_members_are_gzip_of_their_own():
    one = record(b"a" * 1_000_000)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    found = list(warc.records(io.BytesIO(one + record() + one), keep=True))
    assert [r.offset for r in found] == [0, len(one), len(one) + len(record())] and [len(r.payload) for r in found] == [10**6, 5, 10**6]


def repacked(data):
    return gzip.compress(data)


def test_damage_is_told():
    plain = gzip.decompress(record())
    wrong = [repacked(plain.replace(b"hello", b"hullo")), repacked(re.sub(rb"Content-Length: \d+(?=\r\n\r\nHTTP)", b"Content-Length: 9", plain)),
             repacked(plain[:-8]), repacked(b"no record"), repacked(plain.split(b"\r\n", 1)[0])]
    found = list(warc.records(io.BytesIO(b"".join(wrong) + record())))
    assert [bool(r.problem) for r in found] == [True] * 5 + [False]
    torn = list(warc.records(io.BytesIO(record() + record()[:-9])))
    assert [r.problem for r in torn] == [None, "archive ends inside a record"]
    broken = list(warc.records(io.BytesIO(record() + b"garbage" + record())))
    assert len(broken) == 2 and broken[1].problem
