import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from tests.support.recording_encoder import encode_file
from tidewire.sources import recording_files as rf
from tidewire.sources.recording_files import file_channels, file_messages, file_schemas, read_recordings

CHANNELS = {1: ("/a", "cdr", 1, {"k": "v"}), 2: ("/b", "cdr", 0, {}), 3: ("/c", "cdr", 9, {})}
SCHEMAS = {1: ("demo::T", "omgidl", b"struct T {};")}
# channel 7 is declared nowhere, and channel 3 names a schema nobody declares
MESSAGES = [(1 + i % 3 if i % 17 else 7, i, 1000 + (i ^ 3) * 10, b"x" * i) for i in range(100)]
GOOD = {(CHANNELS[c][0], s, t, p) for c, s, t, p in MESSAGES if c in (1, 2)}
VARIANTS = {
    "plain": {}, "zstd": {"compression": "zstd"}, "lz4": {"compression": "lz4"}, "no_summary": {"summary": False},
    "no_summary_zstd": {"summary": False, "compression": "zstd"},
    "dims_in_chunks_only": {"repeat_dims": False, "compression": "zstd"}, "no_statistics": {"statistics": False},
    "unchunked": {"chunked": False}, "unchunked_no_summary": {"chunked": False, "summary": False},
    "no_message_index": {"message_index": False},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("recordings")
    for name, options in VARIANTS.items():
        (path / f"{name}.mcap").write_bytes(encode_file(
            MESSAGES, CHANNELS, SCHEMAS, attachments=[("a.txt", "text/plain", 5, b"hello")],
            metadata=[("m", {"a": "b"})], **options))
    (path / "notes.txt").write_text("no recording")
    return str(path)


def rows(df):
    return {(r.topic, r.sequence, r.log_time_ns, bytes(r.payload)) for r in df.collect()}


@pytest.mark.parametrize("name", VARIANTS)
@pytest.mark.parametrize("range_bytes", [1 << 27, 1500])
def test_messages(spark, folder, name, range_bytes):
    df = read_recordings(spark, f"{folder}/{name}.mcap", rangeBytes=range_bytes)
    got = df.collect()
    assert len(got) == len(GOOD) and rows(df) == GOOD
    assert {(r.schema_id, r.schema_name, r.message_encoding) for r in got if r.topic == "/a"} == {(1, "demo::T", "cdr")}
    assert {(r.schema_id, r.schema_name) for r in got if r.topic == "/b"} == {(0, None)}


@pytest.mark.parametrize("name", VARIANTS)
def test_dangling_messages_are_reported(spark, folder, name):
    got = read_recordings(spark, f"{folder}/{name}.mcap", table="dangling").collect()
    assert len(got) == len(MESSAGES) - len(GOOD)
    assert {r.problem for r in got} == {"missing channel 7", "missing schema 9"}


def test_a_folder_and_several_paths(spark, folder):
    assert read_recordings(spark, folder).count() == len(VARIANTS) * len(GOOD)
    assert read_recordings(spark, f"{folder}/plain.mcap", f"{folder}/lz4.mcap").count() == 2 * len(GOOD)


@pytest.mark.parametrize("name", VARIANTS)
def test_filters(spark, folder, name):
    df = read_recordings(spark, f"{folder}/{name}.mcap")
    assert rows(df.where("topic = '/a' and log_time_ns >= 1500 and log_time_ns < 1600")) == {
        g for g in GOOD if g[0] == "/a" and 1500 <= g[2] < 1600}
    assert rows(df.where("topic in ('/b', '/zzz') and log_time_ns > 1500 and log_time_ns <= 1600")) == {
        g for g in GOOD if g[0] == "/b" and 1500 < g[2] <= 1600}
    assert rows(df.where("log_time_ns = 1500")) == {g for g in GOOD if g[2] == 1500}
    ranged = read_recordings(spark, f"{folder}/{name}.mcap", start=1500, end=1600)
    assert rows(ranged) == {g for g in GOOD if 1500 <= g[2] < 1600}


def test_chunks_out_of_range_are_not_even_read(spark, tmp_path):
    data = bytearray(encode_file(MESSAGES, CHANNELS, SCHEMAS, compression="zstd"))
    path = tmp_path / "damaged.mcap"
    path.write_bytes(data)
    chunks = read_recordings(spark, str(path), table="chunks").orderBy("chunk_offset").collect()
    last = chunks[-1]
    data[last.chunk_offset + 60:last.chunk_offset + 80] = bytes(20)
    path.write_bytes(data)
    early = read_recordings(spark, str(path)).where(f"log_time_ns < {last.start_time_ns}")
    assert rows(early) == {g for g in GOOD if g[2] < last.start_time_ns}
    with pytest.raises(Exception):
        read_recordings(spark, str(path)).collect()


def test_reversed_time_range(spark, folder):
    with pytest.raises(Exception, match="start time must be before end time"):
        read_recordings(spark, folder, start=5, end=4).count()
    with pytest.raises(ValueError):
        read_recordings(spark, folder, table="nothing")


def test_headers_only(spark, folder):
    df = read_recordings(spark, f"{folder}/zstd.mcap", payload="false")
    assert "payload" not in df.columns and df.count() == len(GOOD)


def facts(spark, folder, name, table, **options):
    return read_recordings(spark, f"{folder}/{name}.mcap", table=table, **options).drop("file").collect()


@pytest.mark.parametrize("name", VARIANTS)
def test_summary_tables(spark, folder, name):
    options = VARIANTS[name]
    (stats,) = facts(spark, folder, name, "statistics")
    counts = {c: sum(m[0] == c for m in MESSAGES) for c in (1, 2, 3, 7)}
    # a scan counts what is declared: the writer declares channel 3's missing schema nowhere
    assert (stats.messages, stats.channels, stats.schemas, stats.attachments, stats.metadata) == (100, 3, 1, 1, 1)
    assert stats.chunks == (10 if options.get("chunked", True) else 0)
    assert (stats.start_time_ns, stats.end_time_ns) == (1000, 1990)
    assert stats.channel_messages == counts
    assert stats.from_summary == (options.get("summary", True) and options.get("statistics", True))
    if options.get("repeat_dims", True):
        assert sorted((r.channel_id, r.topic, r.schema_id, r.metadata) for r in facts(spark, folder, name, "channels")) == [
            (1, "/a", 1, {"k": "v"}), (2, "/b", 0, {}), (3, "/c", 9, {})]
        assert [(r.schema_id, r.name, bytes(r.data)) for r in facts(spark, folder, name, "schemas")] == [
            (1, "demo::T", b"struct T {};")]
    assert [(r.name, r.media_type, r.data_bytes) for r in facts(spark, folder, name, "attachments")] == [
        ("a.txt", "text/plain", 5)]
    assert [r.name for r in facts(spark, folder, name, "metadata")] == ["m"]
    assert facts(spark, folder, name, "attachments") == facts(spark, folder, name, "attachments", summary="scan")


def test_summary_modes(spark, folder):
    assert facts(spark, folder, "zstd", "statistics", summary="scan")[0].from_summary is False
    assert facts(spark, folder, "zstd", "chunks", summary="strict")[0].channel_ids == [1, 2, 3, 7]
    assert facts(spark, folder, "zstd", "chunks", summary="scan")[0].channel_ids is None
    for name in ("no_summary", "no_statistics"):
        with pytest.raises(Exception, match="no usable summary"):
            facts(spark, folder, name, "statistics", summary="strict")


def test_a_cut_off_file_gives_its_whole_records(spark, folder, tmp_path):
    data = open(f"{folder}/no_summary.mcap", "rb").read()
    (tmp_path / "cut.mcap").write_bytes(data[:len(data) // 2])
    got = rows(read_recordings(spark, str(tmp_path / "cut.mcap")))
    assert got and got < GOOD
    (tmp_path / "junk.mcap").write_bytes(b"junk" * 50)
    with pytest.raises(Exception, match="not a recording file"):
        read_recordings(spark, str(tmp_path / "junk.mcap")).count()


def test_times_up_to_the_last_one(spark, tmp_path):
    last = 2**63 - 1
    rows = [(1, 0, 5, b"a"), (1, 1, last, b"b"), (1, 2, last + 9, b"c")]
    for name, options in (("chunked", {}), ("plain", {"chunked": False})):
        (tmp_path / f"{name}.mcap").write_bytes(encode_file(rows, CHANNELS, SCHEMAS, **options))
        path = str(tmp_path / f"{name}.mcap")
        assert {r.log_time_ns for r in read_recordings(spark, path).collect()} == {5, last}
        assert [r.log_time_ns for r in read_recordings(spark, path, end=last).collect()] == [5]
        told = read_recordings(spark, path, table="dangling").collect()
        assert [(r.log_time_ns, r.problem) for r in told] == [(None, f"time {last + 9} does not fit a bigint")]


def test_torn_files_are_reported(spark, tmp_path):
    whole = encode_file(MESSAGES, CHANNELS, SCHEMAS, chunked=False, summary=False)
    for name, data in {"whole": whole, "torn": whole[:len(whole) // 2], "short": whole[:3], "other": b"text" * 9, "tail": whole[:-4]}.items():
        (tmp_path / f"{name}.mcap").write_bytes(data)
    told = {r.file.rpartition("/")[2]: r for r in read_recordings(spark, str(tmp_path), table="problems").collect()}
    assert set(told) == {"torn.mcap", "short.mcap", "other.mcap", "tail.mcap"}
    assert "cut off" in told["torn.mcap"].problem and 0 < told["torn.mcap"].offset < len(whole) // 2
    assert told["short.mcap"].problem == told["other.mcap"].problem == "not a recording file" and told["tail.mcap"].problem == "no closing mark"


@pytest.mark.parametrize("name", VARIANTS)
def test_files_as_canonical_tables(spark, folder, name):
    path = f"{folder}/{name}.mcap"
    got = file_messages(spark, path, rangeBytes=1500).orderBy("arrival_seq").collect()
    want = [(CHANNELS[c][0], t, len(p)) for c, s, t, p in MESSAGES if c in (1, 2)]
    assert [(r.topic, r.log_time_ns, r.payload_bytes) for r in got] == want and [r.arrival_seq for r in got] == list(range(len(want)))
    assert {r.topic for r in file_channels(spark, path, summary="scan").collect()} == {"/a", "/b", "/c"}
    assert [r.name for r in file_schemas(spark, path, summary="scan").collect()] == ["demo::T"]
    assert "payload" not in file_messages(spark, path, payload="false").columns


def parsed(data):
    """Record by record."""
    out, at = [], 0
    while at + 9 <= len(data):
        size = int.from_bytes(data[at + 1:at + 9], "little")
        if at + 9 + size > len(data):
            break
        out.append((at, data[at], size))
        at += 9 + size
    return out


def test_borders_of_records_of_equal_and_mixed_lengths():
    rng = random.Random(1)
    for sizes in ([40] * 1000, [0] * 50, [rng.randint(0, 60) for _ in range(500)], [30] * 100 + [31] + [30] * 100 + [7, 7, 7, 9] * 30, [], [5]):
        data = b"".join(rf._RECORD.pack(s).replace(b"\0", bytes([1 + s % 15]), 1) + bytes(rng.randbytes(s)) for s in sizes)
        for cut in (data, data[:-1], data + b"\5\0\0"):
            records = rf._records_in(cut)
            assert list(zip(records.starts.tolist(), records.tags.tolist(), records.sizes.tolist())) == parsed(cut)


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, handle):
        self.handle, self.bytes = handle, 0

    def __getattr__(self, name):
        return getattr(self.handle, name)

    def read(self, count):
        data = self.handle.read(count)
        self.bytes += len(data)
        return data


@pytest.mark.parametrize("name", ["no_summary", "no_summary_zstd", "unchunked", "unchunked_no_summary", "plain", "dims_in_chunks_only"])
def test_an_index_gives_the_same_rows(spark, folder, tmp_path, name):
    path, index = f"{folder}/{name}.mcap", str(tmp_path / "index")
    rf.index_recordings(spark, path, path=index, rangeBytes=1500)
    df = read_recordings(spark, path, index=index, rangeBytes=1500)
    assert df.count() == len(GOOD) and rows(df) == GOOD
    assert df.where("topic = '/a' and log_time_ns < 1300").count() == len([g for g in GOOD if g[0] == "/a" and g[2] < 1300])
    told = read_recordings(spark, path, index=index, rangeBytes=1500, table="dangling").collect()
    assert {r.problem for r in told} == {"missing channel 7", "missing schema 9"} and len(told) == len(MESSAGES) - len(GOOD)
    assert read_recordings(spark, path, index=index, rangeBytes=1500, table="problems").count() == 0
    if name not in ("plain", "dims_in_chunks_only"):  # a chunk index needs no rows here
        with pytest.raises(Exception, match="1500 bytes"):
            read_recordings(spark, path, index=index).count()


def test_ranges_with_an_index_read_each_byte_about_once(spark, tmp_path):
    """All ranges of an unchunked file together read less than twice its size; without an index they read it once a range."""
    many = [(1, i, 1000 + i, bytes(i % 700)) for i in range(30000)]
    path = tmp_path / "long.mcap"
    path.write_bytes(encode_file(many, CHANNELS, SCHEMAS, chunked=False, summary=False))
    size, step, index = path.stat().st_size, 1 << 20, str(tmp_path / "index")
    rf.index_recordings(spark, str(path), path=index, rangeBytes=step)
    known = rf._known(spark.read.parquet(index))[str(path)]
    read = {}
    for use in (known, None):
        total = found = 0
        for low in range(0, size, step):
            file = rf._File(str(path))
            file.handle = counting = Counting(file.handle)
            batches = list(rf._RangeReader(file, low, low + step, rf._Wanted(), False, use).batches())
            found += sum(len(b["offset"]) for b in batches)
            total += counting.bytes
        assert found == len(many)
        read[use is None] = total
    assert read[False] < 2 * size < read[True]


def test_damage_inside_chunks_is_reported(spark, tmp_path):
    for name, options in (("index", {}), ("walk", {"summary": False})):
        path = tmp_path / f"{name}.mcap"
        data = bytearray(encode_file(MESSAGES, CHANNELS, SCHEMAS, compression="zstd", **options))
        path.write_bytes(data)
        places = [r.chunk_offset for r in read_recordings(spark, str(path), table="chunks").orderBy("chunk_offset").collect()]
        data[places[4] + 60:places[4] + 90] = bytes(30)
        path.write_bytes(data)
        told = read_recordings(spark, str(path), table="problems", rangeBytes=1500).collect()
        assert [r.offset for r in told] == [places[4]] and "chunk" in told[0].problem


def test_no_call_a_message(monkeypatch):
    """Fields of all messages of a chunk are gathered at once, whatever their number."""
    data = b"".join(rf._RECORD.pack(22 + 8).replace(b"\0", b"\5", 1) + bytes(30) for _ in range(5000))
    calls = []
    monkeypatch.setattr(rf, "_Fields", lambda body: calls.append(body))
    records = rf._records_in(data)
    assert len(records.field(6, "<u8")) == 5000 and records.bodies_from(22, rf.np.arange(5000)).to_pylist() == [bytes(8)] * 5000 and not calls


def test_files_are_written_while_their_rows_pass_by():
    """A writer holds a chunk's rows, never a whole file's."""
    from tests.support.derived import _file_pieces
    taken = 0

    def rows():
        nonlocal taken
        for i in range(5000):
            taken += 1
            yield "r", 1, i, i * 10, f"/t{i % 3}", "T" if i % 3 else "", b"p" * 10

    seen = [(taken, len(piece)) for piece in _file_pieces(rows(), 1)]
    assert seen[1][0] == 200 and max(b - a for (a, _), (b, _) in zip(seen, seen[1:])) == 200
    assert len(seen) > 5000 // 200 and sum(size for _, size in seen) > 5000


def test_memory_of_a_writing_task_does_not_grow_with_its_file(spark, sf_dir, monkeypatch):
    """What a task runs over its sorted rows: each batch is in the file before the next but one, ten times the rows need no ten times the memory."""
    from tests.support import derived
    tasks = []

    def caught(rows, task, schema):
        tasks.append(task)
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", caught)
    folder = derived._write_files(spark, sf_dir)
    (task,) = tasks

    def peak(week, batches):
        file, sizes = Path(f"{folder}/r_{week}.mcap"), []

        def rows():
            for b in range(batches):
                sizes.append(file.stat().st_size if file.exists() else 0)
                at = range(b * 1000, b * 1000 + 1000)
                yield pa.RecordBatch.from_pydict(dict(zip(derived._ROWS, (
                    ["r"] * 1000, [week] * 1000, list(at), [i * 10 for i in at], [f"/t{i % 3}" for i in at], ["T"] * 1000,
                    [i.to_bytes(8, "big") * 20 for i in at]))))

        tracemalloc.start()
        told = list(task(rows()))
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [row for batch in told for row in batch.to_pylist()] == [{"path": str(file), "bytes": file.stat().st_size}]
        assert all(b > a for a, b in zip(sizes[1:], sizes[2:]))
        found = read_recordings(spark, str(file)).select("sequence", "log_time_ns", "payload").orderBy("sequence").collect()
        assert [(r.sequence, r.log_time_ns, bytes(r.payload)) for r in found] == [(i, i * 10, i.to_bytes(8, "big") * 20) for i in range(batches * 1000)]
        return held

    assert peak(1, 40) < 2 * peak(2, 4)
