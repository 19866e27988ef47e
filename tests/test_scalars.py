import pytest
from pyspark.sql import functions as F

from tidewire.functions import render, scalars


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_guid_text(spark):
    got = values(spark, [(bytes(16),), (bytes(range(16)),), (None,)], "g binary", scalars.guid_text("g"))
    assert got == [("00000000.00000000.00000000.00000000",), ("00010203.04050607.08090a0b.0c0d0e0f",),
                   ("00000000.00000000.00000000.00000000",)]


def test_guid_order(spark):
    rows = spark.createDataFrame([("0100" + "0" * 28,), ("00ff" + "0" * 28,)], "guid string")
    assert [r.guid[:4] for r in rows.orderBy("guid").collect()] == ["00ff", "0100"]


def test_sizes_and_durations(spark):
    sizes = {"1G": 1 << 30, "1.5M": 1572864, "2k": 2048, "3": 3145728, "2g": 2 << 30, "7K": 7168, "4x": 4 << 20,
             "nonsense": 0, "1e3k": 1024000, " .5M": 524288}
    got = values(spark, [(k,) for k in sizes], "s string", "s", scalars.size_bytes("s"))
    assert dict(got) == sizes
    durations = {"5m": 300.0, "2h": 7200.0, "10": 10.0, "1.5h": 5400.0, "3s": 3.0}
    got = values(spark, [(k,) for k in durations], "s string", "s", scalars.duration_seconds("s"))
    assert dict(got) == durations


def test_sec_nsec(spark):
    stamps = {1772686402862456386: "1772686402.862456386", 5: "0.000000005", -1: "-1.999999999", 0: "0.000000000",
              -1_000_000_000: "-1.000000000", 999_999_999: "0.999999999"}
    got = values(spark, [(k,) for k in stamps], "t bigint", "t", scalars.sec_nsec("t"))
    assert dict(got) == stamps


def test_floor_div_is_exact(spark):
    tick = 60_000_000_000
    edge = 28_400_000 * tick
    got = values(spark, [(edge - 1,), (edge,), (-1,)], "t bigint", scalars.floor_div("t", tick))
    assert got == [(28_399_999,), (28_400_000,), (-1,)]


@pytest.mark.parametrize("code,version,big", [(0, 1, True), (1, 1, False), (6, 2, True), (7, 2, False), (8, 2, True),
                                              (9, 2, False), (10, 2, True), (11, 2, False)])
def test_valid_headers(spark, code, version, big):
    payload = bytes([0, code, 0, 0, 9])
    e = scalars.encapsulation("p")
    got = values(spark, [(payload,)], "p binary", e["valid"], e["version"], e["big_endian"], scalars.framed("p"))
    assert got == [(True, version, big, payload)]


@pytest.mark.parametrize("payload", [b"\x00\x02\x00\x00", b"\x01\x00\x00\x00z", b"\x00\x0c\x00\x00", b"\x00\x11\x00\x00"])
def test_other_headers_get_one_in_front(spark, payload):
    e = scalars.encapsulation("p")
    got = values(spark, [(payload,)], "p binary", e["valid"], e["version"], scalars.framed("p"))
    assert got == [(False, None, b"\x00\x01\x00\x00" + payload)]


def test_short_payload_is_left_alone(spark):
    got = values(spark, [(b"ab",), (b"",)], "p binary", scalars.encapsulation("p")["valid"], scalars.framed("p"))
    assert got == [(False, b"ab"), (False, b"")]


def test_type_path_and_array_len(spark):
    path = scalars.type_path("n")
    got = values(spark, [("a::b::C",), ("C",)], "n string", path["modules"], path["short_name"])
    assert got == [(["a", "b"], "C"), ([], "C")]
    got = values(spark, [([3, 4],), ([7],), ([],)], "d array<int>", scalars.array_len("d"))
    assert got == [(12,), (7,), (1,)]


def test_participant_label(spark):
    rows = [("p", "h", "1", "e", "p [1] @ h"), ("", "h", "", "e", "(unknown) @ h"), ("p", "", "", "", "p"),
            ("", "", "1", "e", "e"), (None, None, None, None, "(unknown)")]
    got = values(spark, rows, "process_name string, hostname string, pid string, entity_name string, want string",
                 scalars.participant_label(), "want")
    assert all(a == b for a, b in got)


def test_recording_name(spark):
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    got = values(spark, [("rec", 3)], "p string, s bigint", scalars.recording_name("p"),
                 scalars.recording_name("p", start), scalars.recording_name("p", start, F.col("s")),
                 scalars.recording_name("p", None, F.col("s")))
    assert got == [("rec.mcap", "rec_2023-11-14-22-13-20.mcap", "rec_2023-11-14-22-13-20_3.mcap", "rec_3.mcap")]


def test_json_sorts_members_at_every_depth(spark):
    df = spark.sql("""select struct(2 as z, array(struct(1 as y, cast(null as int) as x)) as a) as v, 1 as b""")
    assert df.select(render.render_json(df)).first()[0] == '{"b":1,"v":{"a":[{"y":1}],"z":2}}'
    assert df.select(render.render_json(df, sort_keys=False)).first()[0] == '{"v":{"z":2,"a":[{"y":1}]},"b":1}'
    assert "\n" in df.select(render.render_json(df, ["b"], pretty=True)).first()[0]


def test_union_without_label_shows_only_the_discriminator(spark):
    value = render.union_select(F.col("d"), {"i": ([1, 2], F.lit(7)), "s": ([3], F.lit("x"))})
    got = values(spark, [(1,), (2,), (3,), (9,)], "d int", F.to_json(value))
    assert [g[0] for g in got] == ['{"_d":1,"i":7}', '{"_d":2,"i":7}', '{"_d":3,"s":"x"}', '{"_d":9}']


def test_explode_sequence_keeps_empty_ones(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, s array<string>")
    got = sorted((tuple(r) for r in render.explode_sequence(df, "s").collect()), key=repr)
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, None, None), (3, None, None)]
