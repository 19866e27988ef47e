"""Payload decoding, on message shapes like those of the example interfaces."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest

from tests.support.encode import encode, encode_column
from tidewire.functions.wire import Array, Enum, Primitive, Sequence, Text, Union, from_tables, struct
from tidewire.operators.decode import (BAD_HEADER, MALFORMED, TOO_SHORT, UNSUPPORTED, decode, decode_all, decode_batch,
                                       decode_tagged, echo)

F64, BYTE = Primitive("float64"), Primitive("byte")
VECTOR = struct(x="float64", y="float64", z="float64")
VALUE = Union(Enum(((0, "NONE"), (1, "INT"), (2, "FLOAT"), (3, "STR"), (4, "BIN"))), (
    ((0,), "empty_flag", Primitive("boolean")), ((1,), "int_val", Primitive("int32")), ((2,), "float_val", F64),
    ((3,), "str_val", Text()), ((4,), "binary_val", Sequence(BYTE))))
STATUS = Enum(((0, "OK"), (1, "WARN"), (2, "ERROR")))

SHAPES = {
    "sensor": struct(id="int32", timestamp="float64", values=Array(Primitive("float32"), (3,)), name=Text()),
    "robot": struct(sec="int64", frame=Text(), position=VECTOR,
                    joints=Sequence(struct(name=Text(), position="float64", effort="float64")),
                    is_active="boolean", status_code="int16"),
    "fixed": struct(color=Array(Primitive("int32"), (3,)), transform=Array(F64, (3, 3)), raw=Array(BYTE, (64,)),
                    names=Array(Text(), (4,))),
    "sequences": struct(doubles=Sequence(F64), ints=Sequence(Primitive("int32")), names=Sequence(Text()),
                        data=Sequence(BYTE), grid=Sequence(Sequence(F64))),
    "diagnostic": struct(timestamp="int64", short="int16", ushort="uint16", ulong="uint32", ulonglong="uint64",
                         letter="char", flag="boolean", octet="byte", f="float32", valid="boolean"),
    "status": struct(status=STATUS, joints=Sequence(struct(name=Text(), kind=STATUS, limit="float64"))),
    "command": struct(number="uint32", value=VALUE, history=Sequence(VALUE), wide=Union(
        Primitive("int64"), (((0,), "success", Primitive("boolean")), ((1, 2), "code", Primitive("int32"))))),
}


def make(kind, rng):
    """A random value in the form the encoder takes, and the form the decoder gives."""
    if isinstance(kind, Primitive):
        value = {"boolean": lambda: rng.random() < 0.5, "byte": lambda: rng.randint(0, 255), "char": lambda: rng.choice("aZ9"),
                 "int16": lambda: rng.randint(-2**15, 2**15 - 1), "uint16": lambda: rng.randint(0, 2**16 - 1),
                 "int32": lambda: rng.randint(-2**31, 2**31 - 1), "uint32": lambda: rng.randint(0, 2**32 - 1),
                 "int64": lambda: rng.randint(-2**63, 2**63 - 1), "uint64": lambda: rng.randint(0, 2**64 - 1),
                 "float32": lambda: rng.randint(-1000, 1000) / 8, "float64": rng.random}[kind.kind]()
        return value, Decimal(value) if kind.kind == "uint64" else value
    if isinstance(kind, Text):
        value = "".join(rng.choice("aé漢 ") for _ in range(rng.randint(0, 6)))
        return value, value
    if isinstance(kind, Enum):
        value = rng.choice([0, 1, 2, 77, -3])
        return value, dict(kind.literals).get(value, str(value))
    if isinstance(kind, Union):
        tag = rng.choice([label for labels, _, _ in kind.cases for label in labels] + [99])
        decoded, encoded = {"_d": tag, **{name: None for _, name, _ in kind.cases}}, None
        for labels, name, case in kind.cases:
            if tag in labels:
                encoded, decoded[name] = make(case, rng)
        return (tag, encoded), decoded
    if isinstance(kind, (Sequence, Array)):
        pairs = [make(kind.item, rng) for _ in range(kind.length if isinstance(kind, Array) else rng.randint(0, 4))]
        return [p[0] for p in pairs], [p[1] for p in pairs]
    pairs = {name: make(field, rng) for name, field in kind.fields}
    return {n: p[0] for n, p in pairs.items()}, {n: p[1] for n, p in pairs.items()}


@pytest.mark.parametrize("name", SHAPES)
def test_round_trip_in_every_layout(name):
    rng, kind = random.Random(name), SHAPES[name]
    values = [make(kind, rng) for _ in range(120)]
    payloads = [encode(value, kind, [0, 1, 6, 7, 8, 9][i % 6]) for i, (value, _) in enumerate(values)]
    decoded, error = decode_batch(pa.array(payloads, pa.binary()), kind)
    assert error.null_count == len(values)
    assert decoded.to_pylist() == [want for _, want in values]


@pytest.mark.parametrize("name", SHAPES)
def test_every_truncation_is_reported(name):
    rng, kind = random.Random(name), SHAPES[name]
    whole = encode(make(kind, rng)[0], kind)
    cuts = [whole[:n] for n in range(len(whole))]
    decoded, error = decode_batch(pa.array(cuts, pa.binary()), kind)
    assert decoded.null_count == len(cuts)
    assert error.to_pylist() == [TOO_SHORT] * 5 + [MALFORMED] * (len(cuts) - 5)


def test_random_bytes_never_break_a_batch():
    rng = random.Random(1)
    good = encode(make(SHAPES["command"], rng)[0], SHAPES["command"])
    noise = [bytes([0, 1, 0, 0]) + rng.randbytes(rng.randint(1, 80)) for _ in range(500)]
    decoded, error = decode_batch(pa.array([*noise, good], pa.binary()), SHAPES["command"])
    assert error[-1].as_py() is None and decoded[-1].as_py() is not None


def test_reasons():
    kind = struct(a="int32")
    rows = [None, b"", b"\0\1\0\0", b"\1\1\0\0abcd", b"\0\2\0\0abcd", b"\0\x0a\0\0abcd", b"\0\1\0\0abc", b"\0\1\0\0\5\0\0\0rest"]
    _, error = decode_batch(pa.array(rows, pa.binary()), kind)
    assert error.to_pylist() == [TOO_SHORT] * 3 + [BAD_HEADER] * 2 + [UNSUPPORTED, MALFORMED, None]


def test_bad_text_is_reported():
    kind = struct(s=Text(), n="int32")
    rows = [encode({"s": b"\xff\xfe", "n": 1}, kind), encode({"s": "ok", "n": 2}, kind)]
    decoded, error = decode_batch(pa.array(rows, pa.binary()), kind)
    assert error.to_pylist() == [MALFORMED, None] and decoded[1].as_py() == {"s": "ok", "n": 2}


def test_sliced_batches():
    kind = struct(n="int32")
    rows = pa.array([encode({"n": i}, kind) for i in range(10)], pa.binary())
    decoded, _ = decode_batch(rows.slice(3, 4), kind)
    assert [d["n"] for d in decoded.to_pylist()] == [3, 4, 5, 6]


def test_a_longer_struct_of_a_newer_sender_is_skipped():
    new, old = struct(p=struct(a="int32", b="float64"), n="int16"), struct(p=struct(a="int32"), n="int16")
    payload = encode({"p": {"a": 1, "b": 2.5}, "n": 3}, new, 9)
    decoded, error = decode_batch(pa.array([payload], pa.binary()), old)
    assert (decoded[0].as_py(), error[0].as_py()) == ({"p": {"a": 1}, "n": 3}, None)


def test_decode_splits_good_and_bad_rows(spark):
    kind = struct(id="int64", name=Text())
    df = spark.range(100).selectExpr("id", "concat('n', id) as name").mapInArrow(
        encode_column(kind, lambda i: i % 2), "id bigint, name string, payload binary")
    mixed = df.selectExpr("id as key", "case when id % 10 = 3 then substr(payload, 1, 9) else payload end as payload")
    good, bad = decode(mixed, kind)
    assert good.columns == ["key", "id", "name"]
    assert {(r.key, r.id, r.name) for r in good.collect()} == {(i, i, f"n{i}") for i in range(100) if i % 10 != 3}
    assert {(r.key, r.error) for r in bad.collect()} == {(i, MALFORMED) for i in range(3, 100, 10)}
    assert decode_tagged(mixed, kind).schema["decoded"].dataType == kind.spark()


def test_decode_by_type(spark):
    a, b = struct(id="int64"), struct(id="int64", f="float64")
    first = spark.range(5).mapInArrow(encode_column(a, lambda i: 1), "id bigint, payload binary")
    second = spark.range(7).selectExpr("id", "id / 2 as f").mapInArrow(
        encode_column(b, lambda i: 7), "id bigint, f double, payload binary")
    mixed = first.selectExpr("'A' as type_name", "payload").unionByName(second.selectExpr("'B' as type_name", "payload"))
    out = decode_all(mixed, {"A": a, "B": b})
    assert sorted(r.id for r in out["A"][0].collect()) == list(range(5))
    assert sorted(r.f for r in out["B"][0].collect()) == [i / 2 for i in range(7)]
    assert out["A"][1].count() == out["B"][1].count() == 0


def test_echo(spark):
    kind = struct(b="int32", a=Text())
    rows = [("/t", 3, 1_500_000_000, True, encode({"b": 3, "a": "x"}, kind)), ("/t", 1, -1, True, b"\0\1\0\0\1"),
            ("/t", 2, 5, False, encode({"b": 2, "a": "y"}, kind)), ("/u", 0, 5, True, encode({"b": 9, "a": "z"}, kind)),
            ("/t", 4, 7, True, encode({"b": 4, "a": "w"}, kind))]
    df = spark.createDataFrame(rows, "topic string, arrival_seq bigint, source_time_ns bigint, valid boolean, payload binary")
    assert [tuple(r) for r in echo(df, "/t", kind, 2).collect()] == [
        (1, "-1.999999999", None, MALFORMED), (3, "1.500000000", '{"a":"x","b":3}', None)]
    assert echo(df, "/t", kind).count() == 3


def test_types_out_of_tables(spark):
    members = spark.createDataFrame([
        ("Top", 0, "id", "int32", None, None, None), ("Top", 1, "pose", "array", "float64", [2, 3], None),
        ("Top", 2, "joints", "sequence", "struct", None, "Joint"), ("Top", 3, "state", "enum", None, None, "State"),
        ("Top", 4, "value", "union", None, None, "Value"), ("Joint", 0, "name", "string", None, None, None),
        ("Value", 0, "_d", "int32", None, None, None), ("Value", 1, "i", "int32", None, None, None),
        ("Value", 2, "s", "string", None, None, None), ("Other", 0, "x", "int32", None, None, None),
    ], "type_name string, pos int, member string, kind string, elem_kind string, dims array<int>, ref_type string")
    literals = spark.createDataFrame([("State", 0, "ON"), ("State", 1, "OFF")], "type_name string, value int, literal string")
    labels = spark.createDataFrame([("Value", 1, "i"), ("Value", 2, "i"), ("Value", 3, "s")],
                                   "type_name string, label int, member string")
    assert from_tables("Top", members, literals, labels) == struct(
        id="int32", pose=Array(F64, (2, 3)), joints=Sequence(struct(name=Text())), state=Enum(((0, "ON"), (1, "OFF"))),
        value=Union(Primitive("int32"), (((1, 2), "i", Primitive("int32")), ((3,), "s", Text()))))
    with pytest.raises(KeyError):
        from_tables("Nobody", members, literals, labels)


@pytest.mark.parametrize("header", [0, 1, 6, 7])
def test_sequences_of_fixed_structs_are_read_in_three_steps(monkeypatch, header):
    """Whatever the number of items: the first, the second, and all others at once. Odd sizes, so that padding differs."""
    from tidewire.operators import decode as module
    rng = random.Random(header)
    for kind in (struct(a="byte", b="float64"), struct(b="float64", a="byte"), struct(a="int16", b="byte"), struct(v=VECTOR, s=STATUS, f="boolean")):
        whole = struct(lead="byte", items=Sequence(kind), last="int32")
        rows = []
        for n in (0, 1, 2, 3, 50, 400):
            values = [make(kind, rng) for _ in range(n)]
            rows.append(({"lead": 1, "items": [v for v, _ in values], "last": n}, {"lead": 1, "items": [d for _, d in values], "last": n}))
        payloads = pa.array([encode(value, whole, header) for value, _ in rows], pa.binary())
        calls = []
        plain = module._struct
        monkeypatch.setattr(module, "_struct", lambda cursor, of: calls.append(of == kind) or plain(cursor, of))
        decoded, error = decode_batch(payloads, whole)
        monkeypatch.setattr(module, "_struct", plain)
        assert error.null_count == len(rows) and decoded.to_pylist() == [want for _, want in rows] and sum(calls) == 3
        cut = pa.array([p.as_py()[:-9] for p in payloads], pa.binary())
        decoded, error = decode_batch(cut, whole)
        assert error.to_pylist() == [MALFORMED] * len(rows) or error.to_pylist()[1:] == [MALFORMED] * (len(rows) - 1)


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """Rows of many sizes come out whole and in order, a batch no larger than the limit or one row."""
    from tidewire.operators import decode as module
    kind = struct(name=Text(), data=Sequence(BYTE))
    values = [{"name": "x" * (i % 7), "data": [i % 256] * (i * 37 % 900)} for i in range(200)]
    payloads = [encode(v, kind) for v in values] + [None, b""]
    monkeypatch.setattr(module, "BATCH_BYTES", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(202)), pa.array(payloads, pa.binary())], ["n", "payload"])
    parts = list(module.bounded(iter([batch, batch.slice(0, 0)]), 1))
    assert [n for part in parts for n in part.column(0).to_pylist()] == list(range(202)) and len(parts) > 20
    assert all(part.num_rows <= 1 or sum(len(p or b"") for p in part.column(1).to_pylist()) <= 2000 for part in parts)
    found = [row for part in parts for row in decode_batch(part.column(1), kind)[0].to_pylist()]
    assert found[:200] == values


def test_messages_find_their_types_without_a_shuffle_by_topic(spark, tmp_path):
    from tidewire.operators.decode import decode_discovered
    from tidewire.operators.types import TypeTables
    """A few topics hold all messages; sent by topic they would meet in as many tasks."""
    spark.createDataFrame([("/a", b"\x00\x01\x00\x00\x01\x00\x00\x00"), ("/b", b""), (None, b"")], "topic string, payload binary").write.parquet(str(tmp_path / "m"))
    tables = TypeTables(
        spark.createDataFrame([("A", 0, "x", "int32", None, None, None)],
                              "type_name string, pos int, member string, kind string, elem_kind string, dims array<int>, ref_type string"),
        spark.createDataFrame([], "type_name string, value int, literal string"), spark.createDataFrame([], "type_name string, label int, member string"))
    announced = spark.createDataFrame([("/a", "A"), ("/c", "C")], "topic string, type_name string")
    typed, unknown = decode_discovered(spark.read.parquet(str(tmp_path / "m")), announced, tables)
    assert [r.x for r in typed["A"][0].collect()] == [1] and unknown.count() == 2
    plan = unknown._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
