"""Registered queries over inputs that Spark encodes from the test tables: payloads and recording files.

The encoders are test code; the library only reads such data.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.support.recording_encoder import encoded
from tidewire.functions.scalars import floor_div
from tidewire.functions.wire import Text
from tidewire.functions.wire import struct as wire_struct
from tidewire.operators import decode, rates
from tidewire.operators.types import TypeTables
from tidewire.plans.rates import rounded
from tidewire.plans.recordings import typed_messages
from tidewire.plans.registry import query
from tidewire.session import scratch_path, ship
from tidewire.sources import views
from tidewire.sources.files import located
from tidewire.sources.recording_files import file_channels, file_messages, file_schemas, read_recordings

LINE = wire_struct(l_orderkey="int64", l_linenumber="int32", l_quantity="float64", l_returnflag=Text(),
                   l_extendedprice="float64")
ORDER = wire_struct(o_orderkey="int64", o_orderstatus=Text(), o_custkey="int64", o_totalprice="float64")
# Byte layouts of the same members behind a 4-byte header, alignment padding and string lengths written out.
_LAYOUTS = {
    "demo::Line": [("l_orderkey", 4, "<i8"), ("l_linenumber", 12, "<i4"), ("l_quantity", 20, "<f8"),
                   ("", 28, "<i4"), ("l_returnflag", 32, "S1"), ("l_extendedprice", 36, "<f8")],
    "demo::Order": [("o_orderkey", 4, "<i8"), ("", 12, "<i4"), ("o_orderstatus", 16, "S1"),
                    ("o_custkey", 20, "<i8"), ("o_totalprice", 28, "<f8")],
}
CATALOG = {"demo::Line": LINE, "demo::Order": ORDER}


def _encoder(type_name: str):
    layout = _LAYOUTS[type_name]
    size = layout[-1][1] + 8

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, size), np.uint8)
            out[:, 1] = 1
            for name, at, code in layout:
                # an unnamed entry is the length of the one-letter string behind it
                column = batch.column(name).to_numpy(zero_copy_only=False) if name else np.full(len(out), 2)
                values = column.astype(code)
                width = values.dtype.itemsize
                out[:, at:at + width] = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(out), [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([type_name] * len(out)), raw.cast(pa.binary())],
                                             names=[*batch.schema.names, "type_name", "payload"])

    return run


def _encoded(spark, sf, table: str, type_name: str, *others: str):
    ship(spark, Path(__file__).resolve().parents[1])
    members = [name for name, _, _ in _LAYOUTS[type_name] if name]
    rows = views.table(spark, sf, table).select(*members, *others)
    fields = [T.StructField("type_name", T.StringType()), T.StructField("payload", T.BinaryType())]
    return rows.mapInArrow(_encoder(type_name), T.StructType(rows.schema.fields + fields))


@query("decode_payloads", """
select l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice from lineitem""")
def decode_payloads(spark, sf):
    good, _ = decode.decode(_encoded(spark, sf, "lineitem", "demo::Line").select("payload"), LINE)
    return good


@query("decode_quarantine", """
select 'malformed' as error, count(*) filter (l_linenumber % 2 = 0) as payloads, 32 as bytes from lineitem
union all select 'bad header', count(*) filter (l_linenumber % 2 = 1), 40 from lineitem""")
def decode_quarantine(spark, sf):
    """Every payload damaged: half are cut short, the others have lost their header."""
    whole = _encoded(spark, sf, "lineitem", "demo::Line")
    number = F.conv(F.hex(F.substring("payload", 13, 1)), 16, 10).cast("int")
    cut = F.when(number % 2 == 0, F.substring("payload", 1, 32)).otherwise(F.concat(
        F.unhex(F.lit("FF")), F.substring("payload", 6, 39)))
    _, bad = decode.decode(whole.select(cut.alias("payload")), LINE)
    return bad.groupBy("error", F.octet_length("payload").alias("bytes")).agg(F.count("*").alias("payloads"))


@query("decode_by_topic", """
select 'demo::Line' as type_name, l_orderkey as key, l_returnflag as letter, count(*) as n,
       round(sum(l_extendedprice), 2) as total from lineitem group by l_orderkey, l_returnflag
union all
select 'demo::Order', o_orderkey, o_orderstatus, count(*), round(sum(o_totalprice), 2)
from orders group by o_orderkey, o_orderstatus""")
def decode_by_topic(spark, sf):
    mixed = (_encoded(spark, sf, "lineitem", "demo::Line").select("type_name", "payload")
             .unionByName(_encoded(spark, sf, "orders", "demo::Order").select("type_name", "payload")))
    typed = decode.decode_all(mixed, CATALOG)
    lines, orders = typed["demo::Line"][0], typed["demo::Order"][0]
    rows = lines.select("type_name", F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("letter"),
                        F.col("l_extendedprice").alias("price")).unionByName(
        orders.select("type_name", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("letter"),
                      F.col("o_totalprice").alias("price")))
    return rows.groupBy("type_name", "key", "letter").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


# Types as discovery describes them; what orders of status P hold is described nowhere, and topic /lines/N has no type.
_DESCRIBED = [
    ("demo::Line", 0, "l_orderkey", "int64", None, None, None), ("demo::Line", 1, "l_linenumber", "int32", None, None, None),
    ("demo::Line", 2, "l_quantity", "float64", None, None, None), ("demo::Line", 3, "l_returnflag", "string", None, None, None),
    ("demo::Line", 4, "l_extendedprice", "float64", None, None, None), ("demo::Order", 0, "o_orderkey", "int64", None, None, None),
    ("demo::Order", 1, "o_orderstatus", "string", None, None, None), ("demo::Order", 2, "party", "struct", None, None, "demo::Party"),
    ("demo::Party", 0, "o_custkey", "int64", None, None, None), ("demo::Party", 1, "o_totalprice", "float64", None, None, None),
]


@query("decode_discovered", """
select 'demo::Line' as type_name, l_orderkey as key, l_returnflag as letter, null::varchar as problem, count(*) as n,
       round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag <> 'N' group by l_orderkey, l_returnflag
union all
select 'demo::Order', o_orderkey, o_orderstatus, null, count(*), round(sum(o_totalprice), 2)
from orders where o_orderstatus <> 'P' group by o_orderkey, o_orderstatus
union all
select 'demo::Lost', null, null, 'no description of demo::Lost', count(*), null from orders where o_orderstatus = 'P' having count(*) > 0
union all
select null, null, null, 'topic without a type', count(*), null from lineitem where l_returnflag = 'N' having count(*) > 0""")
def decode_discovered(spark, sf):
    """Each payload decoded by the type its topic was announced with, out of the type tables; what has none is told."""
    mixed = _encoded(spark, sf, "lineitem", "demo::Line").selectExpr("concat('/lines/', l_returnflag) as topic", "payload").unionByName(
        _encoded(spark, sf, "orders", "demo::Order").selectExpr("concat('/orders/', o_orderstatus) as topic", "payload"))
    announced = spark.createDataFrame([("/lines/A", "demo::Line"), ("/lines/R", "demo::Line"), ("/orders/F", "demo::Order"),
                                       ("/orders/O", "demo::Order"), ("/orders/P", "demo::Lost")], "topic string, type_name string")
    types = TypeTables(
        spark.createDataFrame(_DESCRIBED, "type_name string, pos int, member string, kind string, elem_kind string, dims array<int>, ref_type string"),
        spark.createDataFrame([], "type_name string, value int, literal string"), spark.createDataFrame([], "type_name string, label int, member string"))
    typed, unknown = decode.decode_discovered(mixed, announced, types)
    lines, orders = typed["demo::Line"][0], typed["demo::Order"][0]
    rows = lines.select("type_name", F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("letter"), F.lit(None).cast("string").alias("problem"),
                        F.col("l_extendedprice").alias("price")).unionByName(
        orders.select("type_name", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("letter"), F.lit(None).cast("string").alias("problem"),
                      F.col("party.o_totalprice").alias("price"))).unionByName(
        unknown.select("type_name", F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("letter"), "problem",
                       F.lit(None).cast("double").alias("price")))
    return rows.groupBy("type_name", "key", "letter", "problem").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("echo", """
select o_orderkey as arrival_seq, concat(epoch_us(o_orderdate) // 1000000, '.000000000') as stamp,
       to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus,
                'o_totalprice': o_totalprice})::varchar as json, null::varchar as error
from orders where o_orderstatus = 'F' order by o_orderkey limit 100""")
def echo(spark, sf):
    orders = _encoded(spark, sf, "orders", "demo::Order", "o_orderdate").selectExpr(
        "concat('/orders/', o_orderstatus) as topic", "o_orderkey as arrival_seq",
        "unix_micros(cast(o_orderdate as timestamp)) * 1000 as source_time_ns", "true as valid", "payload")
    return decode.echo(orders, "/orders/F", ORDER, 100)


# --- recording files: one per recording and week, messages in arrival order ------------------------------------

_WEEK = 7 * 86_400 * 1_000_000_000


_ROWS = ["recording_id", "week", "arrival_seq", "log_time_ns", "topic", "type_name", "payload"]


def _sorted_rows(batches):
    """Rows as tuples, a batch at a time."""
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _file_pieces(rows, week: int):
    """The pieces of one file out of its rows in order; topics and types are numbered as they appear."""
    channels, schemas, ids, kinds = {}, {}, {}, {}
    count, last = 0, None

    def messages():
        nonlocal count, last
        for _, _, sequence, log_time, topic, type_name, payload in rows:
            if topic not in ids:
                if type_name and type_name not in kinds:
                    kinds[type_name] = len(kinds) + 1
                    schemas[kinds[type_name]] = (type_name, "omgidl", b"")
                ids[topic] = len(ids) + 1
                channels[ids[topic]] = (topic, "cdr", kinds[type_name] if type_name else 0, {})
            count, last = count + 1, log_time if last is None else max(last, log_time)
            yield ids[topic], sequence, log_time, payload

    def attachments():
        yield "rows.txt", "text/plain", last, b"." * count

    return encoded(messages(), channels, schemas, chunk_rows=200, compression="zstd" if week % 2 else "lz4",
                   attachments=attachments(), metadata=[("week", {"number": str(week)})])


def _write_files(spark, sf, damaged: bool = False) -> str:
    ship(spark, Path(__file__).resolve().parents[1])
    folder = scratch_path(spark, "files")

    def write(batches):
        system, inner = located(folder)
        for (recording_id, week), rows in groupby(_sorted_rows(batches), key=itemgetter(0, 1)):
            system.create_dir(inner, recursive=True)
            name, size, held = f"{recording_id}_{week}.mcap", 0, b""
            with system.open_output_stream(f"{inner}/{name}") as out:
                for piece in _file_pieces(rows, week):
                    out.write(held)
                    size, held = size + len(held), piece
                held = held[:-20] if damaged and week % 2 else held
                out.write(held)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size + len(held)]})

    # a file is written as its sorted rows pass by, so no task holds more of it than a batch and the index of its chunks
    msgs = typed_messages(spark, sf).withColumn("week", floor_div("log_time_ns", _WEEK)).select(*_ROWS)
    in_order = msgs.repartition("recording_id", "week").sortWithinPartitions("recording_id", "week", "arrival_seq")
    written = in_order.mapInArrow(write, "path string, bytes long")
    written.agg(F.sum("bytes")).collect()
    return folder


@query("read_mcap", f"""
select concat(recording_id, '_', log_time_ns // {_WEEK}) as file, topic, type_name as schema_name,
       arrival_seq as sequence, log_time_ns, log_time_ns as publish_time_ns, to_hex(payload) as payload_hex
from (select * replace (nullif(type_name, '') as type_name) from typed_messages)
where log_time_ns >= 1704700000000000000 and log_time_ns < 1705900000000000000 and not starts_with(topic, '/error')""")
def read_mcap(spark, sf):
    rows = read_recordings(spark, _write_files(spark, sf), start=1704700000000000000, rangeBytes=100_000)
    return (rows.where("log_time_ns < 1705900000000000000 and not startswith(topic, '/error')")
            .select(F.regexp_extract("file", r"([^/]+)\.mcap$", 1).alias("file"), "topic", "schema_name", "sequence",
                    "log_time_ns", "publish_time_ns", F.hex("payload").alias("payload_hex")))


@query("summary_mcap", f"""
select concat(recording_id, '_', log_time_ns // {_WEEK}) as file, count(*) as messages,
       count(distinct topic) as channels, count(distinct nullif(type_name, ''))::int as schemas,
       (count(*) + 199) // 200 as chunks, min(log_time_ns) as start_time_ns, max(log_time_ns) as end_time_ns,
       (count(*) + 199) // 200 as chunk_rows
from typed_messages group by 1""")
def summary_mcap(spark, sf):
    folder = _write_files(spark, sf)
    name = F.regexp_extract("file", r"([^/]+)\.mcap$", 1).alias("file")
    chunks = (read_recordings(spark, folder, table="chunks").select(name)
              .groupBy("file").agg(F.count("*").alias("chunk_rows")))
    return (read_recordings(spark, folder, table="statistics")
            .select(name, "messages", "channels", "schemas", "chunks", "start_time_ns", "end_time_ns")
            .join(chunks, "file"))


def _file_name(column: str = "recording_id"):
    return F.regexp_extract(column, r"([^/]+)\.mcap$", 1)


@query("hz_from_files", """
select file as recording_id, topic, round(1 / avg(dt), 9) as avg_hz, round(1 / max(dt), 9) as min_hz, round(1 / min(dt), 9) as max_hz,
       round(stddev_pop(dt) / (avg(dt) * avg(dt)), 9) as stddev_hz, count(*) as window
from (select file, topic, (t - lag(t) over (partition by file, topic order by arrival_seq)) / 1e9 as dt from newest)
group by file, topic having count(*) >= 2""", f"""
own as (select concat(recording_id, '_', log_time_ns // {_WEEK}) as file, topic, arrival_seq, log_time_ns as t from messages),
counted as (
  select * from (select *, t - max(t) over (partition by file, topic order by arrival_seq
                                            rows between unbounded preceding and 1 preceding) as step from own)
  where step is null or step > 0),
newest as (select * from counted qualify row_number() over (partition by file, topic order by arrival_seq desc) <= 20)""")
def hz_from_files(spark, sf):
    """Rates measured on recording files, every file a recording of its own."""
    msgs = file_messages(spark, _write_files(spark, sf), payload="false")
    return rounded(rates.hz(msgs, 20, 50)).withColumn("recording_id", _file_name())


@query("messages_from_files", f"""
select concat(recording_id, '_', log_time_ns // {_WEEK}) as recording_id, topic, type_name, log_time_ns, octet_length(payload) as payload_bytes,
       row_number() over (partition by recording_id, log_time_ns // {_WEEK} order by arrival_seq) - 1 as arrival_seq
from typed_messages""")
def messages_from_files(spark, sf):
    """Files in the form of the message table, numbered by their own order."""
    return file_messages(spark, _write_files(spark, sf)).select(
        _file_name().alias("recording_id"), "topic", "type_name", "log_time_ns", "payload_bytes", "arrival_seq")


@query("dims_from_files", f"""
select distinct concat(recording_id, '_', log_time_ns // {_WEEK}) as recording_id, topic, nullif(type_name, '') as name
from typed_messages""")
def dims_from_files(spark, sf):
    folder = _write_files(spark, sf)
    channels, schemas = file_channels(spark, folder), file_schemas(spark, folder).select("recording_id", "schema_id", "name")
    return channels.join(schemas, ["recording_id", "schema_id"], "left").select(_file_name().alias("recording_id"), "topic", "name")


@query("attachments_mcap", f"""
select concat(recording_id, '_', log_time_ns // {_WEEK}) as file, 'rows.txt' as name, 'text/plain' as media_type,
       max(log_time_ns) as log_time_ns, count(*) as data_bytes from typed_messages group by 1""")
def attachments_mcap(spark, sf):
    return read_recordings(spark, _write_files(spark, sf), table="attachments").select(
        _file_name("file").alias("file"), "name", "media_type", "log_time_ns", "data_bytes")


@query("metadata_mcap", f"""
select distinct concat(recording_id, '_', log_time_ns // {_WEEK}) as file, 'week' as name from typed_messages""")
def metadata_mcap(spark, sf):
    return read_recordings(spark, _write_files(spark, sf), table="metadata").select(_file_name("file").alias("file"), "name")


@query("problems_mcap", f"""
select distinct concat(recording_id, '_', log_time_ns // {_WEEK}) as file, true as at_the_end
from typed_messages where (log_time_ns // {_WEEK}) % 2 = 1""")
def problems_mcap(spark, sf):
    """Every second file has lost its last bytes."""
    folder = _write_files(spark, sf, damaged=True)
    told = read_recordings(spark, folder, table="problems", rangeBytes=100_000)
    return told.select(_file_name("file").alias("file"), F.col("problem").contains("cut off").alias("at_the_end"))
