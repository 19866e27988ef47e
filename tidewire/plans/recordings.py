"""Registered queries: recordings, splits, chunks and their statistics."""

from __future__ import annotations

from functools import reduce

import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import filters, scalars
from tidewire.operators import discovery, joins, ordering
from tidewire.operators import recordings as rec
from tidewire.operators.types import TypeTables, read_definitions
from tidewire.plans.registry import query
from tidewire.session import scratch_path, stored
from tidewire.sources import recordings as store
from tidewire.sources import views
from tidewire.sources.files import located

# The test events are minutes apart: poll rounds of a minute, splits of 2,000 bytes or a day and a half.
_LIMITS = rec.Limits(max_bytes=2000, max_seconds=36 * 3600, poll_ns=60_000_000_000)
_SPAN = _LIMITS.max_ns
_CHUNK = 1000
# small enough that a recording spans many blocks
_ROUND_BLOCK, _CHUNK_BLOCK = 5000, 2000


def typed_messages(spark, sf):
    """Messages with the type their topic was last announced with."""
    types = discovery.topic_types(views.endpoint_events(spark, sf))
    return (views.messages(spark, sf).join(types, "topic", "left")
            .withColumn("type_name", F.coalesce("type_name", F.lit(""))))


# One row per poll round: the split it is in, the split's start, and the bytes in it before the round.
_SPLITS_RECURSIVE = f"""
walk as (
  select recording_id, n, poll, bytes, 0 as split, poll * 60000000000 as split_start_ns, 0::bigint as held
  from rounds where n = 1
  union all
  select r.recording_id, r.n, r.poll, r.bytes,
         w.split + cut.yes, case cut.yes when 1 then r.poll * 60000000000 else w.split_start_ns end,
         case cut.yes when 1 then 0 else w.held + w.bytes end
  from walk w join rounds r on r.recording_id = w.recording_id and r.n = w.n + 1,
  lateral (select case when w.held + w.bytes >= 2000
                         or r.poll * 60000000000 - w.split_start_ns >= {_SPAN} then 1 else 0 end as yes) cut),
split_messages as (
  select m.*, w.split, w.split_start_ns from typed_messages m
  join walk w on w.recording_id = m.recording_id and w.poll = m.log_time_ns // 60000000000)"""

_SPLIT_COLUMNS = ["recording_id", "topic", "arrival_seq", "log_time_ns", "split", "split_start_ns"]
_SPLIT_SQL = f"select {', '.join(_SPLIT_COLUMNS)} from split_messages"


def _split(msgs, newest=0):
    return rec.assign_splits(msgs, _LIMITS, _ROUND_BLOCK, newest)


@query("assign_splits", _SPLIT_SQL, _SPLITS_RECURSIVE)
def assign_splits(spark, sf):
    return _split(views.messages(spark, sf)).select(*_SPLIT_COLUMNS)


@query("retain_splits", f"""
{_SPLIT_SQL} qualify dense_rank() over (partition by recording_id order by split desc) <= 3""", _SPLITS_RECURSIVE)
def retain_splits(spark, sf):
    return _split(views.messages(spark, sf), newest=3).select(*_SPLIT_COLUMNS)


@query("stop_at_limit", """
select recording_id, topic, arrival_seq, log_time_ns from split_messages where split = 0""", _SPLITS_RECURSIVE)
def stop_at_limit(spark, sf):
    return rec.stop_at_limit(views.messages(spark, sf), _LIMITS, _ROUND_BLOCK).select(
        "recording_id", "topic", "arrival_seq", "log_time_ns")


@query("recording_name", """
select distinct recording_id, split, concat(recording_id, '_',
       strftime(make_timestamp(split_start_ns // 1000), '%Y-%m-%d-%H-%M-%S'), '_', split, '.mcap') as name
from split_messages""", _SPLITS_RECURSIVE)
def recording_name(spark, sf):
    splits = _split(views.messages(spark, sf)).select("recording_id", "split", "split_start_ns").distinct()
    start = F.timestamp_micros(scalars.floor_div("split_start_ns", 1000))
    return splits.select("recording_id", "split", scalars.recording_name("recording_id", start, F.col("split")).alias("name"))


@query("assign_ids", "select recording_id, topic, type_name, channel_id, schema_id from channel_ids")
def assign_ids(spark, sf):
    return discovery.assign_ids(typed_messages(spark, sf))


@query("replicate_dims", """
select distinct recording_id, split, topic, c.type_name, channel_id, schema_id
from split_messages join channel_ids c using (recording_id, topic)""", _SPLITS_RECURSIVE)
def replicate_dims(spark, sf):
    msgs = typed_messages(spark, sf)
    return discovery.replicate_dims(_split(msgs), discovery.assign_ids(msgs))


_STORED = ["recording_id", "split", "channel_id", "topic", "arrival_seq", "log_time_ns", "payload_bytes"]


def _written(spark, sf, **options):
    path = scratch_path(spark, "recording")
    store.write_recording(typed_messages(spark, sf).where("valid"), path, _LIMITS, **options)
    return path


def _valid(sql):
    """The same steps over valid messages only."""
    return sql.replace("from rounds", "from valid_rounds").replace("join rounds r", "join valid_rounds r")


_VALID_STEPS = """
valid_rounds as (
  select recording_id, log_time_ns // 60000000000 as poll, sum(payload_bytes)::bigint as bytes,
         row_number() over (partition by recording_id order by log_time_ns // 60000000000) as n
  from messages where valid group by recording_id, poll),
valid_ids as (
  select recording_id, topic, type_name,
         row_number() over (partition by recording_id order by seen) as channel_id,
         case when type_name = '' then 0
              else dense_rank() over (partition by recording_id order by type_seen nulls last) end as schema_id
  from (select *, case when type_name <> ''
                  then min(seen) over (partition by recording_id, type_name) end as type_seen
        from (select recording_id, topic, type_name, min(arrival_seq) as seen
              from typed_messages where valid group by all))),
""" + _valid(_SPLITS_RECURSIVE)


@query("write_recording", """
select recording_id, split, channel_id, topic, arrival_seq, log_time_ns, payload_bytes
from split_messages join valid_ids using (recording_id, topic) where valid""", _VALID_STEPS)
def write_recording(spark, sf):
    return store.read_messages(spark, _written(spark, sf)).select(*_STORED)


@query("splits_union", """
select recording_id, count(distinct split) as splits, count(*) as messages, sum(payload_bytes)::bigint as bytes
from split_messages where valid group by recording_id""", _VALID_STEPS)
def splits_union(spark, sf):
    """Two recordings in one place and the third in another, read together."""
    paths = []
    for here in (F.col("recording_id") == "rec_0", F.col("recording_id") != "rec_0"):
        paths.append(scratch_path(spark, "recording"))
        store.write_recording(typed_messages(spark, sf).where("valid").where(here), paths[-1], _LIMITS, compression="lz4")
    per_split = (store.read_messages(spark, *paths).groupBy("recording_id", "split")
                 .agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("b")))
    return per_split.groupBy("recording_id").agg(
        F.count("*").alias("splits"), F.sum("n").alias("messages"), F.sum("b").alias("bytes"))


@query("written_dims", """
select distinct recording_id, split, channel_id, topic, 'cdr' as message_encoding, schema_id,
       case when schema_id <> 0 then v.type_name end as schema_name
from split_messages join valid_ids v using (recording_id, topic) where valid""", _VALID_STEPS)
def written_dims(spark, sf):
    path = _written(spark, sf, compression="none")
    schemas = store.read_schemas(spark, path).select("recording_id", "split", "schema_id", F.col("name").alias("schema_name"))
    return store.read_channels(spark, path).drop("metadata").join(schemas, ["recording_id", "split", "schema_id"], "left")


# Chunks restart in every split; each message takes its payload and 31 bytes.
_CHUNKS_RECURSIVE = _SPLITS_RECURSIVE + f""",
sized as (
  select *, payload_bytes + 31 as record_bytes,
         row_number() over (partition by recording_id, split order by arrival_seq) as m from split_messages),
fill as (
  select recording_id, split, m, record_bytes, 0 as chunk, 0::bigint as byte_offset from sized where m = 1
  union all
  select s.recording_id, s.split, s.m, s.record_bytes,
         f.chunk + case when f.byte_offset + f.record_bytes + s.record_bytes >= {_CHUNK} then 1 else 0 end,
         case when f.byte_offset + f.record_bytes + s.record_bytes >= {_CHUNK} then 0
              else f.byte_offset + f.record_bytes end
  from fill f join sized s on s.recording_id = f.recording_id and s.split = f.split and s.m = f.m + 1),
chunked as (
  select s.*, f.chunk, f.byte_offset from sized s join fill f using (recording_id, split, m))"""


def _chunked(spark, sf):
    """Chunks of the split messages' headers, which are stored first, as cutting reads them twice."""
    msgs = _split(typed_messages(spark, sf)).select(
        "recording_id", "split", "topic", "type_name", "arrival_seq", "log_time_ns", "payload_bytes")
    return rec.assign_chunks(stored(msgs, "split"), _CHUNK, _CHUNK_BLOCK)


_PLACE = ["recording_id", "split", "chunk"]


@query("assign_chunks", "select recording_id, split, chunk, arrival_seq, record_bytes from chunked", _CHUNKS_RECURSIVE)
def assign_chunks(spark, sf):
    return _chunked(spark, sf).select(*_PLACE, "arrival_seq", "record_bytes")


@query("chunk_offsets", """
select recording_id, split, chunk, arrival_seq, byte_offset as "offset" from chunked""", _CHUNKS_RECURSIVE)
def chunk_offsets(spark, sf):
    return rec.chunk_offsets(_chunked(spark, sf)).select(*_PLACE, "arrival_seq", "offset")


@query("chunk_index", """
select recording_id, split, chunk, min(log_time_ns) as start_time_ns, max(log_time_ns) as end_time_ns,
       sum(record_bytes)::bigint as uncompressed_bytes,
       array_to_string(list_sort(list_distinct(list(topic))), ',') as topics
from chunked group by recording_id, split, chunk""", _CHUNKS_RECURSIVE)
def chunk_index(spark, sf):
    return rec.chunk_index(_chunked(spark, sf))


@query("message_index", """
select recording_id, split, chunk, topic, log_time_ns, byte_offset as "offset",
       row_number() over (partition by recording_id, split, chunk, topic order by byte_offset)::int - 1 as pos
from chunked""", _CHUNKS_RECURSIVE)
def message_index(spark, sf):
    index = rec.message_index(_chunked(spark, sf))
    return (index.select(*_PLACE, "topic", F.posexplode("entries").alias("pos", "e"))
            .select(*_PLACE, "topic", "pos", "e.log_time_ns", "e.offset"))


@query("file_statistics", """
select recording_id, split, count(*) as messages, count(distinct nullif(type_name, '')) as schemas,
       count(distinct topic) as channels, count(distinct chunk) as chunks,
       min(log_time_ns) as start_time_ns, max(log_time_ns) as end_time_ns
from chunked group by recording_id, split""", _CHUNKS_RECURSIVE)
def file_statistics(spark, sf):
    return rec.file_statistics(_chunked(spark, sf))


@query("channel_counts", """
select recording_id, split, topic, count(*) as messages from split_messages group by all""", _SPLITS_RECURSIVE)
def channel_counts(spark, sf):
    return rec.channel_counts(_split(views.messages(spark, sf)))


@query("recording_stats", """
select (select count(distinct guid) from writers) as writers_discovered, (select count(distinct topic) from writers) as topics_discovered,
       count(*) as messages_received, count(*) as messages_recorded, sum(payload_bytes)::bigint as bytes_recorded,
       (max(log_time_ns) - min(log_time_ns)) / 1e9 as duration_seconds
from messages where valid and topic in (select topic from writers)""", """
writers as (
  select guid, topic from endpoint_events
  where valid and alive and is_writer and topic <> '' and not starts_with(topic, 'DCPS') and not starts_with(topic, 'rt/')
    and regexp_full_match(topic, '/(click|view|signup)/[0-2]'))""")
def recording_stats(spark, sf):
    return rec.recording_stats(views.messages(spark, sf), views.endpoint_events(spark, sf),
                               filters.topic_filter(["/(click|view|signup)/[0-2]"], regex=True))


_ORDERED = ["recording_id", "split", "arrival_seq", "log_time_ns"]


def _positions(spark, sf, order):
    return ordering.read_positions(_split(views.messages(spark, sf)).select(*_ORDERED), order)


def _position_sql(order):
    return f"select {', '.join(_ORDERED)}, row_number() over (order by {order}, recording_id) - 1 as position from split_messages"


@query("read_order", _position_sql("log_time_ns desc, split desc, arrival_seq desc"), _SPLITS_RECURSIVE)
def read_order(spark, sf):
    return _positions(spark, sf, "reverse_time")


@query("read_order_time", _position_sql("log_time_ns, split, arrival_seq"), _SPLITS_RECURSIVE)
def read_order_time(spark, sf):
    return _positions(spark, sf, "time")


@query("read_order_file", _position_sql("split, arrival_seq"), _SPLITS_RECURSIVE)
def read_order_file(spark, sf):
    return _positions(spark, sf, "file")


# Channels whose id is a multiple of 7 are lost, and schemas whose id is a multiple of 3.
@query("messages_with_schema", """
select m.recording_id, m.arrival_seq, c.channel_id,
       case when c.channel_id % 7 <> 0 then m.topic end as topic,
       case when c.channel_id % 7 <> 0 then c.schema_id end as schema_id,
       case when c.channel_id % 7 <> 0 and c.schema_id % 3 <> 0 then c.type_name end as schema_name,
       case when c.channel_id % 7 = 0 then 'missing_channel'
            when c.schema_id <> 0 and c.schema_id % 3 = 0 then 'missing_schema' else 'ok' end as status
from messages m join channel_ids c using (recording_id, topic)""")
def messages_with_schema(spark, sf):
    msgs = typed_messages(spark, sf)
    ids = discovery.assign_ids(msgs)
    stored = (msgs.join(ids.select("recording_id", "topic", "channel_id"), ["recording_id", "topic"])
              .select("recording_id", "arrival_seq", "channel_id"))
    channels = ids.where("channel_id % 7 <> 0")
    schemas = (ids.where("schema_id % 3 <> 0")
               .select("recording_id", "schema_id", F.col("type_name").alias("name")).distinct())
    return joins.resolve_status(stored, channels, schemas).select(
        "recording_id", "arrival_seq", "channel_id", "topic", "schema_id", "schema_name", "status")


# Descriptions of some of the types in use, two of them nested; the others are unknown.
_TYPE_MEMBERS = [
    ("demo::Pose", 0, "xyz", "array", "float64", [3], None), ("demo::Pose", 1, "mode", "enum", None, None, "demo::Mode"),
    ("demo::click::Msg0", 0, "id", "int32", None, None, None), ("demo::click::Msg0", 1, "poses", "sequence", "struct", None, "demo::Pose"),
    ("demo::view::Msg1", 0, "frame", "string", None, None, None), ("demo::view::Msg1", 1, "pose", "struct", None, None, "demo::Pose"),
    ("demo::purchase::Msg2", 0, "_d", "int32", None, None, None), ("demo::purchase::Msg2", 1, "total", "uint64", None, None, None),
]
_TYPE_LITERALS = [("demo::Mode", 0, "IDLE"), ("demo::Mode", 7, "MOVING")]
_TYPE_LABELS = [("demo::purchase::Msg2", 1, "total"), ("demo::purchase::Msg2", 4, "total")]


def example_types(spark):
    return TypeTables(
        spark.createDataFrame(_TYPE_MEMBERS, "type_name string, pos int, member string, kind string, elem_kind string, dims array<int>, ref_type string"),
        spark.createDataFrame(_TYPE_LITERALS, "type_name string, value int, literal string"),
        spark.createDataFrame(_TYPE_LABELS, "type_name string, label int, member string"))


def _sql_rows(rows):
    return ", ".join("(" + ", ".join("null" if v is None else str(v) if not isinstance(v, str) else f"'{v}'" for v in row) + ")" for row in rows)


@query("schema_data", f"""
select recording_id, split, v.type_name as schema_name, m.type_name as needs, m.member, m.kind, m.elem_kind, m.pos, topics
from (select recording_id, split, type_name, string_agg(distinct topic, ',' order by topic) as topics
      from split_messages where valid and type_name <> '' group by all) v
join (values ('demo::click::Msg0', 'demo::Pose'), ('demo::view::Msg1', 'demo::Pose'), ('demo::click::Msg0', 'demo::click::Msg0'),
             ('demo::view::Msg1', 'demo::view::Msg1'), ('demo::purchase::Msg2', 'demo::purchase::Msg2')) n(type_name, needs) using (type_name)
join (values {_sql_rows([row[:5] for row in _TYPE_MEMBERS])}) m(type_name, pos, member, kind, elem_kind) on m.type_name = n.needs""",
       _VALID_STEPS)
def schema_data(spark, sf):
    """Members of every type a split's schemas describe, read back from the text stored with them; topics from the channels' metadata."""
    path, kinds = scratch_path(spark, "recording"), example_types(spark)
    msgs = typed_messages(spark, sf).where("valid")
    metadata = msgs.select("topic").distinct().select("topic", F.create_map(F.lit("name"), "topic").alias("metadata"))
    store.write_recording(msgs, path, _LIMITS, types=kinds, metadata=metadata)
    schemas = store.read_schemas(spark, path)
    members = read_definitions(schemas, keep=["name"]).members.withColumnRenamed("name", "schema_name")
    topics = (store.read_channels(spark, path).where("schema_id <> 0").groupBy("recording_id", "split", "schema_id")
              .agg(F.array_join(F.sort_array(F.collect_set(F.col("metadata")["name"])), ",").alias("topics")))
    return (schemas.join(topics, ["recording_id", "split", "schema_id"]).withColumnRenamed("name", "schema_name").join(members, "schema_name")
            .select("recording_id", "split", "schema_name", F.col("type_name").alias("needs"), "member", "kind", "elem_kind", "pos", "topics"))


def _codec_of(spark, path: str) -> str:
    """What the footer of a written file says."""
    first = store.read_messages(spark, path).inputFiles()[0]
    system, inner = located(first)
    with system.open_input_file(inner) as file:
        return pq.ParquetFile(file).metadata.row_group(0).column(0).compression.lower()


@query("compression", """
select name as compression, codec, recording_id, count(*) as messages, sum(payload_bytes)::bigint as bytes
from messages, (values ('zstd', 'zstd'), ('lz4', 'lz4'), ('none', 'uncompressed'), ('gzip9', 'uncompressed')) c(name, codec)
where valid group by all""")
def compression(spark, sf):
    """The same recording in every compression; one nobody knows means none."""
    read = []
    for name in ("zstd", "lz4", "none", "gzip9"):
        path = scratch_path(spark, name)
        store.write_recording(typed_messages(spark, sf).where("valid"), path, compression=name)
        read.append(store.read_messages(spark, path).groupBy("recording_id").agg(
            F.lit(name).alias("compression"), F.lit(_codec_of(spark, path)).alias("codec"),
            F.count("*").alias("messages"), F.sum("payload_bytes").alias("bytes")))
    return reduce(DataFrame.unionByName, read)
