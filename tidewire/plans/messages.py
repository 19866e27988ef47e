"""Registered queries: sources, filters, projections, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import filters, scalars
from tidewire.operators import discovery, joins, ordering
from tidewire.plans.registry import query
from tidewire.sources import tables, views

_ENVELOPE = ["recording_id", "topic", "arrival_seq", "log_time_ns"]
_DUCK_ENVELOPE = ", ".join(_ENVELOPE)


@query("scan_messages", f"""
select {_DUCK_ENVELOPE}, source_time_ns, writer_guid, payload_bytes, to_hex(payload) as payload_hex
from messages where valid and octet_length(payload) > 0""")
def scan_messages(spark, sf):
    return tables.usable(views.messages(spark, sf)).select(
        *_ENVELOPE, "source_time_ns", "writer_guid", "payload_bytes", F.hex("payload").alias("payload_hex"))


_ENDPOINT = ["seq", "guid", "participant_guid", "topic", "type_name", "is_writer", "alive", "valid"]


def _announcements(spark, sf):
    """The publication and the subscription feed, neither of which knows the other's role."""
    feed = views.endpoint_events(spark, sf)
    return (feed.where("is_writer").drop("is_writer"), feed.where("not is_writer").drop("is_writer"))


@query("scan_endpoint_events", f"select {', '.join(_ENDPOINT)} from endpoint_events")
def scan_endpoint_events(spark, sf):
    return tables.endpoints_union(*_announcements(spark, sf)).select(*_ENDPOINT)


@query("scan_participants", """
select guid, max_by(hostname, seq) as hostname, max_by(process_name, seq) as process_name,
       max_by(pid, seq) as pid, max_by(entity_name, seq) as entity_name
from participant_events where alive group by guid""")
def scan_participants(spark, sf):
    return tables.participants(views.participant_events(spark, sf))


def _filter_query(name, condition, *args, **kwargs):
    @query(name, f"select {_DUCK_ENVELOPE} from messages where {condition}")
    def run(spark, sf):
        return views.messages(spark, sf).where(filters.topic_filter(*args, **kwargs)).select(*_ENVELOPE)


_filter_query("topics_exact", "topic in ('/click/1', '/View/2', '/error/0')", ["/click/1", "/View/2", "/error/0"])
_filter_query("topics_regex", """regexp_full_match(topic, '/click/[0-2]') or regexp_full_match(topic, '/p.*e/.')
                 or regexp_full_match(topic, '/vie')""", ["/click/[0-2]", "/p.*e/.", "/vie"], regex=True)
_filter_query("topics_exclude", """(regexp_full_match(topic, '/click/.*') or regexp_full_match(topic, '/view/.*'))
                 and not regexp_full_match(topic, '.*/[13]')""",
              ["/click/.*", "/view/.*"], regex=True, exclude=".*/[13]")
_filter_query("topics_all", "true")

# the middle of the recorded month
_START, _END = 1_704_700_000_000_000_000, 1_705_900_000_000_000_000


@query("time_range", f"""
select {_DUCK_ENVELOPE} from messages where log_time_ns >= {_START} and log_time_ns < {_END}""")
def time_range(spark, sf):
    return filters.time_range(views.messages(spark, sf), _START, _END).select(*_ENVELOPE)


@query("payload_guard", f"select {_DUCK_ENVELOPE} from messages where least(octet_length(payload), arrival_seq % 8) > 4")
def payload_guard(spark, sf):
    """Payloads of up to seven bytes, of which those of four or fewer hold nothing behind their header."""
    short = F.expr("substring(payload, 1, cast(arrival_seq % 8 as int))")
    return views.messages(spark, sf).withColumn("payload", short).where(filters.has_payload()).select(*_ENVELOPE)


_ROLE = ["seq", "guid", "topic", "type_name"]


@query("drop_system_topics", f"""
select {', '.join(_ROLE)} from endpoint_events
where topic <> '' and topic not like 'DCPS%' and topic not like 'rt/%'""")
def drop_system_topics(spark, sf):
    return views.endpoint_events(spark, sf).where(filters.not_system()).select(*_ROLE)


@query("drop_builtin_topics", f"""
select {', '.join(_ROLE)} from endpoint_events where topic is not null and topic not like 'DCPS%'""")
def drop_builtin_topics(spark, sf):
    return views.endpoint_events(spark, sf).where(filters.not_builtin()).select(*_ROLE)


@query("valid_alive", f"select {', '.join(_ROLE)} from endpoint_events where valid and alive")
def valid_alive(spark, sf):
    return filters.alive_only(views.endpoint_events(spark, sf)).select(*_ROLE)


@query("writers_only", f"select {', '.join(_ROLE)} from endpoint_events where is_writer")
def writers_only(spark, sf):
    return filters.writers(views.endpoint_events(spark, sf)).select(*_ROLE)


@query("effective_time", """
select arrival_seq, case when source_time_ns > 0 then source_time_ns else log_time_ns end as t from messages""")
def effective_time(spark, sf):
    return views.messages(spark, sf).select(
        "arrival_seq", scalars.effective_time("source_time_ns", "log_time_ns").alias("t"))


@query("sec_nsec", """
select arrival_seq, concat(log_time_ns // 1000000000, '.', lpad((log_time_ns % 1000000000)::varchar, 9, '0')) as stamp,
       case when log_time_ns % 1000000000 = 0 then concat(-(log_time_ns // 1000000000), '.000000000')
            else concat(-(log_time_ns // 1000000000) - 1, '.',
                        lpad((1000000000 - log_time_ns % 1000000000)::varchar, 9, '0')) end as negated
from messages""")
def sec_nsec(spark, sf):
    return views.messages(spark, sf).select(
        "arrival_seq", scalars.sec_nsec("log_time_ns").alias("stamp"),
        scalars.sec_nsec(-F.col("log_time_ns")).alias("negated"))


@query("guid_text", """
select arrival_seq, concat_ws('.', substr(writer_guid, 1, 8), substr(writer_guid, 9, 8),
                              substr(writer_guid, 17, 8), substr(writer_guid, 25, 8)) as guid from messages""")
def guid_text(spark, sf):
    return views.messages(spark, sf).select(
        "arrival_seq", scalars.guid_text(F.unhex("writer_guid")).alias("guid"))


@query("participant_guid", "select seq, participant_guid as guid from endpoint_events")
def participant_guid(spark, sf):
    return views.endpoint_events(spark, sf).select("seq", scalars.participant_guid("guid").alias("guid"))


@query("qos_labels", """
select seq, case reliability when 0 then 'BEST_EFFORT' when 1 then 'RELIABLE' else 'UNKNOWN' end as reliability,
       case durability when 0 then 'VOLATILE' when 1 then 'TRANSIENT_LOCAL' when 2 then 'TRANSIENT'
                       when 3 then 'PERSISTENT' else 'UNKNOWN' end as durability,
       case history_kind when 0 then concat('KEEP_LAST (', history_depth, ')')
                         when 1 then 'KEEP_ALL' else 'UNKNOWN' end as history
from endpoint_events""")
def qos_labels(spark, sf):
    return scalars.qos_labels(views.endpoint_events(spark, sf)).select(
        "seq", "reliability", "durability", "history")


_LABEL_SQL = """case when process_name <> '' or hostname <> ''
       then concat(case when process_name <> '' then process_name else '(unknown)' end,
                   case when pid <> '' then concat(' [', pid, ']') else '' end,
                   case when hostname <> '' then concat(' @ ', hostname) else '' end)
       when entity_name <> '' then entity_name else '(unknown)' end"""


@query("participant_label", f"select guid, {_LABEL_SQL} as label from participant_events")
def participant_label(spark, sf):
    return views.participant_events(spark, sf).select("guid", scalars.participant_label().alias("label"))


_NUMBER = "regexp_extract({0}, '^[0-9.]+')::double"


@query("size_bytes", f"""
select p_partkey, size_text, ({_NUMBER.format('size_text')} * case regexp_extract(size_text, '[A-Za-z]')
       when 'G' then 1073741824 when 'g' then 1073741824 when 'k' then 1024 when 'K' then 1024
       else 1048576 end)::bigint as bytes
from limit_strings""")
def size_bytes(spark, sf):
    return views.limit_strings(spark, sf).select(
        "p_partkey", "size_text", scalars.size_bytes("size_text").alias("bytes"))


@query("duration_seconds", f"""
select p_partkey, duration_text, {_NUMBER.format('duration_text')} * case regexp_extract(duration_text, '[a-z]')
       when 'm' then 60.0 when 'h' then 3600.0 else 1.0 end as seconds
from limit_strings""")
def duration_seconds(spark, sf):
    return views.limit_strings(spark, sf).select(
        "p_partkey", "duration_text", scalars.duration_seconds("duration_text").alias("seconds"))


# payload headers made from the message number: 00 and the number's low byte, in front of the payload
_HEADED_SQL = """
select arrival_seq, arrival_seq % 16 as code,
       concat('000', substr('0123456789ABCDEF', (arrival_seq % 16 + 1)::int, 1), '0000', to_hex(payload)) as headed
from messages"""


def _headed(spark, sf):
    code = F.hex(F.col("arrival_seq") % 16)
    header = F.unhex(F.concat(F.lit("000"), code, F.lit("0000")))
    return views.messages(spark, sf).withColumn("headed", F.concat(header, "payload"))


@query("encapsulation", f"""
select arrival_seq, code in (0, 1, 6, 7, 8, 9, 10, 11) as is_valid,
       case when code in (0, 1) then 1 when code between 6 and 11 then 2 end as version,
       case when code in (0, 1) or code between 6 and 11 then code % 2 = 0 end as big_endian,
       case when code in (0, 1) or code between 6 and 11 then headed else concat('00010000', headed) end as framed_hex
from ({_HEADED_SQL})""")
def encapsulation(spark, sf):
    header = scalars.encapsulation("headed")
    return _headed(spark, sf).select(
        "arrival_seq", header["valid"].alias("is_valid"), header["version"].alias("version"),
        header["big_endian"].alias("big_endian"), F.hex(scalars.framed("headed")).alias("framed_hex"))


@query("type_path", """
select seq, array_to_string(string_split(type_name, '::')[:-2], '/') as modules,
       string_split(type_name, '::')[-1] as short_name
from endpoint_events""")
def type_path(spark, sf):
    path = scalars.type_path("type_name")
    return views.endpoint_events(spark, sf).select(
        "seq", F.array_join(path["modules"], "/").alias("modules"), path["short_name"].alias("short_name"))


@query("array_len", """
select p_partkey, ((p_size % 5 + 1) * (p_partkey % 7 + 1) * 3)::bigint as n from part""")
def array_len(spark, sf):
    dims = F.array((F.col("p_size") % 5 + 1).cast("int"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(3))
    return views.table(spark, sf, "part").select("p_partkey", scalars.array_len(dims).alias("n"))


@query("topics_sorted", "select distinct topic from discovered order by topic")
def topics_sorted(spark, sf):
    return ordering.topics_sorted(discovery.discovered(views.endpoint_events(spark, sf)))


@query("endpoints_by_guid", "select distinct guid, is_writer from discovered order by guid")
def endpoints_by_guid(spark, sf):
    found = discovery.discovered(views.endpoint_events(spark, sf))
    return ordering.endpoints_by_guid(found.select("guid", "is_writer").distinct())


@query("first_n", """
select arrival_seq, writer_guid, log_time_ns from messages where topic = '/click/2' order by arrival_seq limit 25""")
def first_n(spark, sf):
    topic = views.messages(spark, sf).where(filters.topic_filter(["/click/2"]))
    return ordering.first_n(topic.select("arrival_seq", "writer_guid", "log_time_ns"), 25)


@query("endpoints_union", """
select guid, topic, is_writer, count(*) as announcements from endpoint_events group by all""")
def endpoints_union(spark, sf):
    both = tables.endpoints_union(*_announcements(spark, sf))
    return both.groupBy("guid", "topic", "is_writer").agg(F.count("*").alias("announcements"))


@query("topics_distinct", "select distinct topic from endpoint_events where valid and alive")
def topics_distinct(spark, sf):
    return ordering.topics_distinct(filters.alive_only(views.endpoint_events(spark, sf)))


@query("include_minus_exclude", """
select distinct topic from messages where regexp_full_match(topic, '/(click|view|error)/.*')
except select topic from messages where regexp_full_match(topic, '.*/2')""")
def include_minus_exclude(spark, sf):
    return ordering.include_minus_exclude(
        views.messages(spark, sf), ["/(click|view|error)/.*"], ".*/2", regex=True)


def _requests(spark, sf):
    """Topics somebody asked for: one per nation, most of which nobody publishes."""
    kind = F.element_at(F.split(F.lit("click,view,error,pause,resume"), ","), F.col("n_regionkey") + 1)
    return views.table(spark, sf, "nation").select(
        F.concat(F.lit("/"), kind, F.lit("/"), F.col("n_nationkey") % 6).alias("topic"))


_REQUESTS_SQL = """select concat('/', string_split('click,view,error,pause,resume', ',')[n_regionkey + 1],
                                 '/', n_nationkey % 6) as topic from nation"""


@query("requested_topics", f"""
select {_DUCK_ENVELOPE} from messages where topic in ({_REQUESTS_SQL})""")
def requested_topics(spark, sf):
    return joins.requested(views.messages(spark, sf), _requests(spark, sf)).select(*_ENVELOPE)


@query("missing_topics", f"""
select distinct topic from ({_REQUESTS_SQL}) where topic not in (select topic from discovered)""")
def missing_topics(spark, sf):
    found = discovery.discovered(views.endpoint_events(spark, sf))
    return joins.missing(_requests(spark, sf), found).distinct()
