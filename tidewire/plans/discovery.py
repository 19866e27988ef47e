"""Registered queries: topics, endpoints, participants and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import filters, scalars
from tidewire.operators import discovery, joins
from tidewire.plans.messages import _LABEL_SQL
from tidewire.plans.registry import query
from tidewire.sources import tables, views

_LIST_SQL = "select topic, coalesce(min_by(type_name, seq) filter (type_name <> ''), '') as type_name from {0} group by topic"


@query("topic_list", _LIST_SQL.format("discovered"))
def topic_list(spark, sf):
    return discovery.topic_list(views.endpoint_events(spark, sf))


@query("topic_info", f"""
select e.topic, t.type_name, case when is_writer then 'publisher' else 'subscriber' end as role, guid,
       case max_by(reliability, seq) when 0 then 'BEST_EFFORT' when 1 then 'RELIABLE' else 'UNKNOWN' end as reliability,
       case max_by(durability, seq) when 0 then 'VOLATILE' when 1 then 'TRANSIENT_LOCAL' when 2 then 'TRANSIENT'
                                    when 3 then 'PERSISTENT' else 'UNKNOWN' end as durability,
       case max_by(history_kind, seq) when 0 then concat('KEEP_LAST (', max_by(history_depth, seq), ')')
                                      when 1 then 'KEEP_ALL' else 'UNKNOWN' end as history
from discovered e join ({_LIST_SQL.format('discovered')}) t on e.topic = t.topic
where e.topic = '/click/1' group by e.topic, t.type_name, is_writer, guid""")
def topic_info(spark, sf):
    return discovery.topic_info(views.endpoint_events(spark, sf), "/click/1")


@query("endpoint_counts", """
select topic, count(distinct guid) filter (is_writer) as publishers,
       count(distinct guid) filter (not is_writer) as subscribers
from discovered group by topic""")
def endpoint_counts(spark, sf):
    return discovery.endpoint_counts(views.endpoint_events(spark, sf))


_TOPIC_SETS_SQL = """
select participant_guid as guid,
       list_sort(list_distinct(list(topic) filter (is_writer))) as pub_topics,
       list_sort(list_distinct(list(topic) filter (not is_writer))) as sub_topics
from endpoint_events where valid and alive and topic not like 'DCPS%' group by participant_guid"""


def _text(*names):
    return [F.array_join(name, ",").alias(name) for name in names]


@query("participant_topics", f"""
select guid, coalesce(array_to_string(pub_topics, ','), '') as pub_topics,
       coalesce(array_to_string(sub_topics, ','), '') as sub_topics from ({_TOPIC_SETS_SQL})""")
def participant_topics(spark, sf):
    return discovery.participant_topics(views.endpoint_events(spark, sf)).select(
        "guid", *_text("pub_topics", "sub_topics"))


# Every sixth participant is unknown here, so that the join has rows on one side alone.
_PARTICIPANTS_SQL = """
select guid, hostname, process_name, pid, entity_name from participant_events where alive and seq % 6 <> 0"""
_VIEW_SQL = f"""
select guid, p.hostname, p.process_name, p.pid, p.entity_name,
       array_to_string(e.pub_topics, ',') as pub_topics, array_to_string(e.sub_topics, ',') as sub_topics
from ({_PARTICIPANTS_SQL}) p full join ({_TOPIC_SETS_SQL}) e using (guid)"""


def _participant_view(spark, sf):
    return joins.participant_view(tables.participants(views.participant_events(spark, sf).where("seq % 6 <> 0")),
                                  discovery.participant_topics(views.endpoint_events(spark, sf)))


def _described_sql(where=""):
    return f"""
select guid, {_LABEL_SQL} as label, nullif(pub_topics, '') as pub_topics, nullif(sub_topics, '') as sub_topics
from (select guid, coalesce(hostname, '') as hostname, coalesce(process_name, '') as process_name,
             coalesce(pid, '') as pid, coalesce(entity_name, '') as entity_name, pub_topics, sub_topics
      from ({_VIEW_SQL})) {where}"""


def _described(df):
    def nonempty(name):
        text = F.array_join(name, ",")
        return F.when(text != "", text).alias(name)

    return df.select("guid", scalars.participant_label().alias("label"),
                     nonempty("pub_topics"), nonempty("sub_topics"))


@query("participants_endpoints", _described_sql())
def participants_endpoints(spark, sf):
    return _described(_participant_view(spark, sf))


_BY_TOPIC = "where pub_topics like '%click/1%' or sub_topics like '%click/1%'"


@query("participants_by_topic", _described_sql(_BY_TOPIC))
def participants_by_topic(spark, sf):
    return _described(filters.by_topic_substring(_participant_view(spark, sf), "click/1"))


_SELF = "0" * 23 + "7000001c1"


@query("exclude_self", _described_sql(f"where guid <> '{_SELF}'"))
def exclude_self(spark, sf):
    return _described(filters.exclude_guid(_participant_view(spark, sf), _SELF))


@query("participant_count", f"select count(*) as participants from ({_VIEW_SQL}) {_BY_TOPIC}")
def participant_count(spark, sf):
    return discovery.participant_count(filters.by_topic_substring(_participant_view(spark, sf), "click/1"))


LIVE_SQL = """
select guid, topic, type_name, is_writer from (
  select guid, max_by(topic, seq) as topic, max_by(type_name, seq) as type_name,
         max_by(is_writer, seq) as is_writer, max_by(alive, seq) as alive
  from endpoint_events
  where (valid or not alive) and topic <> '' and topic not like 'DCPS%' and topic not like 'rt/%' group by guid)
where alive"""


@query("live_endpoints", LIVE_SQL)
def live_endpoints(spark, sf):
    return discovery.live_endpoints(views.endpoint_events(spark, sf))


_CATALOG_SQL = """
select type_name, min(seq) as first_seq, min_by(topic, seq) as first_topic, min_by(described, seq) as complete
from discovered where is_writer group by type_name"""


@query("type_catalog", _CATALOG_SQL)
def type_catalog(spark, sf):
    return discovery.type_catalog(views.endpoint_events(spark, sf))


@query("topic_types", "select topic, type_name from topic_types")
def topic_types(spark, sf):
    return discovery.topic_types(views.endpoint_events(spark, sf))


@query("topic_schema", f"""
select t.topic, t.type_name, c.first_seq, c.first_topic, c.complete
from topic_types t join ({_CATALOG_SQL}) c using (type_name) where t.type_name <> ''""")
def topic_schema(spark, sf):
    endpoints = views.endpoint_events(spark, sf)
    return joins.topic_schema(discovery.topic_types(endpoints), discovery.type_catalog(endpoints))


# Literals of the example enum.
_LITERALS = {0: "IDLE", 1: "RUNNING", 2: "PAUSED", 3: "ERROR", 4: "STOPPED"}
_ENUM = "demo::Status"


def _literals(spark):
    return spark.createDataFrame([(_ENUM, code, text) for code, text in _LITERALS.items()],
                                 "type_name string, value int, literal string")


_LITERALS_SQL = "(values " + ", ".join(f"({code}, '{text}')" for code, text in _LITERALS.items()) + ") l(value, literal)"


def _coded(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("code"))


@query("enum_label", f"""
select p_partkey, p_size % 7 as code, coalesce(literal, (p_size % 7)::varchar) as label
from part left join {_LITERALS_SQL} on p_size % 7 = l.value""")
def enum_label(spark, sf):
    return joins.enum_label(_coded(spark, sf), _literals(spark), _ENUM, "code")


@query("enum_lookup", f"""
select p_partkey, p_size % 7 as code, literal from part left join {_LITERALS_SQL} on p_size % 7 = l.value""")
def enum_lookup(spark, sf):
    return joins.enum_lookup(_coded(spark, sf), _literals(spark), _ENUM, "code")
