"""Registered queries and the SQL that must give the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The derived tables of ``tidewire.sources.views`` in DuckDB SQL.
_GUID = """concat(lower(lpad(to_hex(user_id), 24, '0')),
  case event_type when 'click' then '00000001' when 'error' then '00000002'
       when 'purchase' then '00000003' when 'signup' then '00000004' else '00000005' end)"""

VIEWS = {
    "messages": f"""
select concat('rec_', event_id % 3) as recording_id,
       concat('/', event_type, '/', user_id % 4) as topic,
       event_id // 3 as arrival_seq,
       epoch_us(ts) * 1000 as log_time_ns,
       case when event_id % 11 = 0 then 0
            when event_id % 7 = 0 then epoch_us(ts) * 1000 - 7200000000000
            else epoch_us(ts) * 1000 end as source_time_ns,
       {_GUID} as writer_guid,
       event_id % 13 <> 0 as valid,
       encode(props) as payload,
       cast(length(props) + 4 as int) as payload_bytes
from events""",
    "endpoint_events": f"""
select event_id as seq,
       {_GUID} as guid,
       concat(lower(lpad(to_hex(user_id), 24, '0')), '000001c1') as participant_guid,
       case event_id % 50 when 0 then 'DCPSTopic' when 1 then 'rt/internal' when 2 then ''
            else concat('/', event_type, '/', user_id % 4) end as topic,
       case when event_id % 10 = 3 then '' else concat('demo::', event_type, '::Msg', user_id % 4) end as type_name,
       event_type in ('click', 'view', 'purchase') as is_writer,
       event_id % 9 <> 0 as alive,
       event_id % 13 <> 0 as valid,
       user_id % 3 as reliability, user_id % 5 as durability,
       user_id % 2 as history_kind, user_id % 100 + 1 as history_depth,
       event_id % 4 <> 0 as described
from events""",
    "participant_events": """
select c_custkey as seq,
       concat(lower(lpad(to_hex(c_custkey), 24, '0')), '000001c1') as guid,
       case when c_custkey % 4 = 0 then '' else concat('host-', c_nationkey) end as hostname,
       case when c_custkey % 3 = 0 then '' else c_name end as process_name,
       cast(c_custkey as varchar) as pid,
       case when c_custkey % 5 = 0 then '' else c_mktsegment end as entity_name,
       c_acctbal >= 0 as alive
from customer""",
    "limit_strings": """
select p_partkey,
       concat(p_size, case p_partkey % 5 when 0 then 'G' when 1 then 'M' when 2 then 'k'
                                         when 3 then 'g' else '' end) as size_text,
       concat(p_size, case p_partkey % 3 when 0 then 'm' when 1 then 'h' else '' end) as duration_text
from part""",
}

# Steps shared by several queries; each may use the ones above it.
STEPS = {
    "stamps": """
select recording_id, topic, arrival_seq, log_time_ns,
       case when source_time_ns > 0 then source_time_ns else log_time_ns end as t
from messages where valid""",
    "kept": """
select * from (
  select *, t - max(t) over (partition by recording_id, topic order by arrival_seq
                             rows between unbounded preceding and 1 preceding) as dt from stamps)
where dt is null or dt > 0""",
    "discovered": """
select * from endpoint_events
where valid and alive and topic <> '' and not starts_with(topic, 'DCPS') and not starts_with(topic, 'rt/')""",
    "topic_types": """
select topic, max_by(type_name, seq) as type_name from discovered where is_writer group by topic""",
    "typed_messages": """
select m.*, coalesce(t.type_name, '') as type_name from messages m left join topic_types t using (topic)""",
    "channel_ids": """
select recording_id, topic, type_name,
       row_number() over (partition by recording_id order by seen) as channel_id,
       case when type_name = '' then 0
            else dense_rank() over (partition by recording_id order by type_seen nulls last) end as schema_id
from (select *, case when type_name <> ''
                then min(seen) over (partition by recording_id, type_name) end as type_seen
      from (select recording_id, topic, type_name, min(arrival_seq) as seen from typed_messages group by all))""",
    "rounds": """
select recording_id, log_time_ns // 60000000000 as poll, sum(payload_bytes)::bigint as bytes,
       row_number() over (partition by recording_id order by log_time_ns // 60000000000) as n
from messages group by recording_id, poll""",
}


def with_views(body: str, recursive: str = "") -> str:
    """``body`` with every view and step in front of it; ``recursive`` adds recursive ones."""
    parts = [f"{name} as ({text})" for name, text in {**VIEWS, **STEPS}.items()]
    keyword = "with recursive " if recursive else "with "
    return keyword + ",\n".join(parts + ([recursive] if recursive else [])) + "\n" + body


def query(name: str, sql: str | None = None, recursive: str = ""):
    """Register a query, with its SQL twin unless it has none."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, recursive)
        return fn

    return register
