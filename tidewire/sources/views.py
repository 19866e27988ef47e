"""Message-stream tables derived from the star-schema test tables.

Each function takes a DataFrame (batch or streaming) of one raw table and returns one canonical table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GUID = """concat(lower(lpad(hex({user}), 24, '0')),
  case event_type when 'click' then '00000001' when 'error' then '00000002'
       when 'purchase' then '00000003' when 'signup' then '00000004' else '00000005' end)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_from(events: DataFrame) -> DataFrame:
    received = "unix_micros(cast(ts as timestamp)) * 1000"
    return events.selectExpr(
        "concat('rec_', event_id % 3) as recording_id",
        "concat('/', event_type, '/', user_id % 4) as topic",
        "event_id div 3 as arrival_seq",
        f"{received} as log_time_ns",
        f"""case when event_id % 11 = 0 then 0
                 when event_id % 7 = 0 then {received} - 7200000000000
                 else {received} end as source_time_ns""",
        f"{_GUID.format(user='user_id')} as writer_guid",
        "event_id % 13 <> 0 as valid",
        "cast(props as binary) as payload",
        "cast(length(props) + 4 as int) as payload_bytes",
    )


def endpoint_events_from(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as seq",
        f"{_GUID.format(user='user_id')} as guid",
        "concat(lower(lpad(hex(user_id), 24, '0')), '000001c1') as participant_guid",
        """case event_id % 50 when 0 then 'DCPSTopic' when 1 then 'rt/internal' when 2 then ''
                else concat('/', event_type, '/', user_id % 4) end as topic""",
        """case when event_id % 10 = 3 then ''
                else concat('demo::', event_type, '::Msg', user_id % 4) end as type_name""",
        "event_type in ('click', 'view', 'purchase') as is_writer",
        "event_id % 9 <> 0 as alive",
        "event_id % 13 <> 0 as valid",
        "user_id % 3 as reliability",
        "user_id % 5 as durability",
        "user_id % 2 as history_kind",
        "user_id % 100 + 1 as history_depth",
        "event_id % 4 <> 0 as described",
    )


def participant_events_from(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey as seq",
        "concat(lower(lpad(hex(c_custkey), 24, '0')), '000001c1') as guid",
        "case when c_custkey % 4 = 0 then '' else concat('host-', c_nationkey) end as hostname",
        "case when c_custkey % 3 = 0 then '' else c_name end as process_name",
        "cast(c_custkey as string) as pid",
        "case when c_custkey % 5 = 0 then '' else c_mktsegment end as entity_name",
        "c_acctbal >= 0 as alive",
    )


def limit_strings_from(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey",
        """concat(p_size, case p_partkey % 5 when 0 then 'G' when 1 then 'M' when 2 then 'k'
                               when 3 then 'g' else '' end) as size_text""",
        "concat(p_size, case p_partkey % 3 when 0 then 'm' when 1 then 'h' else '' end) as duration_text",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "events"))


def endpoint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoint_events_from(table(spark, sf_dir, "events"))


def participant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participant_events_from(table(spark, sf_dir, "customer"))


def limit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_strings_from(table(spark, sf_dir, "part"))


def part_type_members(part: DataFrame) -> DataFrame:
    """A type graph over the part keys: type k nests types k/3 and k/5, so it deepens with the table."""
    own = F.concat(F.lit("demo::part::T"), F.col("p_partkey"))
    scalar = part.select(own.alias("type_name"), F.lit(0).alias("pos"), F.lit("size").alias("member"),
                         F.lit("int32").alias("kind"), F.lit(None).cast("string").alias("ref_type"))
    nested = [
        part.where(F.col("p_partkey") > 0).select(
            own.alias("type_name"), F.lit(pos).alias("pos"), F.lit(f"via_{step}").alias("member"),
            F.lit("struct").alias("kind"),
            F.concat(F.lit("demo::part::T"), F.expr(f"p_partkey div {step}")).alias("ref_type"))
        for pos, step in ((1, 3), (2, 5))
    ]
    return scalar.unionByName(nested[0]).unionByName(nested[1])
