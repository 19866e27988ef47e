"""Joins of messages, channels, schemas, topics and participants.

No join carries a broadcast hint. Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``; larger ones are shuffled and adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, NO_CHANNEL, NO_SCHEMA = "ok", "missing_channel", "missing_schema"


def resolve_status(msgs: DataFrame, channels: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages with channel and schema columns and a ``status``; schema id 0 means no schema."""
    ch = channels.select("recording_id", "channel_id", "topic", "schema_id", F.lit(True).alias("_ch"))
    sc = schemas.select("recording_id", "schema_id", F.col("name").alias("schema_name"), F.lit(True).alias("_sc"))
    status = (F.when(F.col("_ch").isNull(), NO_CHANNEL)
              .when((F.col("schema_id") != 0) & F.col("_sc").isNull(), NO_SCHEMA).otherwise(OK))
    return (msgs.join(ch, ["recording_id", "channel_id"], "left")
            .join(sc, ["recording_id", "schema_id"], "left")
            .withColumn("status", status).drop("_ch", "_sc"))


def resolve(msgs: DataFrame, channels: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved messages, and those with a dangling channel or schema id."""
    tagged = resolve_status(msgs, channels, schemas)
    return tagged.where(F.col("status") == OK).drop("status"), tagged.where(F.col("status") != OK)


def participant_view(participants: DataFrame, topics: DataFrame) -> DataFrame:
    """Participants with their topic sets; either side may lack the other."""
    return participants.join(topics, "guid", "full_outer")


def requested(msgs: DataFrame, wanted: DataFrame) -> DataFrame:
    return msgs.join(wanted.select("topic"), "topic", "left_semi")


def missing(wanted: DataFrame, endpoints: DataFrame) -> DataFrame:
    return wanted.join(endpoints.select("topic"), "topic", "left_anti")


def topic_schema(topic_types: DataFrame, catalog: DataFrame) -> DataFrame:
    """Topic with the schema of its type; topics without a type are left out."""
    return topic_types.where("type_name <> ''").join(catalog, "type_name")


def enum_lookup(df: DataFrame, literals: DataFrame, type_name: str, value: str, label: str = "literal") -> DataFrame:
    """Adds the literal of an enum value, null when the type has none for it."""
    names = literals.where(F.col("type_name") == type_name).select(
        F.col("value").alias(value), F.col("literal").alias(label))
    return df.join(names, value, "left")


def enum_label(df: DataFrame, literals: DataFrame, type_name: str, value: str, label: str = "label") -> DataFrame:
    """Adds the literal, or the number as text when it is unknown."""
    looked_up = enum_lookup(df, literals, type_name, value, label)
    return looked_up.withColumn(label, F.coalesce(label, F.col(value).cast("string")))
