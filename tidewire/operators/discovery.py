"""Topics, endpoints, participants and types out of discovery announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.filters import alive_only, not_builtin, not_system, writers
from tidewire.functions.scalars import participant_guid, qos_labels
from tidewire.operators.blocks import join_keys
from tidewire.operators.versions import first_version, last_version

_QOS = ["reliability", "durability", "history_kind", "history_depth"]


def discovered(endpoints: DataFrame) -> DataFrame:
    """Live, valid announcements of user topics."""
    return alive_only(endpoints).where(not_system())


def live_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints whose last event leaves them alive. A removal counts even without valid data."""
    facts = ["topic", "type_name", "is_writer", "alive"]
    counted = endpoints.where(not_system() & (F.col("valid") | ~F.col("alive")))
    return last_version(counted, ["guid"], facts).where("alive").drop("alive", "seq")


def topic_list(endpoints: DataFrame) -> DataFrame:
    """Topics in name order with the first non-empty type announced; empty when there is none."""
    pairs = discovered(endpoints).groupBy("topic", "type_name").agg(F.min("seq").alias("seq"))
    named = F.when(F.col("type_name") != "", F.col("seq"))
    return (pairs.groupBy("topic").agg(F.coalesce(F.min_by("type_name", named), F.lit("")).alias("type_name"))
            .orderBy("topic"))


def _latest_per_endpoint(endpoints: DataFrame) -> DataFrame:
    """One row per (topic, role, GUID) with its newest QoS."""
    return last_version(discovered(endpoints), ["topic", "is_writer", "guid"], _QOS).drop("seq")


def topic_info(endpoints: DataFrame, topic: str) -> DataFrame:
    """Endpoints of one topic with role, QoS and the topic's type, in role and GUID order."""
    own = endpoints.where(F.col("topic") == topic)
    rows = qos_labels(_latest_per_endpoint(own))
    type_name = topic_list(own)
    role = F.when(F.col("is_writer"), "publisher").otherwise("subscriber")
    return (rows.join(type_name, "topic").withColumn("role", role).drop("is_writer")
            .orderBy("role", "guid"))


def endpoint_counts(endpoints: DataFrame) -> DataFrame:
    each = discovered(endpoints).select("topic", "is_writer", "guid").distinct()
    return each.groupBy("topic").agg(
        F.count_if("is_writer").alias("publishers"),
        F.count_if(~F.col("is_writer")).alias("subscribers"))


def participant_topics(endpoints: DataFrame) -> DataFrame:
    """Per participant: the sorted sets of topics it publishes and subscribes to.

    Distinct first, so a busy participant reaches the last step as one row per topic and role.
    """
    pairs = (alive_only(endpoints).where(not_builtin())
             .select(participant_guid("participant_guid").alias("guid"), "is_writer", "topic").distinct())

    def topics(role: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(role, F.col("topic"))))

    return pairs.groupBy("guid").agg(topics(F.col("is_writer")).alias("pub_topics"),
                                     topics(~F.col("is_writer")).alias("sub_topics"))


def participant_count(participants: DataFrame) -> DataFrame:
    return participants.agg(F.count("*").alias("participants"))


def _producers(endpoints: DataFrame) -> DataFrame:
    return writers(discovered(endpoints))


def type_catalog(endpoints: DataFrame, complete: str = "described") -> DataFrame:
    """First announcement of each type: who brought it, and whether it came with a description."""
    first = first_version(_producers(endpoints), ["type_name"], ["topic", complete])
    return first.select("type_name", F.col("seq").alias("first_seq"), F.col("topic").alias("first_topic"),
                        F.col(complete).alias("complete"))


def topic_types(endpoints: DataFrame) -> DataFrame:
    """Topic to type; the last registration wins."""
    return last_version(_producers(endpoints), ["topic"], ["type_name"]).drop("seq")


def assign_ids(df: DataFrame) -> DataFrame:
    """Channel id per topic and schema id per type, 1-based by first appearance in the recording.

    Topics without a type get schema id 0. The numbering runs over one row per topic.
    """
    topics = (first_version(df, ["recording_id", "topic"], ["type_name"], "arrival_seq")
              .withColumnRenamed("arrival_seq", "_seen"))
    by_topic = W.partitionBy("recording_id").orderBy("_seen")
    first_of_type = F.min("_seen").over(W.partitionBy("recording_id", "type_name"))
    typed = topics.withColumns({
        "channel_id": F.row_number().over(by_topic),
        "_type_seen": F.when(F.col("type_name") != "", first_of_type),
    })
    by_type = W.partitionBy("recording_id").orderBy(F.col("_type_seen").asc_nulls_last())
    schema_id = F.when(F.col("_type_seen").isNull(), 0).otherwise(F.dense_rank().over(by_type))
    return typed.select("recording_id", "topic", "type_name", "channel_id", schema_id.alias("schema_id"))


_IDS = ["recording_id", "topic", "type_name", "channel_id", "schema_id"]


def more_ids(df: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` ids (as of :func:`assign_ids`) and those of topics and types that first appear in ``df``, numbered on."""
    seen = first_version(df, ["recording_id", "topic"], ["type_name"], "arrival_seq").withColumnRenamed("arrival_seq", "_seen")
    fresh = join_keys(seen, known, ["recording_id", "topic"], "left_anti")
    tops = known.groupBy("recording_id").agg(F.max("channel_id").alias("_channels"), F.max("schema_id").alias("_schemas"))
    types = known.where("type_name <> ''").select("recording_id", "type_name", F.col("schema_id").alias("_known")).distinct()
    rows = join_keys(join_keys(fresh, tops, ["recording_id"], "left"), types, ["recording_id", "type_name"], "left")
    is_new = (F.col("type_name") != "") & F.col("_known").isNull()
    first_of_type = F.min("_seen").over(W.partitionBy("recording_id", "type_name"))
    rows = rows.withColumn("_type_seen", F.when(is_new, first_of_type))
    channel = F.row_number().over(W.partitionBy("recording_id").orderBy("_seen"))
    schema = F.dense_rank().over(W.partitionBy("recording_id").orderBy(F.col("_type_seen").asc_nulls_last()))
    numbered = rows.withColumns({
        "channel_id": F.coalesce("_channels", F.lit(0)) + channel,
        "schema_id": F.when(F.col("type_name") == "", 0).when(is_new, F.coalesce("_schemas", F.lit(0)) + schema).otherwise(F.col("_known")),
    })
    return known.select(*_IDS).unionByName(numbered.select(*_IDS))


def replicate_dims(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Each split's own list of the channels and schemas it uses."""
    used = df.select("recording_id", "split", "topic").distinct()
    return join_keys(used, ids, ["recording_id", "topic"])
