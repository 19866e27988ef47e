"""Recordings kept as Parquet: one folder per recording and split, with channels and schemas beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.blocks import join_keys
from tidewire.operators.discovery import assign_ids, replicate_dims
from tidewire.operators.recordings import Limits, assign_splits
from tidewire.operators.types import TypeTables, schema_texts

# Compression names a recording may ask for, as Parquet codecs. Anything else means none.
CODECS = {"zstd": "zstd", "lz4": "lz4_raw"}
NO_CODEC = "uncompressed"

SCHEMA_ENCODING, MESSAGE_ENCODING = "omgidl", "cdr"


def codec(compression: str | None) -> str:
    return CODECS.get(compression or "", NO_CODEC)


def split_recording(msgs: DataFrame, limits: Limits | None, max_splits: int = 0) -> DataFrame:
    if limits is None:
        return msgs.withColumn("split", F.lit(0).cast("long"))
    return assign_splits(msgs, limits, newest=max_splits)


def write_recording(msgs: DataFrame, path: str, limits: Limits | None = None, *, max_splits: int = 0,
                    compression: str | None = "zstd", mode: str = "errorifexists", types: TypeTables | None = None,
                    metadata: DataFrame | None = None) -> None:
    """Write typed messages (``type_name`` set), their channels and their schemas under ``path``.

    With ``types`` a schema's ``data`` is the text of its type and all that needs (:func:`schema_texts`), else empty; ``metadata``
    (topic, metadata map) is stored with the channels.

    The rebalance hint lets adaptive execution size the files: a hot split is written by several tasks, small
    ones share one. Rows are in time order inside each file, so time filters skip row groups.
    """
    split = split_recording(msgs, limits, max_splits)
    ids = assign_ids(msgs)
    stored = join_keys(split, ids.select("recording_id", "topic", "channel_id"), ["recording_id", "topic"])
    options = {"compression": codec(compression)}
    (stored.hint("rebalance", "recording_id", "split")
     .sortWithinPartitions("recording_id", "split", "log_time_ns")
     .write.mode(mode).options(**options).partitionBy("recording_id", "split").parquet(f"{path}/messages"))
    # out of the messages again, not out of the files just written: these are one or more per split
    dims = replicate_dims(split, ids).persist()  # a few rows per split, for two tables
    none = F.lit(None).cast("map<string,string>")
    told = dims.withColumn("metadata", none) if metadata is None else join_keys(dims, metadata.select("topic", "metadata"), ["topic"], "left")
    channels = told.select("recording_id", "split", "channel_id", "topic", F.lit(MESSAGE_ENCODING).alias("message_encoding"), "schema_id",
                           F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    named = dims.where("schema_id <> 0").select("recording_id", "split", "schema_id", "type_name", F.lit(SCHEMA_ENCODING).alias("encoding")).distinct()
    texts = named.withColumn("data", F.lit(None).cast("binary")) if types is None else named.join(schema_texts(types), "type_name", "left")
    schemas = texts.select("recording_id", "split", "schema_id", F.col("type_name").alias("name"), "encoding",
                           F.coalesce("data", F.lit(b"")).alias("data"))
    channels.write.mode(mode).options(**options).parquet(f"{path}/channels")
    schemas.write.mode(mode).options(**options).parquet(f"{path}/schemas")
    dims.unpersist()


def _table(spark: SparkSession, name: str, paths: tuple[str, ...]) -> DataFrame:
    """Each path holds folders of its own partitions, so each is read by itself."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{name}") for path in paths])


def read_messages(spark: SparkSession, *paths: str) -> DataFrame:
    """All splits of the recordings under the given paths as one table."""
    return _table(spark, "messages", paths)


def read_channels(spark: SparkSession, *paths: str) -> DataFrame:
    return _table(spark, "channels", paths)


def read_schemas(spark: SparkSession, *paths: str) -> DataFrame:
    return _table(spark, "schemas", paths)
