"""Cutting recordings into splits and chunks, and the statistics and indexes over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.scalars import NANOS, floor_div
from tidewire.operators.blocks import block_carry, equal_blocks, inside_block, join_keys, with_carry
from tidewire.operators.discovery import discovered
from tidewire.operators.segments import SEGMENT_BLOCK_ROWS, greedy_segments
from tidewire.session import Scratch

# Default chunk size, and the bytes a stored message takes besides its payload
# (record tag 1, record length 8, channel 2, sequence 4, log time 8, publish time 8).
CHUNK_BYTES = 786_432
MESSAGE_OVERHEAD = 31


@dataclass(frozen=True)
class Limits:
    """When a split ends. Checked between poll rounds of ``poll_ns``, so a round is never torn apart."""

    max_bytes: int = 0
    max_seconds: float = 0.0
    poll_ns: int = NANOS

    @property
    def max_ns(self) -> int:
        return int(self.max_seconds * NANOS)


def poll_round(limits: Limits) -> Column:
    return floor_div("log_time_ns", limits.poll_ns)


def split_rounds(rounds: DataFrame, limits: Limits, block_rows: int = SEGMENT_BLOCK_ROWS,
                 opened: DataFrame | None = None) -> DataFrame:
    """The split of every poll round, how many bytes it held before the round, and its start."""
    clocked = rounds.withColumn("_begin", F.col("poll") * limits.poll_ns)
    cut = greedy_segments(clocked, ["recording_id"], "poll", "bytes", target=limits.max_bytes,
                          clock="_begin", span=limits.max_ns, block_rows=block_rows, opened=opened)
    return cut.where("poll is not null").select("recording_id", "poll", "bytes", F.col("segment").alias("split"),
                      F.col("offset").alias("split_offset"), F.col("segment_start").alias("split_start_ns"))


def _rounds(msgs: DataFrame, limits: Limits) -> DataFrame:
    return (msgs.groupBy("recording_id", poll_round(limits).alias("poll"))
            .agg(F.sum("payload_bytes").alias("bytes")))


def split_starts(cuts: DataFrame) -> DataFrame:
    """Per recording the first poll round and the start of every split, in order; the n-th split has number n."""
    first = cuts.groupBy("recording_id", "split").agg(F.min("poll").alias("poll"), F.min("split_start_ns").alias("start"))
    splits = F.sort_array(F.collect_list(F.struct("split", "poll", "start")))
    return first.groupBy("recording_id").agg(splits.alias("_splits")).select(
        "recording_id", F.col("_splits.poll").alias("_polls"), F.col("_splits.start").alias("_starts"))


def last_at_or_before(sorted_values: Column, value: Column) -> Column:
    """Place of the last element of an ascending array that is not above ``value``, by bisection; null if there is none."""
    steps = F.when(F.size(sorted_values) > 1, F.ceil(F.log2(F.size(sorted_values).cast("double"))).cast("int")).otherwise(0)

    def halve(low: Column, power: Column) -> Column:
        middle = low + F.call_function("shiftleft", F.lit(1), power)
        return F.when(F.get(sorted_values, middle) <= value, middle).otherwise(low)

    place = F.aggregate(F.sequence(steps, F.lit(0), F.lit(-1)), F.lit(0), halve)
    return F.when(F.get(sorted_values, F.lit(0)) <= value, place)


def assign_splits(msgs: DataFrame, limits: Limits, block_rows: int = SEGMENT_BLOCK_ROWS,
                  newest: int = 0) -> DataFrame:
    """Messages with their ``split`` and its start, of the ``newest`` splits only if asked for (0 = all).

    A split ends when its payload bytes or its age reach a limit; both start again with the next round that
    has messages. Only one row per poll round takes part in the cutting. Messages find their split by bisection in the starts of
    their recording's splits, one row a recording, so payloads are not shuffled while that table is small enough to be
    broadcast. Messages without a recording are one of their own; those without a log time count for no limit and are in split 0.
    """
    scratch = Scratch(msgs.sparkSession, "splits")
    starts = scratch.keep(split_starts(split_rounds(_rounds(msgs.where("log_time_ns is not null"), limits), limits, block_rows)))
    placed = join_keys(msgs, starts, ["recording_id"], "left")
    placed = placed.withColumn("_at", last_at_or_before(F.col("_polls"), poll_round(limits)))
    split = placed.withColumns({"split": F.coalesce("_at", F.lit(0)).cast("long"), "split_start_ns": F.get("_starts", F.coalesce("_at", F.lit(0)))})
    if newest:
        split = split.where(F.col("split") >= F.greatest(F.coalesce(F.size("_polls"), F.lit(1)), F.lit(1)) - newest)
    return split.drop("_at", "_polls", "_starts")


def stop_at_limit(msgs: DataFrame, limits: Limits, block_rows: int = SEGMENT_BLOCK_ROWS) -> DataFrame:
    """What a recording without splitting keeps: everything up to its first limit hit.

    Up to there nothing is cut, so a round stays if the bytes before it and its age are under the limits: a prefix sum over blocks
    of rounds, no walk.
    """
    key = ["recording_id"]
    rounds = _rounds(msgs, limits)
    blocked, table = equal_blocks(rounds, key, "poll", block_rows, {"_own": (F.col("bytes"), F.sum)}, Scratch(msgs.sparkSession, "limit"))
    placed = with_carry(blocked, block_carry(table, key, F.sum), key)
    inside = F.sum("bytes").over(inside_block(key, "poll").rowsBetween(W.unboundedPreceding, -1))
    before = F.coalesce("_carry", F.lit(0)) + F.coalesce(inside, F.lit(0))
    first = table.groupBy(F.col("recording_id").alias("_recording")).agg(F.min("_low").alias("_first"))
    kept = placed.withColumn("_before", before).join(first, F.col("recording_id").eqNullSafe(F.col("_recording")))
    if limits.max_bytes:
        kept = kept.where(F.col("_before") < limits.max_bytes)
    if limits.max_ns:
        kept = kept.where((F.col("poll") - F.col("_first")) * limits.poll_ns < limits.max_ns)
    last = kept.groupBy("_recording").agg(F.max("poll").alias("_last"))
    return (msgs.withColumn("_poll", poll_round(limits)).join(last, F.col("recording_id").eqNullSafe(F.col("_recording")))
            .where("_poll <= _last").drop("_poll", "_last", "_recording"))


def retain_splits(df: DataFrame, newest: int) -> DataFrame:
    """Keep the newest splits of each recording (0 = all). Split numbers have no gaps."""
    if not newest:
        return df
    last = df.groupBy("recording_id").agg(F.max("split").alias("_last"))
    return join_keys(df, last, ["recording_id"]).where(F.col("split") > F.col("_last") - newest).drop("_last")


def assign_chunks(df: DataFrame, target: int = CHUNK_BYTES,
                  block_rows: int = SEGMENT_BLOCK_ROWS) -> DataFrame:
    """Messages with their ``chunk`` and ``record_bytes``.

    A chunk closes when the next message would reach the target, or it already has. ``df`` is read twice, once
    for its keys and sizes only: pass a stored table.
    """
    sized = df.withColumn("record_bytes", F.col("payload_bytes") + MESSAGE_OVERHEAD)
    cut = greedy_segments(sized, ["recording_id", "split"], "arrival_seq", "record_bytes", target=target,
                          close_before=True, block_rows=block_rows)
    return cut.withColumnRenamed("segment", "chunk").drop("segment_start", "offset")


def chunk_offsets(df: DataFrame) -> DataFrame:
    """Byte offset of each message in its chunk; a chunk is bounded by its target size."""
    before = (W.partitionBy("recording_id", "split", "chunk").orderBy("arrival_seq")
              .rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("offset", F.coalesce(F.sum("record_bytes").over(before), F.lit(0)))


def _joined(names: str) -> Column:
    return F.concat_ws(",", F.sort_array(F.collect_list(names)))


def chunk_index(df: DataFrame) -> DataFrame:
    """Per chunk: time range, size and the topics in it (each with its message count pre-aggregated)."""
    per_topic = df.groupBy("recording_id", "split", "chunk", "topic").agg(
        F.min("log_time_ns").alias("first"), F.max("log_time_ns").alias("last"),
        F.sum("record_bytes").alias("bytes"))
    return per_topic.groupBy("recording_id", "split", "chunk").agg(
        F.min("first").alias("start_time_ns"), F.max("last").alias("end_time_ns"),
        F.sum("bytes").alias("uncompressed_bytes"), _joined("topic").alias("topics"))


def message_index(df: DataFrame) -> DataFrame:
    """Per chunk and topic: ``(time, offset)`` entries in file order."""
    entries = F.sort_array(F.collect_list(F.struct("offset", "log_time_ns")))
    return (chunk_offsets(df).groupBy("recording_id", "split", "chunk", "topic")
            .agg(entries.alias("_sorted"))
            .select("recording_id", "split", "chunk", "topic",
                    F.transform("_sorted", lambda e: F.struct(e["log_time_ns"], e["offset"])).alias("entries")))


def file_statistics(df: DataFrame) -> DataFrame:
    """Per split: messages, channels and schemas in use, chunks and time range.

    Pre-aggregated per channel, so a hot split reaches the last step as a few rows.
    """
    per_channel = df.groupBy("recording_id", "split", "topic", "type_name").agg(
        F.count("*").alias("n"), F.max("chunk").alias("chunk"),
        F.min("log_time_ns").alias("first"), F.max("log_time_ns").alias("last"))
    return per_channel.groupBy("recording_id", "split").agg(
        F.sum("n").alias("messages"),
        F.countDistinct(F.when(F.col("type_name") != "", F.col("type_name"))).alias("schemas"),
        F.countDistinct("topic").alias("channels"),
        (F.max("chunk") + 1).alias("chunks"),
        F.min("first").alias("start_time_ns"), F.max("last").alias("end_time_ns"))


def channel_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("recording_id", "split", "topic").agg(F.count("*").alias("messages"))


def subscribed(endpoints: DataFrame, wanted: Column) -> DataFrame:
    """Announcements a recorder acts on: live, valid writers of user topics that the topic filter lets through."""
    return discovered(endpoints).where("is_writer").where(wanted)


def recording_stats(msgs: DataFrame, endpoints: DataFrame, wanted: Column) -> DataFrame:
    """One row of recorder counters. ``wanted`` is the topic filter, on column ``topic``.

    A recorder learns of writers on user topics that pass its filter and reads those topics alone, so nothing else is
    discovered, received or recorded. Writers and topics discovered are separate counts.
    """
    found = subscribed(endpoints, wanted).select("guid", "topic").distinct()
    known = found.agg(F.countDistinct("guid").alias("writers_discovered"), F.countDistinct("topic").alias("topics_discovered"))
    read = msgs.where("valid").join(found.select("topic").distinct(), "topic", "left_semi")
    traffic = read.agg(
        F.count("*").alias("messages_received"), F.count("*").alias("messages_recorded"), F.sum("payload_bytes").alias("bytes_recorded"),
        ((F.max("log_time_ns") - F.min("log_time_ns")) / NANOS).alias("duration_seconds"))
    # two single rows put side by side
    names = known.columns + traffic.columns
    both = known.unionByName(traffic, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in names])
