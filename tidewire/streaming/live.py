"""Live operators on Structured Streaming.

The stateful ones run as ``foreachBatch`` over the batch operators: state is one small table, read at the start
of a micro-batch and written at its end, and the micro-batch itself is processed with the same block-wise plans as
a recording, so one hot topic or recording is spread over all tasks instead of meeting a single state task.
Micro-batches are numbered and replayed whole after a failure; everything a micro-batch writes goes to a folder of
its own number, so a replay overwrites its own first attempt. Of state only the folders of the last two micro-batches are
kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tidewire.functions.filters import not_system
from tidewire.operators.blocks import join_keys
from tidewire.operators.discovery import more_ids, replicate_dims
from tidewire.operators.rates import DEFAULT_WINDOW, LATEST_BLOCK_ROWS, STREAM, last_n, latest_stamps, stamps, summarize, window_size
from tidewire.operators.recordings import Limits, poll_round, retain_splits, split_rounds
from tidewire.operators.segments import SEGMENT_BLOCK_ROWS
from tidewire.session import Scratch

TICK = {"processingTime": "1 second"}
ONCE = {"availableNow": True}


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def on_batch(sdf: DataFrame, path: str, fn: Callable[[DataFrame, int], None],
             trigger: dict | None = None) -> DataStreamWriter:
    """Calls ``fn(rows, batch_id)`` for each micro-batch; by default at most once a second."""
    return (sdf.writeStream.foreachBatch(fn).option("checkpointLocation", f"{path}/_checkpoint")
            .trigger(**(trigger or TICK)))


class _Folder:
    """A folder on the file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.paths = spark._jvm.org.apache.hadoop.fs
        self.path = self.paths.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [status.getPath().getName() for status in self.system.listStatus(self.path)] if self.system.exists(self.path) else []

    def holds(self, name: str) -> bool:
        return self.system.exists(self.paths.Path(self.path, name))

    def delete(self, name: str) -> None:
        self.system.delete(self.paths.Path(self.path, name), True)


class _State:
    """A table carried from one micro-batch to the next: a folder per micro-batch, of which the last two stay."""

    def __init__(self, path: str, schema: str, name: str = "_state"):
        self.path, self.schema = f"{path}/{name}", schema

    def _written(self, folder: _Folder) -> list[int]:
        return sorted(int(name) for name in folder.names() if name.isdigit() and folder.holds(f"{name}/_SUCCESS"))

    def _read(self, spark: SparkSession, number: int | None) -> DataFrame:
        if number is None:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/{number}")

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self._read(spark, max((n for n in self._written(_Folder(spark, self.path)) if n < batch_id), default=None))

    def after(self, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        folder = _Folder(df.sparkSession, self.path)
        for number in self._written(folder):
            if number < batch_id - 1:
                folder.delete(str(number))
        return self._read(df.sparkSession, batch_id)

    def newest(self, spark: SparkSession) -> DataFrame:
        """As of the last micro-batch that wrote it."""
        return self._read(spark, max(self._written(_Folder(spark, self.path)), default=None))


def _write_batch(df: DataFrame, path: str, table: str, batch_id: int, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/{table}/batch_id={batch_id}")


# --- publishing rates ------------------------------------------------------------------------------------------


def hz_stream(msgs: DataFrame, path: str, window: int = DEFAULT_WINDOW, block_rows: int = LATEST_BLOCK_ROWS,
              trigger: dict | None = None) -> DataStreamWriter:
    """Rate statistics of every topic of every recording after each micro-batch, under ``path/reports``.

    State is the last ``window`` counted timestamps per stream. Their maximum is the mark late and duplicate times
    stay under, whatever micro-batch they come in.
    """
    state = _State(path, "recording_id string, topic string, t bigint")
    window = window_size(window)

    def step(batch: DataFrame, batch_id: int) -> None:
        held = state.before(batch.sparkSession, batch_id)
        marks = held.groupBy(*STREAM).agg(F.max("t").alias("_mark"))
        fresh = stamps(batch)
        known = fresh["recording_id"].eqNullSafe(marks["recording_id"]) & fresh["topic"].eqNullSafe(marks["topic"])
        fresh = (fresh.join(marks, known, "left").where(F.col("_mark").isNull() | (F.col("t") > F.col("_mark")))
                 .select(*[fresh[name] for name in fresh.columns]))
        latest = last_n(held.unionByName(latest_stamps(fresh, window, block_rows)), window, order="t")
        _write_batch(summarize(state.after(latest, batch_id)), path, "reports", batch_id)

    return on_batch(msgs, path, step, trigger)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """All reports, numbered by ``batch_id``."""
    return spark.read.parquet(f"{path}/reports")


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    every = reports(spark, path)
    newest = every.agg(F.max("batch_id").alias("batch_id"))
    return every.join(newest, "batch_id", "left_semi").drop("batch_id")


# --- discovery -------------------------------------------------------------------------------------------------

_FACTS = ["topic", "type_name", "is_writer", "alive"]
_ENDPOINTS = "guid string, seq bigint, topic string, type_name string, is_writer boolean, alive boolean, removed_ms bigint"


def endpoints_stream(endpoints: DataFrame, path: str, trigger: dict | None = None, linger_ms: int = 0) -> DataStreamWriter:
    """The endpoints alive after each micro-batch, under ``path/_live``.

    State is a row per GUID, its last event, and follows the live endpoints: one that is removed leaves nothing behind, at once or
    ``linger_ms`` after the micro-batch that removed it. Until then an event older than the removal changes nothing even if it comes
    in a later micro-batch; afterwards it announces the endpoint anew. Within a micro-batch the order of the feed always
    counts. Events are folded per GUID in every task first, and merged into the state by one join.
    """
    wanted = endpoints.where(not_system() & (F.col("valid") | ~F.col("alive")))
    table = _State(path, _ENDPOINTS, "_live")

    def step(batch: DataFrame, batch_id: int) -> None:
        now_ms = int(time.time() * 1000)
        held = table.before(batch.sparkSession, batch_id)
        last = batch.groupBy(F.col("guid").alias("_guid")).agg(F.max_by(F.struct("seq", *_FACTS), "seq").alias("_now"))
        both = held.join(last, F.col("guid").eqNullSafe(F.col("_guid")), "full_outer")
        newer = F.col("_now").isNotNull() & (F.col("seq").isNull() | (F.col("_now.seq") > F.col("seq")))
        merged = both.select(F.coalesce("guid", "_guid").alias("guid"), *[
            F.when(newer, F.col(f"_now.{name}")).otherwise(F.col(name)).alias(name) for name in ("seq", *_FACTS)],
            F.when(newer, F.when(~F.col("_now.alive"), F.lit(now_ms))).otherwise(F.col("removed_ms")).alias("removed_ms"))
        table.after(merged.where(F.col("alive") | (F.col("removed_ms") > now_ms - linger_ms)), batch_id)

    return on_batch(wanted, path, step, trigger)


def live_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """Endpoints alive as of the last micro-batch."""
    return _State(path, _ENDPOINTS, "_live").newest(spark).where("alive").select("guid", "topic", "type_name", "is_writer")


# --- recording -------------------------------------------------------------------------------------------------


def record_stream(msgs: DataFrame, path: str, keep: Column | None = None, limits: Limits | None = None, *, split: bool = True,
                  max_splits: int = 0, block_rows: int = SEGMENT_BLOCK_ROWS, trigger: dict | None = None) -> DataStreamWriter:
    """Appends wanted, valid messages under ``path/messages``; topics may appear at any time.

    With limits the recording is split as it grows, by the same rounds and cuts as a finished one, and of every recording the
    files of all but the newest ``max_splits`` splits are deleted (0 = none). Without ``split`` it ends at its first limit.

    Messages with a ``type_name`` also give every split its channels and schemas (:func:`recorded_dims`), numbered as they appear.

    A split recording keeps a manifest of the folders that are live: closed splits that many micro-batches wrote to are merged into one
    folder, splits that are no longer kept disappear from messages and dims alike, and the folders they leave are deleted one
    micro-batch later, when no replay can ask for them.
    """
    wanted = msgs.where("valid")
    if keep is not None:
        wanted = wanted.where(keep)
    if limits is not None:
        return on_batch(wanted, path, _split_step(path, limits, block_rows, split, max_splits), trigger)
    if "type_name" in msgs.columns:
        return on_batch(wanted, path, _whole_step(path), trigger)
    return (wanted.writeStream.format("parquet").partitionBy("recording_id")
            .option("path", f"{path}/messages").option("checkpointLocation", f"{path}/_checkpoint")
            .trigger(**(trigger or TICK)))


_IDS = "recording_id string, topic string, type_name string, channel_id int, schema_id int"
_DIMS = "recording_id string, split bigint, topic string, type_name string, channel_id int, schema_id int"
_OPEN = "recording_id string, segment bigint, open_size bigint, open_clock bigint, poll bigint, bytes bigint"
MERGE_EVERY = 8  # micro-batches


def _whole_step(path: str):
    """A recording without splits, with the channels and schemas it uses."""
    ids, dims = _State(path, _IDS, "_ids"), _State(path, _DIMS, "_dims")

    def step(batch: DataFrame, batch_id: int) -> None:
        scratch = Scratch(batch.sparkSession, "batch")
        rows = scratch.keep(batch)
        known = ids.after(more_ids(rows, ids.before(batch.sparkSession, batch_id)), batch_id)
        used = replicate_dims(rows.withColumn("split", F.lit(0).cast("long")), known).select(*_names(_DIMS))
        dims.after(dims.before(batch.sparkSession, batch_id).unionByName(used).distinct(), batch_id)
        _write_batch(rows, path, "messages", batch_id, "recording_id")
        scratch.drop(rows)

    return step


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class _Manifest:
    """Which folders of ``path/messages`` hold which split: one row a folder, and since when it is dead (null: live)."""

    SCHEMA = "recording_id string, split bigint, folder string, dead bigint"

    def __init__(self, path: str, max_splits: int):
        self.path, self.max_splits, self.state = path, max_splits, _State(path, self.SCHEMA, "_manifest")

    def rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        """Live rows of folders that have just been written, read off their names."""
        found = []
        for folder in folders:
            root = _Folder(spark, f"{self.path}/messages/{folder}")
            for recording in root.names():
                if "=" in recording:
                    splits = _Folder(spark, f"{self.path}/messages/{folder}/{recording}").names()
                    found += [(_unescaped(recording), int(name.partition("=")[2]), f"{folder}/{recording}/{name}") for name in splits if "=" in name]
        return spark.createDataFrame(found, "recording_id string, split bigint, folder string").withColumn("dead", F.lit(None).cast("long"))

    def commit(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Takes in the micro-batch's folders, retires old splits, merges the folders of closed splits now and then; returns live splits."""
        held = self.state.before(spark, batch_id).persist()
        for row in held.where(F.col("dead") < batch_id).select("folder").collect():
            _Folder(spark, f"{self.path}/messages").delete(row["folder"])
        now = held.where(F.col("dead").isNull()).unionByName(self.rows(spark, [f"batch_id={batch_id}"])).persist()
        last = now.groupBy("recording_id").agg(F.max("split").alias("_last"))
        marked = join_keys(now, last, ["recording_id"])
        old = F.col("split") <= F.col("_last") - self.max_splits if self.max_splits else F.lit(False)
        marked = marked.withColumn("_old", old)
        several = marked.where(~F.col("_old") & (F.col("split") < F.col("_last"))).groupBy("recording_id", "split").agg(
            F.collect_list("folder").alias("folders")).where("size(folders) > 1")
        merged = several.collect() if batch_id % MERGE_EVERY == MERGE_EVERY - 1 else []
        extra = self.rows(spark, [])
        gone = [folder for row in merged for folder in row["folders"]]
        if merged:
            target = f"merged={batch_id}"
            (_read_folders(spark, self.path, gone).hint("rebalance", "recording_id", "split")
             .write.mode("overwrite").partitionBy("recording_id", "split").parquet(f"{self.path}/messages/{target}"))
            extra = self.rows(spark, [target])
        dead = F.when(F.col("_old") | F.col("folder").isin(gone) if gone else F.col("_old"), batch_id).cast("long")
        after = self.state.after(marked.withColumn("dead", dead).select(*_names(self.SCHEMA)).unionByName(extra), batch_id)
        held.unpersist()
        now.unpersist()
        return after.where("dead is null").select("recording_id", "split").distinct()

    def folders(self, spark: SparkSession) -> list[str]:
        return [row["folder"] for row in self.state.newest(spark).where("dead is null").select("folder").collect()]


_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _unescaped(folder: str) -> str | None:
    value = folder.partition("=")[2]
    return None if value == _NULL_FOLDER else unquote(value)


def _read_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The messages of some folders of splits, with recording and split."""
    by_root: dict[str, list[str]] = {}
    for folder in sorted(folders):
        by_root.setdefault(folder.split("/")[0], []).append(f"{path}/messages/{folder}")
    parts = []
    for root, some in sorted(by_root.items()):
        schema = spark.read.parquet(some[0]).schema.add("recording_id", "string").add("split", "long")
        parts.append(spark.read.schema(schema).option("basePath", f"{path}/messages/{root}").parquet(*some))
    return reduce(DataFrame.unionByName, parts)


def _split_step(path: str, limits: Limits, block_rows: int, split: bool, max_splits: int):
    """State per recording: its open split up to the last poll round, and that round, which may go on."""
    state = _State(path, _OPEN)
    ids, dims, manifest = _State(path, _IDS, "_ids"), _State(path, _DIMS, "_dims"), _Manifest(path, max_splits)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, "batch")
        held = state.before(spark, batch_id)
        at = held.select("recording_id", F.col("poll").alias("_last"))
        # a late message belongs to the round being recorded when it comes, one without a log time to the first or the present round
        placed = join_keys(batch, at, ["recording_id"], "left")
        placed = scratch.keep(placed.withColumn("poll", F.greatest(poll_round(limits), F.col("_last"))).drop("_last"))
        rounds = (placed.where("poll is not null").groupBy("recording_id", "poll").agg(F.sum("payload_bytes").alias("bytes"))
                  .unionByName(held.select("recording_id", "poll", "bytes"))
                  .groupBy("recording_id", "poll").agg(F.sum("bytes").alias("bytes")))
        cuts = scratch.keep(split_rounds(rounds, limits, block_rows, opened=held.drop("poll", "bytes")))
        numbered = join_keys(placed, cuts.select("recording_id", "poll", "split"), ["recording_id", "poll"], "left").drop("poll")
        numbered = numbered.withColumn("split", F.coalesce("split", F.lit(0).cast("long")))
        splits = numbered if split else numbered.where("split = 0")
        # the rebalance hint lets adaptive execution size the files, one or a few for each split
        _write_batch(splits.hint("rebalance", "recording_id", "split"), path, "messages", batch_id, "recording_id", "split")
        live = manifest.commit(spark, batch_id)
        if "type_name" in batch.columns:
            known = ids.after(more_ids(placed, ids.before(spark, batch_id)), batch_id)
            used = replicate_dims(splits, known).select(*_names(_DIMS))
            every = dims.before(spark, batch_id).unionByName(used).distinct()
            dims.after(join_keys(every, live, ["recording_id", "split"], "left_semi"), batch_id)
        last = (cuts.groupBy("recording_id")
                .agg(F.max_by(F.struct("split", "split_offset", "split_start_ns", "poll", "bytes"), "poll").alias("r")))
        state.after(last.select(
            "recording_id", F.col("r.split").alias("segment"), F.col("r.split_offset").alias("open_size"),
            F.col("r.split_start_ns").alias("open_clock"), "r.poll", "r.bytes"), batch_id)
        scratch.drop(placed, cuts)

    return step


def recorded(spark: SparkSession, path: str, max_splits: int = 0) -> DataFrame:
    """What a live recording holds, of split ones the newest ``max_splits`` (0 = all)."""
    folders = _Manifest(path, max_splits).folders(spark)
    if not folders:
        return spark.read.parquet(f"{path}/messages").drop("batch_id")
    return retain_splits(_read_folders(spark, path, folders), max_splits)


def recorded_dims(spark: SparkSession, path: str) -> DataFrame:
    """Channels of each split of a live recording with their schema: recording_id, split, topic, channel_id, schema_id, type_name."""
    return _State(path, _DIMS, "_dims").newest(spark)


# --- running ---------------------------------------------------------------------------------------------------


_COUNTERS = ("received", "recorded", "bytes")


def progress_stream(msgs: DataFrame, path: str, subscribed: DataFrame, keep: Column | None = None,
                    trigger: dict | None = None) -> DataStreamWriter:
    """Records like :func:`record_stream` and counts what goes through: one row per micro-batch under ``path/progress``.

    Received are valid messages on ``subscribed`` topics (a table with column ``topic``), recorded those of them that ``keep``
    lets through. A row belongs to its micro-batch and replaces the one of a failed attempt, so the sums hold over restarts and
    over any number of micro-batches. The counters are observed on the rows as they are written, so each micro-batch is read once.
    """
    topics = subscribed.select("topic").distinct()
    kept = F.lit(True) if keep is None else keep

    def step(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"progress-{batch_id}")
        read = batch.where("valid").join(topics, "topic", "left_semi").observe(
            seen, F.count(F.lit(1)).alias("received"), F.count(F.when(kept, 1)).alias("recorded"),
            F.coalesce(F.sum(F.when(kept, F.col("payload_bytes"))), F.lit(0)).cast("long").alias("bytes"))
        _write_batch(read.where(kept), path, "messages", batch_id, "recording_id")
        counts = batch.sparkSession.createDataFrame([tuple(seen.get[name] for name in _COUNTERS)], ", ".join(f"{name} long" for name in _COUNTERS))
        _write_batch(counts, path, "progress", batch_id)

    return on_batch(msgs, path, step, trigger)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: everything :func:`progress_stream` has counted so far."""
    return spark.read.parquet(f"{path}/progress").agg(*[F.sum(name).alias(name) for name in _COUNTERS])


def limits_reached(spark: SparkSession, path: str) -> bool:
    """Whether every recording under ``path`` that has begun has reached a limit of its :func:`record_stream`."""
    open_splits = _State(path, _OPEN).newest(spark).select("segment").collect()  # a row per recording
    return bool(open_splits) and all(row["segment"] > 0 for row in open_splits)


def run_for(query: StreamingQuery, seconds: float, stop_when: Callable[[], bool] = lambda: False,
            poll: float = 0.2) -> bool:
    """Lets a query run until it ends, ``stop_when`` holds or the time is up; then stops it.

    True if it ended or was stopped by the condition, false if time ran out.
    """
    left = seconds
    while left > 0:
        ended = query.awaitTermination(min(poll, left))
        if ended or stop_when():
            query.stop()
            return True
        left -= poll
    query.stop()
    return False


class Run:
    """A stream that can pause. Resuming goes on from the same checkpoint, so nothing is lost in between."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self._start = start
        self.query = start()

    @property
    def paused(self) -> bool:
        return not self.query.isActive

    def pause(self) -> None:
        self.query.stop()

    def resume(self) -> None:
        if self.paused:
            self.query = self._start()
