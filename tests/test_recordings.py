import pytest
from pyspark.sql import functions as F

from tidewire.operators import joins
from tidewire.operators import recordings as rec
from tidewire.sources import recordings as store
from tidewire.streaming import live

SCHEMA = ("recording_id string, topic string, type_name string, arrival_seq bigint, log_time_ns bigint, "
          "payload binary, payload_bytes int")
SECOND = 1_000_000_000


def messages(spark, n=200):
    return spark.createDataFrame(
        [(f"r{i % 2}", f"/t{i % 3}", "" if i % 3 == 2 else f"T{i % 3}", i, i * SECOND, b"p" * 10, 14) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("asked,codec", [("zstd", "zstd"), ("lz4", "lz4_raw"), ("none", "uncompressed"),
                                         ("brotli9", "uncompressed"), (None, "uncompressed")])
def test_compression(spark, tmp_path, asked, codec):
    import pyarrow.parquet as pq
    assert store.codec(asked) == codec
    store.write_recording(messages(spark), str(tmp_path / "r"), compression=asked)
    part = next((tmp_path / "r/messages").rglob("*.parquet"))
    used = pq.ParquetFile(part).metadata.row_group(0).column(0).compression
    assert used.lower() in (codec, "lz4" if codec == "lz4_raw" else codec)


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "r")
    msgs = messages(spark)
    store.write_recording(msgs, path, rec.Limits(max_bytes=280, poll_ns=SECOND))
    got = store.read_messages(spark, path)
    assert got.count() == 200 and got.select("split").distinct().count() == 5
    channels = {(r.recording_id, r.split, r.topic): (r.channel_id, r.schema_id) for r in store.read_channels(spark, path).collect()}
    assert len(channels) == 2 * 5 * 3
    assert channels["r0", 0, "/t0"] == (1, 1) and channels["r0", 4, "/t2"] == (2, 0)
    schemas = {(r.recording_id, r.split, r.schema_id, r.name, r.encoding) for r in store.read_schemas(spark, path).collect()}
    assert ("r0", 3, 1, "T0", "omgidl") in schemas and len(schemas) == 2 * 5 * 2
    with pytest.raises(Exception, match="already exists"):
        store.write_recording(msgs, path)


def test_written_files_are_not_read_back(spark, tmp_path, monkeypatch):
    """There is a file or more per split, dear to list and open; channels and schemas come out of the messages."""
    monkeypatch.setattr(store, "read_messages", lambda *_: pytest.fail("the recording was read back"))
    path = str(tmp_path / "r")
    store.write_recording(messages(spark), path, rec.Limits(max_bytes=280, poll_ns=SECOND))
    assert store.read_channels(spark, path).count() == 2 * 5 * 3


def test_newest_splits_only(spark, tmp_path):
    store.write_recording(messages(spark), str(tmp_path / "r"), rec.Limits(max_bytes=280, poll_ns=SECOND), max_splits=2)
    got = store.read_messages(spark, str(tmp_path / "r"))
    assert {r.split for r in got.select("split").distinct().collect()} == {3, 4}
    assert {r.split for r in store.read_channels(spark, str(tmp_path / "r")).collect()} == {3, 4}


def test_null_keys_are_keys(spark, tmp_path):
    """No message is lost for want of a recording or a topic, in a finished or a live recording."""
    rows = messages(spark)
    rows = rows.withColumns({"recording_id": F.when(F.col("arrival_seq") % 2 == 1, F.col("recording_id")),
                             "topic": F.when(F.col("arrival_seq") % 3 > 0, F.col("topic")), "valid": F.lit(True)})
    limits = rec.Limits(max_bytes=280, poll_ns=SECOND)
    split = rec.assign_splits(rows, limits, block_rows=30)
    sizes = {(r.recording_id, r.split): r["count"] for r in split.groupBy("recording_id", "split").count().collect()}
    assert sizes == {(g, n): 20 for g in (None, "r1") for n in range(5)}
    newest = rec.retain_splits(split, 2).groupBy("recording_id").count().collect()
    assert {r.recording_id: r["count"] for r in newest} == {None: 40, "r1": 40}
    path = str(tmp_path / "r")
    store.write_recording(rows, path, limits)
    got = store.read_messages(spark, path)
    assert got.count() == rows.count() and got.where("topic is null").count() == rows.where("topic is null").count()
    assert got.where("recording_id is null").count() == 100 and store.read_channels(spark, path).count() == 2 * 5 * 3
    feed, out = str(tmp_path / "feed"), str(tmp_path / "live")
    for half in ("arrival_seq < 90", "arrival_seq >= 90"):
        rows.where(half).coalesce(1).write.mode("append").parquet(feed)
    live.record_stream(live.read_files(spark, feed, rows.schema, 1), out, limits=limits, max_splits=0, trigger=live.ONCE).start().awaitTermination()
    kept = live.recorded(spark, out).select("recording_id", "arrival_seq", "split")
    want = split.select("recording_id", "arrival_seq", "split")
    assert kept.exceptAll(want).count() == want.exceptAll(kept).count() == 0
    assert live.recorded(spark, out, 2).count() == 80
    dims = live.recorded_dims(spark, out)
    assert dims.count() == 2 * 5 * 3 and dims.select("recording_id", "channel_id").distinct().count() == 2 * 3


def test_time_and_split_filters_reach_the_scan(spark, tmp_path):
    store.write_recording(messages(spark), str(tmp_path / "r"), rec.Limits(max_bytes=280, poll_ns=SECOND))
    df = store.read_messages(spark, str(tmp_path / "r")).where(
        "recording_id = 'r1' and split = 2 and log_time_ns >= 5 and topic = '/t1'").select("topic", "log_time_ns")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(log_time_ns), IsNotNull(topic), GreaterThanOrEqual(log_time_ns,5)" in plan
    assert "PartitionFilters: [isnotnull(recording_id" in plan and "(split#" in plan
    assert "payload" not in plan.split("ReadSchema")[1]


def test_recording_stats_see_what_a_recorder_sees(spark):
    """System topics, topics the filter drops, readers and topics nobody announced do not count."""
    from pyspark.sql import functions as F
    ends = spark.createDataFrame([("g1", "/t0", True, True, True), ("g2", "/t0", True, True, True), ("g1", "/t0", True, True, True),
                                  ("g3", "/t2", False, True, True), ("g4", "/t1", True, True, True), ("g5", "DCPSTopic", True, True, True),
                                  ("g6", "rt/t0", True, True, True), ("g7", "/t0", True, True, False), ("g8", "", True, True, True)],
                                 "guid string, topic string, is_writer boolean, valid boolean, alive boolean")
    msgs = messages(spark).withColumn("valid", F.col("arrival_seq") != 5)
    row = rec.recording_stats(msgs, ends, F.col("topic") != "/t1").first()
    assert row.asDict() == {"writers_discovered": 2, "topics_discovered": 1, "messages_received": 67,
                            "messages_recorded": 67, "bytes_recorded": 67 * 14, "duration_seconds": 198.0}
    nothing = rec.recording_stats(msgs, ends, F.lit(False)).first()
    assert (nothing.writers_discovered, nothing.messages_received, nothing.bytes_recorded) == (0, 0, None)


def test_resolve(spark):
    msgs = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "c"), ("r", 9, "d"), ("s", 1, "e")],
                                 "recording_id string, channel_id int, note string")
    channels = spark.createDataFrame([("r", 1, "/a", 1), ("r", 2, "/b", 0), ("r", 3, "/c", 5)],
                                     "recording_id string, channel_id int, topic string, schema_id int")
    schemas = spark.createDataFrame([("r", 1, "T"), ("s", 5, "U")], "recording_id string, schema_id int, name string")
    good, bad = joins.resolve(msgs, channels, schemas)
    assert {(r.note, r.topic, r.schema_name) for r in good.collect()} == {("a", "/a", "T"), ("b", "/b", None)}
    assert {(r.note, r.status) for r in bad.collect()} == {("c", joins.NO_SCHEMA), ("d", joins.NO_CHANNEL), ("e", joins.NO_CHANNEL)}


def test_bisection(spark):
    for size in range(8):
        rows = spark.range(-1, 9).selectExpr("id as v").withColumn("a", F.array(*[F.lit(2 * i).cast("long") for i in range(size)]).cast("array<bigint>"))
        for r in rows.withColumn("at", rec.last_at_or_before(F.col("a"), F.col("v"))).collect():
            below = [i for i in range(size) if 2 * i <= r.v]
            assert r["at"] == (below[-1] if below else None)


def test_messages_without_a_log_time_stay(spark):
    rows = spark.createDataFrame([("r", 1, 5 * SECOND, 10), ("r", 2, None, 10), ("s", 3, None, 10), ("r", 4, 9 * SECOND, 10)],
                                 "recording_id string, arrival_seq bigint, log_time_ns bigint, payload_bytes int")
    got = rec.assign_splits(rows, rec.Limits(max_bytes=10, poll_ns=SECOND)).collect()
    assert sorted((r.arrival_seq, r.split, r.split_start_ns) for r in got) == [(1, 0, 5 * SECOND), (2, 0, 5 * SECOND), (3, 0, None), (4, 1, 9 * SECOND)]
