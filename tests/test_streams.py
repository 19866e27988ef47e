"""Live operators: many micro-batches must give what one batch over everything gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.support.compare import difference, spark_rows
from tidewire.functions.filters import topic_filter
from tidewire.operators import discovery, rates
from tidewire.operators import recordings as rec
from tidewire.sources import views
from tidewire.streaming import live

LIMITS = rec.Limits(max_bytes=400, max_seconds=100 * 3600, poll_ns=3600 * 1_000_000_000)


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """The events table in nine files of growing arrival order."""
    whole = views.table(spark, sf_dir, "events").orderBy("event_id").toPandas()
    folder = tmp_path_factory.mktemp("events")
    rng, at = random.Random(5), 0
    schema = views.table(spark, sf_dir, "events").schema
    for number in range(9):
        size = len(whole) - at if number == 8 else rng.randint(20, len(whole) // 9)
        part = spark.createDataFrame(whole.iloc[at:at + size], schema)
        part.repartition(1).write.mode("append").parquet(str(folder))
        at += size
        time.sleep(0.05)
    return str(folder), schema


def messages(spark, events):
    return views.messages_from(live.read_files(spark, events[0], events[1], 1))


def whole_messages(spark, sf_dir):
    return views.messages(spark, sf_dir)


def run(writer):
    query = writer.start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("window", [3, 20, 1000])
def test_hz(spark, sf_dir, events, tmp_path, window):
    run(live.hz_stream(messages(spark, events), str(tmp_path), window, 50, live.ONCE))
    got = live.latest_report(spark, str(tmp_path)).withColumns({c: F.round(c, 9) for c in ("avg_hz", "min_hz", "max_hz", "stddev_hz")})
    want = rates.hz(whole_messages(spark, sf_dir), window).withColumns(
        {c: F.round(c, 9) for c in ("avg_hz", "min_hz", "max_hz", "stddev_hz")})
    assert difference(spark_rows(got), spark_rows(want)) is None
    assert live.reports(spark, str(tmp_path)).select("batch_id").distinct().count() == 9


def test_late_times_in_a_later_batch_never_count(spark, tmp_path):
    schema = "recording_id string, topic string, arrival_seq bigint, log_time_ns bigint, source_time_ns bigint, valid boolean"
    second = 1_000_000_000
    for number, times in enumerate([[10, 11, 13], [12, 13, 9], [14, 12, 15]]):
        rows = [("r", "/t", 10 * number + i, t * second, t * second, True) for i, t in enumerate(times)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    parsed = spark.read.parquet(str(tmp_path / "in")).schema
    run(live.hz_stream(live.read_files(spark, str(tmp_path / "in"), parsed, 1), str(tmp_path / "out"), 100, 4, live.ONCE))
    seen = {r.batch_id: (r.window, round(r.avg_hz, 6)) for r in live.reports(spark, str(tmp_path / "out")).collect()}
    assert seen == {0: (3, round(2 / 3, 6)), 1: (3, round(2 / 3, 6)), 2: (5, 0.8)}


def test_endpoints(spark, sf_dir, events, tmp_path):
    sdf = views.endpoint_events_from(live.read_files(spark, events[0], events[1], 1))
    run(live.endpoints_stream(sdf, str(tmp_path), live.ONCE))
    want = discovery.live_endpoints(views.endpoint_events(spark, sf_dir))
    assert difference(spark_rows(live.live_endpoints(spark, str(tmp_path))), spark_rows(want)) is None


def _feed(spark, path, *batches):
    """A change feed of one file a micro-batch."""
    schema = "guid string, seq bigint, topic string, type_name string, is_writer boolean, alive boolean, valid boolean"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return live.read_files(spark, path, spark.read.parquet(path).schema, 1)


def _event(guid, seq, alive=True, topic="/t"):
    return (guid, seq, topic, "T", True, alive, alive)


def test_removed_endpoints_leave_no_state(spark, tmp_path):
    """1,000 endpoints come and go; what is left is one that stays and one that came back."""
    every = [_event(f"g{i}", i) for i in range(1000)]
    gone = [_event(f"g{i}", 2000 + i, False) for i in range(1000)]
    state = live._State(str(tmp_path / "out"), live._ENDPOINTS, "_live")
    for batches, left in (((every,), 1000), ((gone,), 0), (([_event("stays", 5000), _event("g7", 5001), _event("other", 5002, False)],), 2)):
        run(live.endpoints_stream(_feed(spark, str(tmp_path / "in"), *batches), str(tmp_path / "out"), live.ONCE))
        assert state.newest(spark).count() == left == live.live_endpoints(spark, str(tmp_path / "out")).count()
    assert {r.guid for r in live.live_endpoints(spark, str(tmp_path / "out")).collect()} == {"stays", "g7"}
    assert len([p for p in (tmp_path / "out/_live").iterdir() if p.is_dir()]) <= 2


def test_a_removal_lingers_against_late_events(spark, tmp_path):
    batches = [[_event("a", 5), _event("b", 6)], [_event("a", 9, False), _event("a", 8, topic="/u")], [_event("a", 7), _event("b", 2, topic="/old")]]
    run(live.endpoints_stream(_feed(spark, str(tmp_path / "in"), *batches), str(tmp_path / "out"), live.ONCE, linger_ms=600_000))
    assert [tuple(r) for r in live.live_endpoints(spark, str(tmp_path / "out")).collect()] == [("b", "/t", "T", True)]


def test_manifest_lists_what_is_live_and_nothing_else_stays(spark, tmp_path, monkeypatch):
    """Many micro-batches to few splits: closed ones are merged, old ones go from messages and dims, folders do not pile up."""
    second, source, out = 1_000_000_000, str(tmp_path / "in"), str(tmp_path / "out")
    schema = "recording_id string, topic string, type_name string, arrival_seq bigint, log_time_ns bigint, valid boolean, payload_bytes int"
    monkeypatch.setattr(live, "MERGE_EVERY", 3)
    for number in range(10):
        rows = [(r, f"/t{number // 5}", "T", 10 * number + i, (10 * number + i) * second, True, 10) for i in range(10) for r in ("a/b c", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    sdf = live.read_files(spark, source, spark.read.parquet(source).schema, 1)
    limits = rec.Limits(max_bytes=200, poll_ns=second)  # a split is two micro-batches long
    run(live.record_stream(sdf, out, limits=limits, max_splits=3, trigger=live.ONCE))
    whole = rec.assign_splits(spark.read.parquet(source), limits, newest=3).select("recording_id", "arrival_seq", "split")
    got = live.recorded(spark, out).select("recording_id", "arrival_seq", "split")
    assert difference(spark_rows(got), spark_rows(whole)) is None and {r.split for r in whole.collect()} == {2, 3, 4}
    dims = {(r.recording_id, r.split, r.topic) for r in live.recorded_dims(spark, out).collect()}
    assert dims == {(r, s, t) for r in ("a/b c", None) for s, t in ((2, "/t0"), (2, "/t1"), (3, "/t1"), (4, "/t1"))}
    folders = live._Manifest(out, 3).folders(spark)
    left = [p for p in (tmp_path / "out/messages").glob("*/*/split=*")]
    assert any(f.startswith("merged=") for f in folders) and len(folders) <= len(left) <= 2 * len(folders) + 4
    assert all(len([p for p in (tmp_path / "out" / name).iterdir() if p.is_dir()]) <= 2 for name in ("_manifest", "_dims", "_ids", "_state"))


def test_recordings_without_limits_have_dims(spark, tmp_path):
    schema = "recording_id string, topic string, type_name string, arrival_seq bigint, log_time_ns bigint, valid boolean, payload_bytes int"
    rows = [("r", f"/t{i % 3}", "T" if i % 3 else "", i, i, i != 5, 10) for i in range(30)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    sdf = live.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    run(live.record_stream(sdf, str(tmp_path / "out"), trigger=live.ONCE))
    assert live.recorded(spark, str(tmp_path / "out")).count() == 29
    dims = sorted(tuple(r) for r in live.recorded_dims(spark, str(tmp_path / "out")).collect())
    assert dims == [("r", 0, "/t0", "", 1, 0), ("r", 0, "/t1", "T", 2, 1), ("r", 0, "/t2", "T", 3, 1)]


def test_record_and_go_on_after_a_pause(spark, sf_dir, events, tmp_path):
    keep = topic_filter(["/(click|view)/.*"], regex=True)

    def start():
        return live.record_stream(messages(spark, events), str(tmp_path), keep,
                                  trigger={"processingTime": "300 milliseconds"}).start()

    running = live.Run(start)
    time.sleep(1.0)
    running.pause()
    assert running.paused
    running.resume()
    running.query.processAllAvailable()
    running.pause()
    got = live.recorded(spark, str(tmp_path)).select("arrival_seq")
    want = whole_messages(spark, sf_dir).where("valid").where(keep).select("arrival_seq")
    assert spark_rows(got) == spark_rows(want)


def test_splits(spark, sf_dir, events, tmp_path):
    run(live.record_stream(messages(spark, events), str(tmp_path), limits=LIMITS, block_rows=40, trigger=live.ONCE))
    want = rec.assign_splits(whole_messages(spark, sf_dir).where("valid"), LIMITS).select("recording_id", "arrival_seq", "split")
    got = live.recorded(spark, str(tmp_path)).select("recording_id", "arrival_seq", "split")
    assert want.agg(F.max("split")).first()[0] > 3
    assert difference(spark_rows(got), spark_rows(want)) is None
    kept = live.recorded(spark, str(tmp_path), 2).groupBy("recording_id").agg(F.countDistinct("split")).collect()
    assert {r[1] for r in kept} == {2}


def test_a_replayed_batch_changes_nothing(spark, events, tmp_path):
    """The last micro-batch runs a second time, as after a failure between its writes and its commit."""
    path = str(tmp_path)
    run(live.record_stream(messages(spark, events), path, limits=LIMITS, trigger=live.ONCE))
    before = spark_rows(live.recorded(spark, path))
    (tmp_path / "_checkpoint/commits/8").unlink()
    (tmp_path / "_checkpoint/commits/.8.crc").unlink(missing_ok=True)
    run(live.record_stream(messages(spark, events), path, limits=LIMITS, trigger=live.ONCE))
    assert difference(spark_rows(live.recorded(spark, path)), before) is None


def test_progress_is_complete_and_survives_stops(spark, sf_dir, events, tmp_path):
    keep = topic_filter(["/view/.*"], regex=True)
    known = spark.createDataFrame([("/view/1",), ("/view/2",), ("/click/1",), ("/view/1",)], "topic string")
    for _ in range(2):  # the second run finds nothing new, or an unfinished micro-batch
        run(live.progress_stream(messages(spark, events), str(tmp_path), known, keep, trigger=live.ONCE))
        read = whole_messages(spark, sf_dir).where("valid").join(known.distinct(), "topic", "left_semi")
        want = read.agg(F.count("*"), F.count_if(keep), F.sum(F.when(keep, F.col("payload_bytes")))).first()
        assert tuple(live.totals(spark, str(tmp_path)).first()) == tuple(want) and want[0] > want[1] > 0
        assert spark.read.parquet(f"{tmp_path}/progress").select("batch_id").distinct().count() == 9
        (tmp_path / "_checkpoint/commits/8").unlink(missing_ok=True)
        (tmp_path / "_checkpoint/commits/.8.crc").unlink(missing_ok=True)


def test_bounded_runs(spark, tmp_path):
    endless = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    seen = []

    def start(name):
        return live.on_batch(endless, str(tmp_path / name), lambda df, i: seen.append(df.count()),
                             {"processingTime": "100 milliseconds"}).start()

    assert live.run_for(start("time"), 1.5) is False
    query = start("condition")
    assert live.run_for(query, 60, stop_when=lambda: sum(seen) > 20) is True
    assert not query.isActive and sum(seen) > 20


def test_ticks_and_batches(spark, events, tmp_path):
    stamps, counts = [], []

    def note(df, batch_id):
        stamps.append(time.time())
        counts.append((batch_id, df.count()))

    query = live.on_batch(messages(spark, events), str(tmp_path), note).start()  # once a second
    query.processAllAvailable()
    query.stop()
    assert [i for i, _ in counts] == list(range(9)) and sum(n for _, n in counts) == spark.read.parquet(events[0]).count()
    # the first batches may catch up with the clock; later ones keep the interval
    assert all(b - a > 0.5 for a, b in zip(stamps[2:], stamps[3:]))
