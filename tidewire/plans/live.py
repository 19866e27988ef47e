"""Registered queries: live operators, run over all files there are and then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import filters
from tidewire.operators import discovery
from tidewire.operators.recordings import subscribed
from tidewire.plans.discovery import LIVE_SQL
from tidewire.plans.rates import _BLOCK, _WINDOW, HZ_SQL, rounded
from tidewire.plans.recordings import _LIMITS, _ROUND_BLOCK, _VALID_STEPS
from tidewire.plans.registry import query
from tidewire.session import scratch_path
from tidewire.sources import views
from tidewire.streaming import live


def _events(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return live.read_files(spark, f"{sf}/events*.parquet", schema)


def _run(writer):
    writer.start().awaitTermination()


@query("hz_live", HZ_SQL)
def hz_live(spark, sf):
    path = scratch_path(spark, "hz")
    _run(live.hz_stream(views.messages_from(_events(spark, sf)), path, _WINDOW, _BLOCK, live.ONCE))
    return rounded(live.latest_report(spark, path))


@query("endpoints_live", LIVE_SQL)
def endpoints_live(spark, sf):
    path = scratch_path(spark, "endpoints")
    _run(live.endpoints_stream(views.endpoint_events_from(_events(spark, sf)), path, live.ONCE))
    return live.live_endpoints(spark, path)


_ROW = ["recording_id", "topic", "arrival_seq", "log_time_ns", "payload_bytes"]


@query("record_live", f"""
select {', '.join(_ROW)} from messages where valid and regexp_full_match(topic, '/(click|view)/.*')""")
def record_live(spark, sf):
    path = scratch_path(spark, "record")
    keep = filters.topic_filter(["/(click|view)/.*"], regex=True)
    _run(live.record_stream(views.messages_from(_events(spark, sf)), path, keep, trigger=live.ONCE))
    return live.recorded(spark, path).select(*_ROW)


@query("split_live", f"""
select {', '.join(_ROW)}, split from split_messages where valid""", _VALID_STEPS)
def split_live(spark, sf):
    path = scratch_path(spark, "split")
    _run(live.record_stream(views.messages_from(_events(spark, sf)), path, limits=_LIMITS,
                            block_rows=_ROUND_BLOCK, trigger=live.ONCE))
    return live.recorded(spark, path).select(*_ROW, "split")


@query("stop_live", f"""
select {', '.join(_ROW)} from split_messages where valid and split = 0""", _VALID_STEPS)
def stop_live(spark, sf):
    """Without splitting a recording ends at its first limit."""
    path = scratch_path(spark, "stop")
    _run(live.record_stream(views.messages_from(_events(spark, sf)), path, limits=_LIMITS, split=False,
                            block_rows=_ROUND_BLOCK, trigger=live.ONCE))
    return live.recorded(spark, path).select(*_ROW)


@query("retain_live", f"""
select {', '.join(_ROW)}, split from split_messages where valid
qualify dense_rank() over (partition by recording_id order by split desc) <= 3""", _VALID_STEPS)
def retain_live(spark, sf):
    """The files of older splits are gone, so all that is left is read."""
    path = scratch_path(spark, "retain")
    for events in _arrivals(spark, sf):
        _run(live.record_stream(views.messages_from(events), path, limits=_LIMITS, max_splits=3, block_rows=_ROUND_BLOCK,
                                trigger=live.ONCE))
    return live.recorded(spark, path).select(*_ROW, "split")


@query("record_live_dims", """
select distinct recording_id, split, channel_id, topic, schema_id, v.type_name
from split_messages join valid_ids v using (recording_id, topic) where valid""", _VALID_STEPS)
def record_live_dims(spark, sf):
    """Channels and schemas of every split, numbered on over three runs."""
    path = scratch_path(spark, "dims")
    types = discovery.topic_types(views.endpoint_events(spark, sf))
    for events in _arrivals(spark, sf):
        typed = views.messages_from(events).join(types, "topic", "left").withColumn("type_name", F.coalesce("type_name", F.lit("")))
        _run(live.record_stream(typed, path, limits=_LIMITS, block_rows=_ROUND_BLOCK, trigger=live.ONCE))
    return live.recorded_dims(spark, path).select("recording_id", "split", "channel_id", "topic", "schema_id", "type_name")


# --- the same streams, stopped and started again while the table comes in three parts ---------------------------


def _arrivals(spark, sf, files_per_batch=None):
    """Writes the events in three parts of growing arrival order; yields the stream of them after each."""
    events = views.table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0]
    folder = scratch_path(spark, "arrivals")
    for part in range(3):
        low, high = (last + 1) * part // 3, (last + 1) * (part + 1) // 3
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(folder)
        yield live.read_files(spark, folder, events.schema, files_per_batch)


@query("late_data", HZ_SQL)
def late_data(spark, sf):
    """Late times of each part stay under the mark the parts before left behind."""
    path = scratch_path(spark, "late")
    for events in _arrivals(spark, sf):
        _run(live.hz_stream(views.messages_from(events), path, _WINDOW, _BLOCK, live.ONCE))
    return rounded(live.latest_report(spark, path))


@query("pause_resume", f"select {', '.join(_ROW)} from messages where valid")
def pause_resume(spark, sf):
    """Paused while it runs and resumed when more has arrived, three times over."""
    path, run = scratch_path(spark, "pause"), None
    for events in _arrivals(spark, sf):
        if run is None:
            run = live.Run(lambda events=events: live.record_stream(views.messages_from(events), path, trigger=live.TICK).start())
        else:
            run.resume()
        run.query.processAllAvailable()
        run.pause()
    return live.recorded(spark, path).select(*_ROW)


@query("splits_going_on", f"""
select {', '.join(_ROW)}, split from split_messages where valid""", _VALID_STEPS)
def splits_going_on(spark, sf):
    """Open splits are carried over every stop."""
    path = scratch_path(spark, "going-on")
    for events in _arrivals(spark, sf):
        _run(live.record_stream(views.messages_from(events), path, limits=_LIMITS, block_rows=_ROUND_BLOCK,
                                trigger=live.ONCE))
    return live.recorded(spark, path).select(*_ROW, "split")


@query("bounded_run", f"select {', '.join(_ROW)} from messages where valid and topic like '/purchase/%'")
def bounded_run(spark, sf):
    path = scratch_path(spark, "bounded")
    keep = filters.topic_filter(["/purchase/.*"], regex=True)
    writer = live.record_stream(views.messages_from(_events(spark, sf)), path, keep, trigger=live.ONCE)
    live.run_for(writer.start(), seconds=3600)
    return live.recorded(spark, path).select(*_ROW)


@query("bounded_by_limits", f"""
select {', '.join(_ROW)} from split_messages where valid and split = 0""", _VALID_STEPS)
def bounded_by_limits(spark, sf):
    """A run over files that arrive one by one, stopped once every recording has reached its limit, long before its time is up."""
    path = scratch_path(spark, "limits")
    *_, rows = _arrivals(spark, sf, files_per_batch=1)
    run = live.record_stream(views.messages_from(rows), path, limits=_LIMITS, split=False, block_rows=_ROUND_BLOCK, trigger=live.ONCE).start()
    live.run_for(run, 900, stop_when=lambda: live.limits_reached(spark, path))
    if run.isActive or not live.limits_reached(spark, path):
        raise RuntimeError("the run did not end at its limits")
    return live.recorded(spark, path).select(*_ROW)


@query("progress", """
select count(*) as received, count(*) filter (topic like '/view/%') as recorded,
       (sum(payload_bytes) filter (topic like '/view/%'))::bigint as bytes
from messages where valid and topic in (select topic from writers)""", """
writers as (
  select topic from endpoint_events
  where valid and alive and is_writer and topic <> '' and not starts_with(topic, 'DCPS') and not starts_with(topic, 'rt/'))""")
def progress(spark, sf):
    """Counted over three runs of one recording, each going on where the last one stopped."""
    path = scratch_path(spark, "progress")
    known = subscribed(views.endpoint_events(spark, sf), F.lit(True))
    keep = filters.topic_filter(["/view/.*"], regex=True)
    for events in _arrivals(spark, sf):
        _run(live.progress_stream(views.messages_from(events), path, known, keep, live.ONCE))
    return live.totals(spark, path)


@query("tick", HZ_SQL)
def tick(spark, sf):
    """Reports at most once a second, a file each time, until nothing is left to read."""
    path = scratch_path(spark, "tick")
    *_, events = _arrivals(spark, sf, files_per_batch=1)
    run = live.hz_stream(views.messages_from(events), path, _WINDOW, _BLOCK, live.TICK).start()
    run.processAllAvailable()
    run.stop()
    if live.reports(spark, path).select("batch_id").distinct().count() < 3:
        raise RuntimeError("fewer reports than files")
    return rounded(live.latest_report(spark, path))


@query("for_each_batch", """
select topic, count(*) as messages, sum(payload_bytes)::bigint as bytes from messages group by topic""")
def for_each_batch(spark, sf):
    path = scratch_path(spark, "batches")

    def count(rows, batch_id):
        (rows.groupBy("topic").agg(F.count("*").alias("messages"), F.sum("payload_bytes").alias("bytes"))
         .write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}"))

    _run(live.on_batch(views.messages_from(_events(spark, sf)), path, count, live.ONCE))
    return (spark.read.parquet(f"{path}/counts").groupBy("topic")
            .agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes")))
