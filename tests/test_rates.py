import math
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import blocks, rates
from tidewire.session import Scratch

SCHEMA = ("recording_id string, topic string, arrival_seq bigint, log_time_ns bigint, source_time_ns bigint, "
          "valid boolean, payload binary, payload_bytes int")
NS = 1_000_000_000


def stream(spark, times, topic="/t", first=0):
    return spark.createDataFrame(
        [("r", topic, first + i, round(t * NS), round(t * NS), True, b"x", 5) for i, t in enumerate(times)], SCHEMA)


def fold(times):
    """Kept (position, time) in arrival order."""
    kept = []
    for i, t in enumerate(times):
        if not kept or t > kept[-1][1]:
            kept.append((i, t))
    return kept


def stats(times):
    steps = [(b - a) / NS for a, b in zip(times, times[1:])]
    mean = sum(steps) / len(steps)
    spread = math.sqrt(sum((s - mean) ** 2 for s in steps) / len(steps))
    return 1 / mean, 1 / max(steps), 1 / min(steps), spread / mean ** 2, len(times)


@pytest.mark.parametrize("times,window,want", [
    ([0, 0.1, 0.2, 0.4], 100, (7.5, 5, 10, 2.651650, 4)),
    ([0, 0.1, 0.1, 0.05, 0.2], 100, (10, 10, 10, 0, 3)),
    ([0, 1, 1.1, 1.2], 3, (10, 10, 10, 0, 3)),
    ([0, 1, 1.1, 1.2], 1, (10, 10, 10, 0, 2)),
])
def test_vectors(spark, times, window, want):
    # a source time of 0 counts as missing, so start later
    row = rates.hz(stream(spark, [t + 10 for t in times]), window).first()
    assert row[2:] == pytest.approx(want, abs=1e-6)


def test_one_stamp_gives_no_row(spark):
    assert rates.hz(stream(spark, [5])).count() == 0
    assert rates.rolling_hz(stream(spark, [5])).count() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    """Two topics with shuffled arrivals, one holding most rows; sequence numbers shared and with gaps."""
    rng = random.Random(7)
    rows, clock = [], 1000 * NS
    for seq in range(0, 6000, 2):
        clock += rng.randint(1, 50) * 10_000_000
        t = clock - rng.choice([0, 0, 0, rng.randint(0, 900_000_000)])
        topic = "/hot" if rng.random() < 0.9 else "/cold"
        rows.append(("r", topic, seq, clock, rng.choice([t, t, 0]), rng.random() > 0.05, b"x", 5))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected(rows):
    out = {}
    for _, topic, seq, log, source, valid, _, _ in sorted(rows, key=lambda r: r[2]):
        if valid:
            out.setdefault(topic, []).append((seq, log, source if source > 0 else log))
    kept = {}
    for topic, entries in out.items():
        kept[topic] = [(entries[i][0], entries[i][1], t) for i, t in fold([e[2] for e in entries])]
    return kept


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 20])
def test_monotone_and_intervals(mixed, block_rows):
    rows, df = mixed
    got = {}
    for r in rates.intervals(df, block_rows).orderBy("topic", "arrival_seq").collect():
        got.setdefault(r.topic, []).append((r.arrival_seq, r.log_time_ns, r.t, r.dt))
    want = expected(rows)
    for topic, kept in want.items():
        steps = [None] + [b[2] - a[2] for a, b in zip(kept, kept[1:])]
        assert got[topic] == [(*k, d) for k, d in zip(kept, steps)]
    assert rates.monotone(df, block_rows).count() == sum(map(len, want.values()))


@pytest.mark.parametrize("block_rows,window", [(1, 5), (16, 50), (100, 2), (1 << 20, 100), (33, 5000)])
def test_hz(mixed, block_rows, window):
    rows, df = mixed
    got = {r.topic: tuple(r)[2:] for r in rates.hz(df, window, block_rows).collect()}
    for topic, kept in expected(rows).items():
        assert got[topic] == pytest.approx(stats([t for _, _, t in kept[-window:]]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block_rows,tile_rows,window", [(64, 10, 10), (500, 37, 20), (1 << 20, 1 << 17, 100), (9, 5, 2)])
def test_rolling(mixed, block_rows, tile_rows, window):
    rows, df = mixed
    got = {(r.topic, r.arrival_seq): tuple(r)[4:] for r in rates.rolling_hz(df, window, block_rows, tile_rows).collect()}
    want = {}
    for topic, kept in expected(rows).items():
        for i in range(1, len(kept)):
            want[topic, kept[i][0]] = stats([t for _, _, t in kept[max(0, i - window + 1):i + 1]])
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_reports(mixed):
    rows, df = mixed
    every = 30 * NS
    got = {(r.topic, r.tick): tuple(r)[3:] for r in rates.hz_reports(df, every, 10, 64, 16).collect()}
    want = {}
    for topic, kept in expected(rows).items():
        for i in range(1, len(kept)):
            want[topic, kept[i][1] // every] = stats([t for _, _, t in kept[max(0, i - 9):i + 1]])
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_reports_repeat_while_idle(spark):
    df = stream(spark, [10, 10.5, 14.2])
    got = [(r.tick, round(r.avg_hz, 6)) for r in rates.hz_reports(df, repeat_idle=True).orderBy("tick").collect()]
    assert got == [(10, 2.0), (11, 2.0), (12, 2.0), (13, 2.0), (14, round(2 / 4.2, 6))]
    assert [r.tick for r in rates.hz_reports(df).orderBy("tick").collect()] == [10, 14]


def test_last_n(mixed):
    rows, df = mixed
    got = rates.last_n(df, 5).groupBy("topic").count().collect()
    assert {r.topic: r["count"] for r in got} == {"/hot": 5, "/cold": 5}


def numbered(name, step, rate, rows, first=0):
    return [(name, "/t", first + step * i, round((1 + i / rate) * NS), round((1 + i / rate) * NS), True, b"x", 5) for i in range(rows)]


def test_recordings_numbered_from_zero_stay_apart(spark):
    df = spark.createDataFrame(numbered("a", 1, 1.0, 50) + numbered("b", 1, 0.1, 50) + numbered(None, 1, 5.0, 9), SCHEMA)
    got = {r.recording_id: (round(r.avg_hz, 6), r["window"]) for r in rates.hz(df, 20, 8).collect()}
    assert got == {"a": (1.0, 20), "b": (0.1, 20), None: (5.0, 9)}
    assert rates.rolling_hz(df, 20, 8, 16).groupBy("recording_id").count().collect().__len__() == 3
    one = rates.hz(df, 20, 8, keys=("topic",))
    assert one.columns[0] == "topic" and one.count() == 1


@pytest.mark.parametrize("step", [1, 1000, 7_000_000_001])
def test_blocks_hold_rows_whatever_the_sequence_counts(spark, step):
    rows = numbered("a", step, 1.0, 400, first=10**12) + numbered("b", step * 3, 1.0, 40) + [("c", "/once", 5, NS, NS, True, b"x", 5)]
    df = rates.stamps(spark.createDataFrame(rows, SCHEMA))
    blocked, _ = blocks.equal_blocks(df, rates.STREAM, "arrival_seq", 16, {}, Scratch(spark, "test"))
    sizes = blocked.groupBy(*rates.STREAM, blocks.BLOCK).count().collect()
    assert max(r["count"] for r in sizes) <= 17 and len([r for r in sizes if r.recording_id == "a"]) <= 27
    assert len([r for r in sizes if r.recording_id == "b"]) <= 14
    whole = spark.createDataFrame(rows, SCHEMA)
    assert {r.recording_id: round(r.avg_hz, 6) for r in rates.hz(whole, 30, 16).collect()} == {"a": 1.0, "b": 1.0}


@pytest.mark.parametrize("far", [[10**12], [10**12, -10**15, 3 * 10**17]])
def test_no_block_is_full_beside_a_far_outlier(spark, far):
    """A burst numbered row by row, others far from it, and many rows of one value, which no cut can part."""
    rows = spark.range(5000).selectExpr("'hot' as k", "id as o").union(spark.createDataFrame([("hot", o) for o in far] + [("few", 7)] * 50 + [(None, 9), ("hot", None)], "k string, o bigint"))
    facts = {"_own": (F.col("o"), F.max)}
    blocked, table = blocks.equal_blocks(rows.repartition(3), ["k"], "o", 20, facts, Scratch(spark, "test"))
    sizes = {(r.k, r[blocks.BLOCK]): r for r in blocked.groupBy("k", blocks.BLOCK).agg(
        F.count("*").alias("rows"), F.min("o").alias("low"), F.max("o").alias("high")).collect()}
    assert sum(r.rows for r in sizes.values()) == rows.count()
    assert all(r.rows <= 40 or r.low == r.high for r in sizes.values()) and len(sizes) < 5000
    told = table.collect()
    assert {(r.k, r[blocks.BLOCK]): (r["_rows"], r["_low"], r["_high"], r["_own"]) for r in told} == {
        key: (r.rows, r.low, r.high, r.high) for key, r in sizes.items()} and len(told) == len(sizes)
    spans = sorted((r["_low"], r["_high"]) for r in told if r.k == "hot" and r["_low"] is not None)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_no_rows(spark):
    assert rates.hz(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rates.rolling_hz(spark.createDataFrame([], SCHEMA)).count() == 0
