"""Registered queries: publishing rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import rates
from tidewire.plans.registry import query
from tidewire.sources import views

# Blocks and tiles small enough that the test tables fill several; a cluster keeps the defaults.
_BLOCK, _TILE, _WINDOW = 50, 100, 100
_DAY = 86_400 * 1_000_000_000
_RATES = ["avg_hz", "min_hz", "max_hz", "stddev_hz"]


def rounded(df):
    return df.withColumns({name: F.round(name, 9) for name in _RATES})


@query("monotone", "select recording_id, topic, arrival_seq, log_time_ns, t from kept")
def monotone(spark, sf):
    return rates.monotone(views.messages(spark, sf), _BLOCK)


@query("intervals", "select recording_id, topic, arrival_seq, log_time_ns, t, dt from kept")
def intervals(spark, sf):
    return rates.intervals(views.messages(spark, sf), _BLOCK)


@query("last_n", """
select recording_id, topic, arrival_seq, log_time_ns from messages
qualify row_number() over (partition by recording_id, topic order by arrival_seq desc) <= 30""")
def last_n(spark, sf):
    return rates.last_n(views.messages(spark, sf).select("recording_id", "topic", "arrival_seq", "log_time_ns"), 30)


HZ_SQL = f"""
select recording_id, topic, round(1 / avg(dt), 9) as avg_hz, round(1 / max(dt), 9) as min_hz, round(1 / min(dt), 9) as max_hz,
       round(stddev_pop(dt) / (avg(dt) * avg(dt)), 9) as stddev_hz, count(*) as window
from (select recording_id, topic, (t - lag(t) over (partition by recording_id, topic order by arrival_seq)) / 1e9 as dt
      from (select * from kept
            qualify row_number() over (partition by recording_id, topic order by arrival_seq desc) <= {_WINDOW}))
group by recording_id, topic having count(*) >= 2"""


@query("hz_stats", HZ_SQL)
def hz_stats(spark, sf):
    return rounded(rates.hz(views.messages(spark, sf), _WINDOW, _BLOCK))


_ROLLING_SQL = f"""
select recording_id, topic, arrival_seq, log_time_ns,
       round(1 / avg(dt / 1e9) over w, 9) as avg_hz, round(1 / max(dt / 1e9) over w, 9) as min_hz,
       round(1 / min(dt / 1e9) over w, 9) as max_hz,
       round(stddev_pop(dt / 1e9) over w / (avg(dt / 1e9) over w * avg(dt / 1e9) over w), 9) as stddev_hz,
       least({_WINDOW}, row_number() over (partition by recording_id, topic order by arrival_seq)) as "window"
from kept
window w as (partition by recording_id, topic order by arrival_seq rows between {_WINDOW - 2} preceding and current row)"""


@query("rolling_hz", f'select * from ({_ROLLING_SQL}) where "window" >= 2')
def rolling_hz(spark, sf):
    return rounded(rates.rolling_hz(views.messages(spark, sf), _WINDOW, _BLOCK, _TILE))


@query("hz_reports", f"""
select recording_id, topic, log_time_ns // {_DAY} as tick, avg_hz, min_hz, max_hz, stddev_hz, "window"
from ({_ROLLING_SQL}) where "window" >= 2
qualify row_number() over (partition by recording_id, topic, tick order by arrival_seq desc) = 1""")
def hz_reports(spark, sf):
    return rounded(rates.hz_reports(views.messages(spark, sf), _DAY, _WINDOW, _BLOCK, _TILE))
