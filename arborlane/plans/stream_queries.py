"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlane.plans.registry import query
from arborlane.streaming import events as E


@query("stream_events_fold", "select user_id, cast(count(*) as bigint) as events, cast(count(*) filter (event_type = 'purchase') as bigint) as executed, cast(count(*) filter (event_type = 'click') as bigint) as cached, cast(count(*) filter (event_type = 'error') as bigint) as failed, cast(sum(cast(floor(value) as bigint)) as bigint) as busy, max(event_id) filter (event_type = 'error') as last_failure from events group by user_id")
def fold(t):
    return E.live_fold(t.spark, t.events)


@query("stream_dirty", "select distinct user_id, props as path from events where event_type in ('click', 'purchase', 'error')")
def dirty(t):
    return E.dirty_paths(t.spark, t.events)


@query("stream_sessions", "with x as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hour then 1 else 0 end as opens from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(opens) over (partition by user_id order by ts range unbounded preceding) as k from x) select user_id, cast(floor(epoch(min(ts))) as bigint) as started, cast(count(*) as bigint) as events from s group by user_id, k")
def sessions(t):
    return E.sessions(t.spark, t.events).select("user_id", F.unix_timestamp("started").alias("started"), "events")


@query("stream_truncated", "select user_id from events group by user_id having not bool_or(event_type = 'signup')")
def truncated(t):
    return E.truncated(t.spark, t.events)


@query("stream_seq", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events")
def seq(t):
    return E.numbered(t.spark, t.events)


@query("stream_debounce")
def debounce(t):
    return E.debounce(t.spark, t.events)
