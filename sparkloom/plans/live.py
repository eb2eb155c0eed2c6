"""Registered queries of streams with timers, drained over the events table; their SQL models the same rules row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ev, timers as tm
from .queries import SQL, register, table

PERIOD_MS = 6 * 3600 * 1000


def event_stream(s, d):
    """The events as a stream: a user is a session, an error ends it."""
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return stream.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))


@register("stream_heartbeats", f"""with e as (select user_id as session_id, epoch_ns(ts) // 1000000 as ms, event_type as type, lead(epoch_ns(ts) // 1000000) over (partition by user_id order by epoch_ns(ts) // 1000000, event_id) as next, (select max(epoch_ns(ts) // 1000000) from events) as until from events),
 b as (select session_id, ms, cast(floor((coalesce(next - 1, until) - ms) / {PERIOD_MS}) as bigint) as n from e where type <> 'error')
 select session_id, ms, 'event' as kind from e union all select session_id, ms, 'end' from e where type = 'error' union all select session_id, ms + {PERIOD_MS} * unnest(generate_series(1, n)), 'heartbeat' from b""")
def stream_heartbeats(s, d):
    return ev.run_now(tm.heartbeat_stream(event_stream(s, d), PERIOD_MS, "error"), "append")


@register("session_heartbeats", f"select kind, count(*) as n, min(ms) as first, max(ms) as last from ({SQL['stream_heartbeats']}) group by kind")
def session_heartbeats(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    return tm.heartbeats(e, PERIOD_MS, "error").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first"), F.max("ms").alias("last"))


#: One row after another: a queue of 3 places, of which one is freed every 12 hours.
QUEUE = (3, 1, 12 * 3600 * 1000)


@register("stream_bounded_queue", f"""with recursive e as (select user_id as session_id, event_id as seq, epoch_ns(ts) // 1000000 // {QUEUE[2]} as tick, row_number() over (partition by user_id order by epoch_ns(ts) // 1000000, event_id) as k from events),
 q(session_id, seq, k, tick, kept, waiting, dropped) as (select session_id, seq, k, tick, true, cast(1 as bigint), cast(0 as bigint) from e where k = 1
  union all select e.session_id, e.seq, e.k, e.tick, left_ < {QUEUE[0]}, left_ + cast(left_ < {QUEUE[0]} as bigint), q.dropped + cast(left_ >= {QUEUE[0]} as bigint)
  from (select *, 0 as z from q) q join e on e.session_id = q.session_id and e.k = q.k + 1, lateral (select greatest(0, q.waiting - (e.tick - q.tick) * {QUEUE[1]}) as left_))
 select session_id, seq, kept, waiting, dropped from q""")
def stream_bounded_queue(s, d):
    return ev.run_now(tm.bounded_queue_stream(event_stream(s, d), *QUEUE), "append")
