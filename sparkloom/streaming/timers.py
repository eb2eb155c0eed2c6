"""Keyed state with timers: heartbeats after silence, end events, and queues of bounded capacity that drop when full.

State is a few numbers for each session, in RocksDB; nothing is collected for a key. Every row that comes out carries the event time at
which it was due, not the batch in which it was found, so a stream gives the rows of its batch form however its input is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shipping import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Heartbeats(StatefulProcessor):
    """A session's events, a heartbeat after each whole period without one, and an end behind an event of type ``end``, which silences the session."""

    def __init__(self, key: str, period_ms: int, end: str):
        self.key, self.period, self.end = key, period_ms, end

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("silence", "at long, beats long")

    def _row(self, key, ms: int, kind: str) -> Row:
        return Row(**{self.key: key[0], "ms": ms, "kind": kind})

    def _wait(self, at: int | None, beats: int) -> None:
        """Keep the last event's time and register the next beat; a session that has ended leaves nothing."""
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if at is None:
            self.state.clear()
        else:
            self.state.update((at, beats))
            self.handle.registerTimer(at + (beats + 1) * self.period)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, beats = self.state.get() if self.state.exists() else (None, 0)
        for ms, _, kind in sorted((r["ms"], r["seq"], r["type"]) for r in rows):
            while at is not None and at + (beats + 1) * self.period < ms:
                beats += 1
                yield self._row(key, at + beats * self.period, "heartbeat")
            yield self._row(key, ms, "event")
            at, beats = ms, 0
            if kind == self.end:
                yield self._row(key, ms, "end")
                at = None
        self._wait(at, beats)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        at, beats = self.state.get()
        now = timerValues.getCurrentWatermarkInMs()
        while at + (beats + 1) * self.period <= now:
            beats += 1
            yield self._row(key, at + beats * self.period, "heartbeat")
        self._wait(at, beats)

    def close(self) -> None:
        pass


class BoundedQueue(StatefulProcessor):
    """A queue for each session: an event enters unless ``capacity`` are waiting; ``per_tick`` of them leave at each multiple of ``tick_ms``."""

    def __init__(self, key: str, capacity: int, per_tick: int, tick_ms: int):
        self.key, self.capacity, self.per_tick, self.tick = key, capacity, per_tick, tick_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("queue", "waiting long, tick long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, tick, dropped = self.state.get() if self.state.exists() else (0, None, 0)
        for ms, seq in sorted((r["ms"], r["seq"]) for r in rows):
            now = ms // self.tick
            if tick is not None and now > tick:
                waiting = max(0, waiting - (now - tick) * self.per_tick)
            tick = now if tick is None else max(tick, now)
            kept = waiting < self.capacity
            waiting, dropped = waiting + kept, dropped + (not kept)
            yield Row(**{self.key: key[0], "seq": seq, "kept": kept, "waiting": waiting, "dropped": dropped})
        if tick is not None:
            self.state.update((waiting, tick, dropped))

    def close(self) -> None:
        pass


def _schema(stream: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {dict(stream.dtypes)[key]}, {rest}"


def heartbeat_stream(stream: DataFrame, period_ms: int, end: str = "COMPLETE", key: str = "session_id", delay: str = "0 seconds") -> DataFrame:
    """key, ms, kind ('event', 'heartbeat', 'end') of a stream with key, seq, ts (timestamp) and type; see ``heartbeats``.

    Events up to ``delay`` late are put in order with those of their batch; later ones are dropped by the watermark. Beats come when the
    watermark passes them. Rows without a key or time are dropped.
    """
    ship(stream.sparkSession).conf.set(STORE, ROCKS)
    timed = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay).select(key, "seq", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("type", F.lit("")).alias("type"))
    return timed.groupBy(key).transformWithState(Heartbeats(key, period_ms, end), _schema(stream, key, "ms long, kind string"), "Append", "EventTime")


def heartbeats(events: DataFrame, period_ms: int, end: str = "COMPLETE", key: str = "session_id") -> DataFrame:
    """The batch form of ``heartbeat_stream``: key, ms, kind; sessions that have not ended beat until the table's last event. A window over a session."""
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "seq", F.unix_millis("ts").alias("ms"), F.coalesce("type", F.lit("")).alias("type"))
    until = e.agg(F.max("ms").alias("until"))
    w = Window.partitionBy(key).orderBy("ms", "seq", "type")
    e = e.withColumn("next", F.lead("ms").over(w)).crossJoin(F.broadcast(until))  # one row
    silent = F.when(F.col("type") == end, F.lit(0)).otherwise(F.coalesce(F.col("next") - 1, F.col("until")) - F.col("ms"))
    beats = e.withColumn("n", F.floor(silent / period_ms).cast("int")).where("n > 0").select(key, "ms", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select(key, (F.col("ms") + F.col("k") * period_ms).alias("ms"), F.lit("heartbeat").alias("kind"))
    return e.select(key, "ms", F.lit("event").alias("kind")).unionByName(beats).unionByName(e.where(F.col("type") == end).select(key, "ms", F.lit("end").alias("kind")))


def bounded_queue_stream(stream: DataFrame, capacity: int, per_tick: int, tick_ms: int, key: str = "session_id") -> DataFrame:
    """key, seq, kept, waiting, dropped of each event of a stream with key, seq and ts: whether its session's queue had room, how many wait behind it,
    how many were dropped so far. Events of a batch are taken in the order of (ts, seq); rows without a key or time are dropped."""
    if capacity < 1 or per_tick < 0 or tick_ms < 1:
        raise ValueError("a queue has room for one event at least, and time goes forward")
    ship(stream.sparkSession).conf.set(STORE, ROCKS)
    timed = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("seq").cast("long").alias("seq"), F.unix_millis("ts").alias("ms"))
    return timed.groupBy(key).transformWithState(BoundedQueue(key, capacity, per_tick, tick_ms), _schema(stream, key, "seq long, kept boolean, waiting long, dropped long"), "Append", "None")
