"""Streams with timers and bounded queues against their batch forms and a sequential model, however their input is cut."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from sparkloom.sources import writers as wr
from sparkloom.streaming import events as ev, timers as tm

SCHEMA = "session_id string, seq long, ts timestamp, type string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def session_rows(rng, n=80):
    at, out = 0, []
    for k in range(n):
        at += rng.choice([0, 1, 400, 1500, 5200])
        out.append((rng.choice(["a", "b", "c", "d/é"]), k, START + timedelta(milliseconds=at), rng.choice(["node", "edge", "node", "COMPLETE" if rng.random() < 0.3 else "edge"])))
    return out


def in_slices(spark, rows, path, n):
    """Files written one after another, so that a stream reads them in the order of time."""
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("slices", [1, 5])
def test_heartbeats_of_a_stream(spark, tmp_path, slices):
    rows = session_rows(random.Random(slices))
    in_slices(spark, rows, str(tmp_path / "in"), slices)
    got = ev.run_now(tm.heartbeat_stream(ev.read_events(spark, str(tmp_path / "in"), SCHEMA, 1), 1000), "append")
    want = tm.heartbeats(spark.createDataFrame([*rows, (None, 1, START, "node"), ("a", 1, None, "node")], SCHEMA), 1000)
    assert sorted(got.collect()) == sorted(want.collect())
    kinds = [r.kind for r in want.collect()]
    assert kinds.count("heartbeat") > 10 and kinds.count("end") > 2 and kinds.count("event") == len(rows)


def test_an_ended_session_is_silent(spark):
    rows = [("a", 1, START, "COMPLETE"), ("b", 2, START, "node"), ("a", 3, START + timedelta(seconds=5), "node"), ("b", 4, START + timedelta(seconds=6), "node")]
    got = tm.heartbeats(spark.createDataFrame(rows, SCHEMA), 2000)
    assert sorted((r.session_id, r.ms // 1000 - int(START.timestamp())) for r in got.collect() if r.kind == "heartbeat") == [("b", 2), ("b", 4)]


@pytest.mark.parametrize("slices", [1, 4])
def test_bounded_queue_of_a_stream(spark, tmp_path, slices):
    rows = session_rows(random.Random(7), 120)
    in_slices(spark, rows, str(tmp_path / "in"), slices)
    got = ev.run_now(tm.bounded_queue_stream(ev.read_events(spark, str(tmp_path / "in"), SCHEMA, 1), 3, 2, 1000), "append")
    want, queues = [], {}
    for key, seq, ts, _ in rows:
        waiting, tick, dropped = queues.get(key, (0, None, 0))
        now = round(ts.timestamp() * 1000) // 1000
        waiting = max(0, waiting - 2 * (now - (now if tick is None else tick)))
        kept = waiting < 3
        queues[key] = (waiting + kept, now, dropped + (not kept))
        want.append((key, seq, kept, waiting + kept, dropped + (not kept)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(not w[2] for w in want)


def test_a_queue_needs_room(spark):
    with pytest.raises(ValueError):
        tm.bounded_queue_stream(spark.createDataFrame([], SCHEMA), 0, 1, 1)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    write, batch = ev.idempotent(path), spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    write(batch, 0)
    write(batch.where("id = 1"), 1)
    write(batch.where("id = 1"), 1)
    write(batch, 0)
    assert sorted(map(tuple, ev.read_batches(spark, path, batch.schema).collect())) == [(1, "x"), (1, "x"), (2, "y")]
    assert ev.read_batches(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = session_rows(random.Random(3), 40)
    where, to, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = []
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(where)
        seen.append(ev.run_now(ev.read_events(spark, where, SCHEMA), "append", at, to).count())
    assert seen == [20, 40]


@pytest.mark.parametrize("session", ["s:1", "a b", "x=1", "50%", "é/ü", "007", "plain"])
def test_delete_session_of_any_name(spark, tmp_path, session):
    path = str(tmp_path / "nodes")
    rows = spark.createDataFrame([(session, "n1"), (session, "n2"), ("other", "n3")], "session_id string, node_id string")
    wr.upsert(spark, rows, path, ["node_id"])
    assert wr.delete_session(spark, path, session) == 2
    assert [tuple(r) for r in spark.read.parquet(path).select("node_id").collect()] == [("n3",)]
    assert wr.delete_session(spark, path, session) == 0
