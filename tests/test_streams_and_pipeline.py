import json

from sparkloom.plans.pipeline import analyse
from sparkloom.streaming import events as ev

SCHEMA = "session_id long, seq long, type string, payload string"


def rows(spark):
    return spark.createDataFrame([(1, 1, "PARSE", None), (1, 2, "node", None), (1, 3, "node", None), (1, 4, "CFG", None), (1, 5, "COMPLETE", json.dumps({"node": 2, "edge": 0, "finding": 0})), (2, 1, "CFG", None), (2, 2, "PARSE", None), (2, 3, "COMPLETE", json.dumps({"node": 1})), (2, 4, "node", None)], SCHEMA)


def test_protocol(spark):
    assert {(r.session_id, r.seq, r.rule) for r in ev.protocol_violations(rows(spark)).collect()} == {(2, 1, "starts_late"), (2, 2, "out_of_order"), (2, 4, "after_complete")}
    assert {r.session_id: r.ok for r in ev.complete_counts(rows(spark)).collect()} == {1: True, 2: False}


def test_stream_equals_batch(spark, tmp_path):
    rows(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = sorted(ev.status_rollup(rows(spark)).collect())
    stream = ev.run_now(ev.status_rollup(ev.read_events(spark, str(tmp_path / "in"), SCHEMA, 1)))
    assert sorted(stream.collect()) == batch


def test_changes_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (1, 4, "b"), (1, 5, "a")], "session_id long, seq long, type string")
    df.repartition(3, "seq").sortWithinPartitions("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = ev.run_now(ev.changed_stream(ev.read_events(spark, str(tmp_path / "in"), "session_id long, seq long, type string"), "session_id", "seq", "type"), "append")
    assert sorted(got.collect()) == sorted(ev.changed(df, "type").collect())


def test_fan_out_drops_dead_clients(spark, tmp_path):
    rows(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []

    def dead(batch, number):
        raise OSError("gone")

    clients = {"dead": dead, "live": lambda batch, number: seen.append(batch.count())}
    q = ev.fan_out(ev.read_events(spark, str(tmp_path / "in"), SCHEMA, 1), clients, str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 9 and list(clients) == ["live"]


def test_pipeline(spark):
    files = spark.createDataFrame([("a.py", "import os\nx = input()\nos.system(x)\n"), ("big.py", "y" * 100)], "file_path string, text string")
    a = analyse(files, "s1", max_bytes=60)
    assert {r.file_path: r.status for r in a.files.collect()} == {"a.py": "PASSED", "big.py": "REJECTED"}
    nodes = a.nodes.collect()
    assert len({n.node_id for n in nodes}) == len(nodes)
    assert {(n.node_type, n.label) for n in nodes} >= {("CALL", "SOURCE"), ("CALL", "SINK"), ("PROGRAM", "NONE")}
    ids = {n.node_id for n in nodes}
    assert all(e.src in ids and e.dst in ids for e in a.edges.collect())
    assert [f.severity for f in a.findings.collect()]
    assert [r.stage for r in a.stage_results().orderBy("ord").collect()][0] == "validate"
