"""Session event streams: running status, protocol checks, change detection; each as a batch operator and on a stream.

Events: session_id, seq, ts, type, payload. The batch forms are the streams' specification: a stream with trigger availableNow gives the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import dims
from ..scratch import Scratch

COUNTED = ("node", "edge", "finding")


def status_rollup(events: DataFrame, types: tuple[str, ...] = COUNTED, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Counts by type and the latest event type of each session; one partial aggregate, also valid on a stream (update or complete mode)."""
    return events.groupBy(key).agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types), F.max_by("type", order).alias("latest"), F.count(F.lit(1)).alias("n_events"))


def changed(events: DataFrame, value: str, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Events whose value differs from the one before in their session: what a metrics stream emits."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def protocol_violations(events: DataFrame, phases: list[str] = dims.PHASES, key: str = "session_id", order: str = "seq") -> DataFrame:
    """session, seq, rule: phases out of order, a first event that isn't the first phase, something after the last phase."""
    place = F.array_position(F.array(*map(F.lit, phases)), F.col("type"))
    w = Window.partitionBy(key).orderBy(order)
    e = events.withColumn("p", place).withColumn("n", F.row_number().over(w))
    e = e.withColumn("high", F.max("p").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("done", F.max((F.col("type") == phases[-1]).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rule = F.when((F.col("n") == 1) & (F.col("p") != 1), "starts_late").when(F.col("done") == 1, "after_complete").when((F.col("p") > 0) & (F.col("p") < F.col("high")), "out_of_order")
    return e.withColumn("rule", rule).where("rule is not null").select(key, order, "rule")


def complete_counts(events: DataFrame, types: tuple[str, ...] = COUNTED) -> DataFrame:
    """session_id, ok: whether the counts that the COMPLETE event's payload claims equal those emitted."""
    claimed = F.from_json(F.max(F.when(F.col("type") == "COMPLETE", F.col("payload"))), "map<string,bigint>")
    c = events.groupBy("session_id").agg(claimed.alias("claimed"), *(F.count_if(F.col("type") == t).alias(t) for t in types))
    ok: Column = F.lit(True)
    for t in types:
        ok = ok & (F.coalesce(F.try_element_at("claimed", F.lit(t)), F.lit(-1)) == F.col(t))
    return c.select("session_id", ok.alias("ok"))


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def idempotent(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that a replayed batch changes nothing in: each batch owns the folder of its number and overwrites it.

    In complete mode one folder holds the latest batch. Batches are counted by the stream's checkpoint, so a path belongs to one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    return write


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What an idempotent sink holds; an empty table before its first batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def run_now(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Drain what is there into a table in the shared folder and return it: the final flush of a session. The latest batch stands (complete mode) or all (append).

    With a checkpoint and a path of its own a later call goes on where the last one stopped, and a batch that failed midway is written anew.
    """
    scratch = Scratch(stream.sparkSession, "drain")
    table = path or f"{scratch.root}/table"
    w = stream.writeStream.foreachBatch(idempotent(table, mode)).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{scratch.root}/checkpoint")
    w.start().awaitTermination()
    return read_batches(stream.sparkSession, table, stream.schema)


def fan_out(stream: DataFrame, clients: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch, persisted once, to every client; a client that raises is dropped, the others go on."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name in list(clients):
            try:
                clients[name](batch, number)
            except Exception:  # noqa: BLE001  a dead client must not stop the stream
                del clients[name]
        batch.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_stream(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, value of events whose value differs from the last one kept in the key's state; events of a micro-batch in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"

    def step(k, frames, state):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = rows[value].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        new = ~((rows[value] == before) | (rows[value].isna() & before.isna()))
        new.iloc[0] = new.iloc[0] or not state.exists
        last = rows[value].iloc[-1]
        state.update((None if pd.isna(last) else last,))
        yield rows.loc[new, [key, order, value]]

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def merged(logs: DataFrame, graph: DataFrame, metrics: DataFrame, states: DataFrame) -> DataFrame:
    """session_id, seq, channel, payload of a session's channels as one stream: all log and graph events, metrics and review states where they change.

    Each input has session_id, seq, payload. The order in a session is (seq, channel). As a stream, ``changed_stream`` takes the place of ``changed``.
    """
    def channel(df: DataFrame, name: str) -> DataFrame:
        return df.select("session_id", "seq", F.lit(name).alias("channel"), "payload")

    return channel(logs, "log").unionByName(channel(graph, "graph")).unionByName(channel(changed(metrics, "payload"), "metrics")).unionByName(channel(changed(states, "payload"), "state"))


def with_heartbeats(events: DataFrame, period: float, key: str = "session_id", time: str = "ts", end: str = "COMPLETE") -> DataFrame:
    """The events with kind 'event', a 'heartbeat' after each whole period in which a session is silent, and one 'end' after its last event of type end.

    Silence is the gap to the session's next event; its heartbeats are exploded from that gap, so an event knows its successor only.
    """
    w = Window.partitionBy(key).orderBy(time)
    beats = F.floor((F.lead(time).over(w) - F.col(time) - F.lit(1e-9)) / period).cast("int")
    e = events.withColumn("_beats", F.greatest(F.coalesce(beats, F.lit(0)), F.lit(0)))
    silent = e.where("_beats > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_beats")))).select(key, (F.col(time) + F.col("_k") * period).alias(time), F.lit("heartbeat").alias("kind"))
    ends = events.where(F.col("type") == end).groupBy(key).agg(F.max(time).alias(time)).select(key, time, F.lit("end").alias("kind"))
    return events.select(key, time, F.lit("event").alias("kind")).unionByName(silent).unionByName(ends)


#: Payload fields of each kind of session event.
EVENT_FIELDS = {
    "phase": ("name", "message"), "node": ("node_id", "node_type", "line"), "edge": ("src", "dst", "edge_type"), "finding": ("node_id", "cwe", "severity"), "log": ("level", "message"), "COMPLETE": ("node", "edge", "finding"), "error": ("stage", "message"),
}


def event(kind: str, session: Column, seq: Column, **payload: Column) -> Column:
    """A session event as a struct (session_id, seq, type, payload): the kind's fields as JSON, those not given left out. Unknown kinds and fields raise."""
    unknown = set(payload) - set(EVENT_FIELDS[kind]) if kind in EVENT_FIELDS else {kind}
    if unknown:
        raise ValueError(f"no such event or field: {sorted(unknown)}")
    given = [payload[f].alias(f) for f in EVENT_FIELDS[kind] if f in payload]
    return F.struct(session.alias("session_id"), seq.alias("seq"), F.lit(kind).alias("type"), (F.to_json(F.struct(*given)) if given else F.lit("{}")).alias("payload"))


def replay(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """A session's results told again as events, in order: its nodes, its edges, its findings, and a COMPLETE event that claims their numbers.

    nodes: session_id, id, t, line. edges: session_id, src, dst, edge_type. findings: session_id, id, cwe, severity. A window over a session numbers them.
    """
    s, none = F.col("session_id"), F.lit(None).cast("long")
    parts = [
        nodes.select(F.lit(1).alias("part"), F.concat_ws(":", F.lpad(F.col("line").cast("string"), 12, "0"), "id").alias("place"), event("node", s, none, node_id=F.col("id"), node_type=F.col("t"), line=F.col("line")).alias("e")),
        edges.select(F.lit(2).alias("part"), F.concat_ws(":", "src", "dst", "edge_type").alias("place"), event("edge", s, none, src=F.col("src"), dst=F.col("dst"), edge_type=F.col("edge_type")).alias("e")),
        findings.select(F.lit(3).alias("part"), F.col("id").alias("place"), event("finding", s, none, node_id=F.col("id"), cwe=F.col("cwe"), severity=F.col("severity")).alias("e")),
    ]
    told = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "place", "e.session_id", "e.type", "e.payload")
    counts = told.groupBy("session_id").agg(*(F.count_if(F.col("type") == t).alias(t) for t in COUNTED))
    done = counts.select(F.lit(4).alias("part"), F.lit("").alias("place"), event("COMPLETE", s, none, **{t: F.col(t) for t in COUNTED}).alias("e")).select("part", "place", "e.session_id", "e.type", "e.payload")
    w = Window.partitionBy("session_id").orderBy("part", "place", "payload")
    return told.unionByName(done).withColumn("seq", F.row_number().over(w).cast("long")).select("session_id", "seq", "type", "payload")
