"""Stages with conditions and failures: what goes wrong with a file becomes a row, what goes wrong with a stage routes the rest.

* ``guarded`` runs a function on each file where the file is; an exception gives a failure row (stage, file_path, error, message) instead of
  the file's rows, and no other file notices.
* ``run_stages`` takes stages in order over a state of named tables. A stage has a condition (else it is skipped), may name the stage that
  stands in for it when it fails, and otherwise ends the run at the ``failed`` node. Each stage's tables are written, so its
  errors show in it and not in a later one, and every run leaves a table of results: ord, stage, status, rows, error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..scratch import Scratch
from ..shipping import ship

State = dict[str, DataFrame]
#: Files that failed, for whatever reads them next.
FAILURES = "stage string, file_path string, error string, message string"


@dataclass
class Stage:
    """run: state to the tables that it makes. when: whether it is due. instead: the stage that runs if this one fails."""

    name: str
    run: Callable[[State], State]
    when: Callable[[State], bool] | None = None
    instead: Stage | None = None


@dataclass
class Outcome:
    state: State
    results: list[tuple[int, str, str, int, str]] = field(default_factory=list)
    failed: bool = False

    def stage_results(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.results, "ord int, stage string, status string, rows long, error string")


def run_stages(spark: SparkSession, stages: Iterable[Stage], state: State, session: str = "session") -> Outcome:
    """Runs the stages that are due, in order. Statuses: ok, skipped, failed; a stand-in has a row of its own behind the stage that failed."""
    out, scratch, todo = Outcome(dict(state)), Scratch(spark, "stages"), list(stages)[::-1]
    while todo:
        stage, at = todo.pop(), len(out.results)
        try:
            if stage.when is not None and not stage.when(out.state):
                out.results.append((at, stage.name, "skipped", 0, ""))
                continue
            made = {k: scratch.put(v, f"{len(out.results)}{k}") for k, v in stage.run(out.state).items()}
            out.state |= made
            out.results.append((at, stage.name, "ok", sum(v.count() for v in made.values()), ""))
        except Exception as e:  # noqa: BLE001  whatever it is, it is a row
            out.results.append((at, stage.name, "failed", 0, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]))
            if stage.instead is None:
                out.failed = True
                out.results += [(len(out.results) + k, s.name, "skipped", 0, f"after {stage.name}") for k, s in enumerate(todo[::-1])]
                break
            todo.append(stage.instead)
    return out


def guarded(files: DataFrame, stage: str, one: Callable[[str, str], Iterable[tuple]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of ``one(file_path, text)`` over files (file_path, text): its rows with file_path first, by schema; one row for each file that raised.

    Both are written once, so a file is not run twice. A null text is empty. Rows that don't fit the schema are the file's failure too.
    """
    kind: StructType = _parse_datatype_string(schema)
    names = [f.name for f in kind.fields]
    both = f"file_path string, row struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in kind.fields)}>, error string, message string"

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        inner = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in kind.fields])
        for batch in batches:
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = pa.array([dict(zip(names, r, strict=True)) for r in one(where, text or "")], inner)
                    n, error, message = len(rows), None, None
                except Exception as e:  # noqa: BLE001
                    rows, n, error, message = pa.nulls(1, inner), 1, type(e).__name__, str(e)[:1000]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([where] * n, pa.string()), rows, pa.array([error] * n, pa.string()), pa.array([message] * n, pa.string())], ["file_path", "row", "error", "message"])

    spark = ship(files.sparkSession)
    done = Scratch(spark, "guarded").put(files.select(F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, both), stage)
    failures = done.where("error is not null").select(F.lit(stage).alias("stage"), "file_path", "error", "message")
    return done.where("error is null").select("file_path", "row.*"), failures


def degraded(files: DataFrame, failures: DataFrame, attribute: str = "error") -> DataFrame:
    """One PROGRAM node (file_path, node_type, line, attributes) for each file that failed: the graph keeps the file."""
    reason = failures.groupBy("file_path").agg(F.min(F.concat_ws(": ", "error", "message")).alias("reason"))
    return files.join(reason, "file_path").select("file_path", F.lit("PROGRAM").alias("node_type"), F.lit(1).alias("line"), F.to_json(F.create_map(F.lit(attribute), F.col("reason"))).alias("attributes"))
