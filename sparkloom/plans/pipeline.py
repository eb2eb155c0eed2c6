"""The analysis pipeline over files: one function for each stage, lazily composed; errors and degraded files are rows, never exceptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..functions.text import sanitize_for_model
from ..operators import annotate as an, findings as fi, graph as gr, nodes as no, validate as va


@dataclass
class Analysis:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    stages: list[tuple[str, str]] = field(default_factory=list)

    def stage_results(self) -> DataFrame:
        spark = self.files.sparkSession
        return spark.createDataFrame([(k, name, status) for k, (name, status) in enumerate(self.stages)], "ord int, stage string, status string")


def analyse(files: DataFrame, session_id: str, registry: DataFrame | None = None, sarif: DataFrame | None = None, max_bytes: int = 5 << 20) -> Analysis:
    """files (file_path, text) through validation, language, nodes, annotation, control and data flow, containment, findings.

    A rejected file gives one PROGRAM node, and its reasons in the column error of files. sarif: results as ``readers.sarif_results`` gives them; their labels come
    before the annotator's.
    """
    spark = files.sparkSession
    language, confidence, method = no.detect_language(F.col("file_path"), F.col("text"))
    checked = va.validate(files.withColumns({"language": language, "lang_confidence": confidence, "lang_method": method}), max_bytes=max_bytes)
    checked = checked.withColumn("backend", no.route_backend(F.col("language"), ["fallback"]))
    good = checked.where("status <> 'REJECTED'")
    found = no.fallback_nodes(good, text="sanitized").join(good.select("file_path", "language"), "file_path")
    degraded = checked.where("status = 'REJECTED'").select("file_path", F.lit(1).alias("line"), F.lit(0).alias("ord"), F.lit("PROGRAM").alias("node_type"), F.lit(0).alias("col"), F.lit(0).alias("end_col"), F.lit("rejected").alias("raw_text"), F.lit("").alias("node_id"), "language")
    every = found.unionByName(degraded).withColumn("name", no.extract_name(F.col("node_type"), F.col("raw_text")))
    labelled = an.annotate(every, registry if registry is not None else dims.frame(spark, "registry"))
    if sarif is not None:
        places = labelled.select(F.col("file_path").alias("file"), "line", "col", F.col("node_id").alias("id"), "ord")
        marks = fi.sarif_annotate(sarif, places, dims.frame(spark, "sarif_rules")).select("node_id", F.col("label").alias("_l"), F.col("cwe").alias("_c"))
        labelled = labelled.join(marks, "node_id", "left").withColumns({"label": F.coalesce("_l", "label"), "cwe": F.coalesce("_c", "cwe"), "confidence": F.when(F.col("_l").isNotNull(), 0.95).otherwise(F.col("confidence"))}).drop("_l", "_c")
    labelled = labelled.withColumn("normalized_text", sanitize_for_model(F.col("raw_text")))
    flow = labelled.select(F.col("file_path").alias("file"), F.col("node_id").alias("id"), F.col("node_type").alias("t"), "line", "col", "ord", F.col("line").alias("end_line"), F.lit("").alias("fn"), "name", F.lit(None).cast("string").alias("parent_id"))
    edges = gr.cfg(flow).drop("edge_id")
    for part in (gr.dfg_flows, gr.dfg_kills, gr.dfg_returns, gr.dfg_depends, gr.ast_edges):
        edges = edges.unionByName(part(flow))
    result = fi.findings(labelled, dims.frame(spark, "cwes"))
    lit = F.lit(session_id)
    stages = [(s, "ok") for s in ("validate", "language", "nodes", "annotate", "flow", "findings")] + ([("sarif", "ok")] if sarif is not None else [("sarif", "skipped")])
    error = F.when(F.col("status") == "REJECTED", F.concat_ws(",", "warnings"))
    return Analysis(checked.withColumns({"session_id": lit, "error": error}), labelled.withColumn("session_id", lit), edges.withColumn("session_id", lit), result.withColumn("session_id", lit), stages)
