"""Analyzer results joined to nodes, findings, and their roll-ups: security summary, CWE and severity counts, metrics, hashes, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import node_id, ordered_digest


def sarif_matches(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_id and matched ('exact', 'line' or null) to results (result_ord, file, line, col, ...).

    Exact (file, line, col): the last node there wins. Else (file, line): the node of the first column. Nodes are reduced to one row per
    place before either join, so both are plain equi joins.
    """
    exact = nodes.groupBy("file", "line", "col").agg(F.max_by("id", "ord").alias("_exact"))
    line = nodes.groupBy("file", "line").agg(F.min_by("id", "ord").alias("_line"))
    j = results.join(exact, ["file", "line", "col"], "left").join(line, ["file", "line"], "left")
    return j.withColumns({"node_id": F.coalesce("_exact", "_line"), "matched": F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_line").isNotNull(), "line")}).drop("_exact", "_line")


def sarif_annotate(results: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """node_id, label, cwe, rule_id: results with a node and their rule's label (default SINK, no CWE); of several, the last result's."""
    m = sarif_matches(results, nodes).where("node_id is not null").join(rules, "rule_id", "left")
    pick = F.max_by(F.struct(F.coalesce("label", F.lit("SINK")).alias("label"), F.coalesce("cwe", F.lit("")).alias("cwe"), "rule_id"), F.col("result_ord")).alias("x")
    return m.groupBy("node_id").agg(pick).select("node_id", "x.*")


def sarif_edges(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """TAINT_SINK self-loops of matched results, and TAINT_SOURCE edges where the related location (rel_file, rel_line, rel_col) has a node."""
    m = sarif_matches(results, nodes).where("node_id is not null")
    related = m.where("rel_line is not null").select("result_ord", F.col("node_id").alias("sink"), F.col("rel_file").alias("file"), F.col("rel_line").alias("line"), F.col("rel_col").alias("col"))
    source = sarif_matches(related, nodes).where("node_id is not null").select(F.col("node_id").alias("src"), F.col("sink").alias("dst"), F.lit("TAINT_SOURCE").alias("edge_type"))
    return m.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("TAINT_SINK").alias("edge_type")).unionByName(source).distinct()


def findings(nodes: DataFrame, cwes: DataFrame, least: float = 0.3) -> DataFrame:
    """SINK and SENSITIVE nodes of some confidence, with what is known of their CWE; severity HIGH for sinks and MEDIUM else where it isn't."""
    # F.round(x, 2) rounds the decimals that a double prints (0.285 to 0.29), SQL engines the double times 100 (28.499999999999996)
    f = nodes.where(F.col("label").isin("SINK", "SENSITIVE") & (F.col("confidence") >= least))
    j = f.join(cwes, "cwe", "left")
    return j.withColumn("severity", F.coalesce("cwe_severity", F.when(F.col("label") == "SINK", "HIGH").otherwise("MEDIUM"))).withColumns({"confidence": F.round(F.col("confidence") * 100) / 100, "title": F.coalesce("cwe_name", F.lit("Unclassified"))}).drop("cwe_name", "cwe_severity")


def findings_order() -> list[Column]:
    """Sinks first, then by falling confidence."""
    return [F.col("label") != "SINK", F.desc("confidence")]


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))), severity), F.lit(0))


def cwe_counts(found: DataFrame, top: int | None = None) -> DataFrame:
    """cwe, n, confidence_avg, most frequent first; top is the report's length."""
    out = found.where("cwe <> ''").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence_avg")).orderBy(F.desc("n"), "cwe")
    return out.limit(top) if top else out


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(f"{s.lower()}_severity") for s in ("HIGH", "MEDIUM", "LOW")), F.count(F.lit(1)).alias("finding_count"))


def detection_metrics(judged: DataFrame, by: str = "cwe") -> DataFrame:
    """Precision, recall, F1 and false-positive rate for each value of ``by`` from boolean truth and predicted; 0 where a denominator is."""
    def count(t: bool, p: bool) -> Column:
        return F.count_if((F.col("truth") == t) & (F.col("predicted") == p))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    c = judged.groupBy(by).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(by, "tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 4).alias("f1"), F.round(ratio(fp, fp + tn), 4).alias("false_positive_rate"))


def density(nodes: Column, edges: Column) -> Column:
    """Edges over n (n - 1) / 2, six digits; 0 for fewer than two nodes."""
    return F.when(nodes > 1, F.round(edges / (nodes * (nodes - 1) / 2), 6)).otherwise(F.lit(0.0))


def hotspots(edges: DataFrame, least: int) -> DataFrame:
    """Nodes by degree, at least so high; degree is summed map-side over both ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def security_summary(nodes: DataFrame) -> DataFrame:
    """For each file the sorted ids by label, joined by commas, its number of distinct CWEs, and the ids of each CWE as ``CWE=id,id;CWE=...``."""
    def ids(label: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.col("node_id")))), ",").alias(label.lower())

    by_label = nodes.groupBy("file_path").agg(*(ids(x) for x in ("SOURCE", "SINK", "SANITIZER", "SENSITIVE")), F.count_distinct(F.when(F.col("cwe") != "", F.col("cwe"))).alias("n_cwes"))
    per_cwe = nodes.where("cwe <> ''").groupBy("file_path", "cwe").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("ids"))
    maps = per_cwe.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "cwe", "ids"))), ";").alias("cwes"))
    return by_label.join(maps, "file_path", "left").fillna("", ["cwes"])


def sarif_nodes(results: DataFrame, rule_cwes: DataFrame) -> DataFrame:
    """One CALL node for each result with a place: node_id, file_path, line, col, node_type, name (the rule), label SINK, confidence 0.95, severity (its level), cwes.

    rule_cwes: rule_id, cwe as ``readers.sarif_rule_cwes`` gives them. Results at one place with one rule are one node; the last result's level stands.
    """
    cwes = rule_cwes.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("cwe")), ",").alias("cwes"))
    at = results.where("file is not null and line is not null").withColumn("node_id", node_id(F.col("file"), F.col("line"), F.col("col"), F.concat(F.lit("CALL:"), "rule_id")))
    one = at.groupBy("node_id", F.col("file").alias("file_path"), "line", "col", "rule_id").agg(F.max_by("level", "result_ord").alias("severity"))
    return one.join(cwes, "rule_id", "left").select("node_id", "file_path", "line", "col", F.lit("CALL").alias("node_type"), F.col("rule_id").alias("name"), F.lit("SINK").alias("label"), F.lit(0.95).alias("confidence"), "severity", F.coalesce("cwes", F.lit("")).alias("cwes"))


def sarif_counts(results: DataFrame, by: str = "tool") -> DataFrame:
    """Results, distinct rules and results by level of each tool."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("results"), F.count_distinct("rule_id").alias("rules"), *(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("error", "warning", "note")))


def session_counts(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, nodes, edges, findings: three partial aggregates in one, 0 where a session has none."""
    tagged = [df.select("session_id", F.lit(name).alias("kind")) for df, name in ((nodes, "nodes"), (edges, "edges"), (found, "findings"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("session_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("nodes", "edges", "findings")))


def backend_counts(results: DataFrame, by: str = "session_id") -> DataFrame:
    """For each session, its files by backend as ``name=n,...``, and its stages' latencies summed as ``stage=ms,...``; both sorted by name."""
    files = results.groupBy(by, "backend").agg(F.count(F.lit(1)).alias("n")).where("backend is not null").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "backend", F.col("n").cast("string")))), ",").alias("backends"))
    stages = results.groupBy(by, "stage").agg(F.sum("latency_ms").cast("long").alias("ms")).where("stage is not null").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", F.col("ms").cast("string")))), ",").alias("latency"))
    return files.join(stages, by, "full")


def confidence_by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence_avg"))


def _streamed_digest(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, hash) of _part, sorted within each group."""
    keys = {f.name: f.dataType for f in parts.schema.fields if f.name in by}

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        key, digest, done = None, None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *k, part in zip(*columns, strict=True):
                if digest is None or k != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest, first = k, hashlib.sha256(), True
                digest.update(part.encode() if first else b"\n" + part.encode())
                first = False
        if digest is not None:
            done.append((*key, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], to_arrow_type(keys[c])) for k, c in enumerate(by)] + [pa.array([r[-1] for r in done], pa.string())], [*by, "hash"])

    schema = ", ".join([*(f"`{c}` {keys[c].simpleString()}" for c in by), "hash string"])
    ordered = parts.where("_part is not null").select(*by, "_part").repartition(*by).sortWithinPartitions(*by, "_part")
    return ordered.mapInArrow(run, schema)


def set_hash(rows: DataFrame, by: list[str], part: Column, digits: int = 0) -> DataFrame:
    """SHA-256 of each group's sorted, newline-joined parts.

    With digits, a digest tree: the parts whose own SHA-256 starts with the same so many hex digits are digested first, then the sorted list
    of those digests, so that no task reads a whole group (3 digits: 4,096 buckets). The two forms give different values. The flat one equals the
    usual manifest hash: a group's parts are sorted by Spark, which spills, and pass one after another through one digest; nothing holds them.
    Null parts are left out, as a list would.
    """
    if not digits:
        return _streamed_digest(rows.select(*by, part.alias("_part")), by)
    p = rows.select(*by, part.alias("_part")).withColumn("_b", F.left(F.sha2("_part", 256), F.lit(digits)))
    return p.groupBy(*by, "_b").agg(ordered_digest(F.collect_list("_part")).alias("_d")).groupBy(*by).agg(ordered_digest(F.collect_list("_d")).alias("hash"))


def graph_hash(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """SHA-256 of the JSON object of a group's sorted edge ids and node ids."""
    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), column, F.lit('"')))), ", ").alias(name))

    j = listed(nodes, "id", "_n").join(listed(edges, "edge_id", "_e"), by, "left")
    return j.select(by, F.sha2(F.concat(F.lit('{"edges": ['), F.coalesce("_e", F.lit("")), F.lit('], "nodes": ['), "_n", F.lit("]}")), 256).alias("graph_hash"))


def build_rollup(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files, processed, skipped, errors, nodes, sorted languages, from files (file_path, language, status)."""
    f = files.agg(F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "error")), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "processed", F.col("language")))), ",").alias("languages"))
    return f.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("nodes"))))  # one row each


def primary_language(files: DataFrame, ignored=("unknown", "yaml", "terraform"), seen: str | None = None) -> DataFrame:
    """The most frequent language; of equals the one seen first, by the column ``seen``, or else the first by name. Without one, python."""
    known = files.where(~F.col("language").isin(list(ignored)))
    c = known.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min(seen if seen else "language").alias("_first"))
    best = c.agg(F.min_by(F.struct("language", "n"), F.struct(-F.col("n"), F.col("_first"), F.col("language"))).alias("b"))
    return best.select(F.coalesce("b.language", F.lit("python")).alias("language"), F.coalesce("b.n", F.lit(0)).alias("n"))


def review_state(sessions: DataFrame, decisions: DataFrame, auto_approve: bool = False) -> DataFrame:
    """session_id, state: not_reached, waiting, approved or rejected, by the latest decision (session_id, seq, approved)."""
    last = decisions.groupBy("session_id").agg(F.max_by("approved", "seq").alias("approved"))
    state = F.when(~F.col("reached"), "not_reached").when(F.col("approved").isNotNull(), F.when(F.col("approved"), "approved").otherwise("rejected")).otherwise("approved" if auto_approve else "waiting")
    return sessions.join(last, "session_id", "left").select("session_id", state.alias("state"))


def review_summary(found: DataFrame, by: str, preview: int = 5) -> DataFrame:
    """For each session counts by severity and the ids of its first findings (sinks first, then confidence)."""
    w = Window.partitionBy(by).orderBy(*findings_order(), "node_id")
    counts = found.groupBy(by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")))
    first = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= preview).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node_id"))), lambda x: x["node_id"]).alias("p"))
    return counts.join(first, by).select(*counts.columns, F.array_join("p", ",").alias("preview"))


def throughput(rows: DataFrame, by: str, time: str = "ts") -> DataFrame:
    """by, n, seconds, per_second: rows over the time between a group's first and last, six digits; 0 where no time passes."""
    micros = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (micros / 1e6).alias("seconds"))
    return g.select(by, "n", "seconds", F.when(F.col("seconds") > 0, F.round(F.col("n") / F.col("seconds"), 6)).otherwise(F.lit(0.0)).alias("per_second"))


def cross_session(states: DataFrame, counted: tuple[str, ...]) -> DataFrame:
    """One row over all sessions (session_id, state, and the counted columns): sessions, their number by state as ``state=n,...`` sorted by name, and each count's sum and largest."""
    by = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in counted), *(F.max(c).alias(f"max_{c}") for c in counted))
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "state", F.col("n").cast("string")))), ",")  # a row for each state
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), named.alias("states"), *(F.coalesce(F.sum(f"sum_{c}"), F.lit(0)).alias(f"sum_{c}") for c in counted), *(F.max(f"max_{c}").alias(f"max_{c}") for c in counted))


def serialised(nodes: DataFrame, cwes: DataFrame, advice: DataFrame | None = None, least: float = 0.3) -> DataFrame:
    """Findings as they are handed out: node_id, file_path, line, cwe, title, severity, confidence, text (400 characters at most), description, remediation.

    advice: language, cwe, description, remediation, as ``readers.catalog`` reads them; of several rows of one language and CWE the least texts. Without any they are empty.
    """
    f = findings(nodes, cwes, least).withColumn("text", F.left(F.coalesce("raw_text", F.lit("")), F.lit(400)))
    words = ["description", "remediation"]
    if advice is not None:
        f = f.join(advice.groupBy("language", "cwe").agg(*(F.min(w).alias(w) for w in words)), ["language", "cwe"], "left")
    texts = [F.coalesce(w, F.lit("")).alias(w) if advice is not None else F.lit("").alias(w) for w in words]
    return f.select("node_id", "file_path", "line", "cwe", "title", "severity", "confidence", "text", *texts)
