"""What is shown and decided around a session: viewer records, tool and environment policy, scopes, stage results, remaining joins of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import darken, first_match
from .graph import containing

# Colours of labels and edges.
LABEL_COLOURS = {"SOURCE": "#3b82f6", "SINK": "#ef4444", "SANITIZER": "#22c55e", "SENSITIVE": "#f59e0b", "PROPAGATOR": "#8b5cf6", "NONE": "#6b7280"}
EDGE_COLOURS = {
    "AST_CHILD": "#d1d5db", "CFG_NEXT": "#60a5fa", "CFG_TRUE": "#34d399", "CFG_FALSE": "#f87171", "CFG_LOOP": "#a78bfa", "DFG_FLOW": "#fb923c", "DFG_DEPENDS": "#fbbf24", "DFG_KILLS": "#e879f9",
    "CALLS": "#94a3b8", "TAINT_SOURCE": "#2563eb", "TAINT_SINK": "#dc2626", "SANITIZER_EDGE": "#16a34a",
}
# Token prefixes, environment keys that may be added.
TOKEN_TYPES = [("ghp_", "classic_pat"), ("github_pat_", "fine_grained_pat"), ("ghs_", "github_app"), ("gho_", "oauth")]
ENVIRONMENT_KEYS = ["JAVA_HOME", "JAVA_OPTS", "CODEQL_JAVA_HOME", "DOTNET_ROOT", "GOROOT", "GOPATH"]
# Other names of catalog languages; unknown ones count as python.
LANGUAGE_ALIASES = {"ts": "javascript", "typescript": "javascript", "tsx": "javascript", "js": "javascript", "hcl": "terraform", "tf": "terraform", "py": "python"}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def viewer_node(node_type: Column, label: Column, name: Column, file: Column, line: Column, raw: Column) -> Column:
    """Struct label, title, colour, border, shape, size, text of a drawn node."""
    short, colour = F.left(F.coalesce(name, F.lit("")), F.lit(20)), _lookup(LABEL_COLOURS, label, "#6b7280")
    plain = label == "NONE"
    return F.struct(
        F.when(short != "", F.concat(short, F.lit("\n("), node_type, F.lit(")"))).otherwise(node_type).alias("label"), F.concat_ws(":", file, line.cast("string")).alias("title"), colour.alias("colour"), darken(colour).alias("border"),
        F.when(plain, "dot").otherwise("diamond").alias("shape"), F.when(plain, 8).otherwise(14).alias("size"), F.left(F.coalesce(raw, F.lit("")), F.lit(300)).alias("text"),
    )


def viewer_edge(edge_type: Column) -> Column:
    """Struct colour, width, dashes of a drawn edge."""
    return F.struct(_lookup(EDGE_COLOURS, edge_type, "#94a3b8").alias("colour"), F.when(edge_type.contains("DFG") | edge_type.contains("TAINT"), 2).otherwise(1).alias("width"), edge_type.contains("CFG").alias("dashes"))


def token_type(token: Column) -> Column:
    return first_match(*((token.startswith(p), t) for p, t in TOKEN_TYPES), otherwise="unknown")


def catalog_language(language: Column, known=("python", "java", "javascript", "go", "terraform")) -> Column:
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair)), F.lower(language)), F.lower(language))
    return F.when(named.isin(list(known)), named).otherwise("python")


def environment_allowed(key: Column, value: Column) -> Column:
    """Only known keys, and no line breaks or NUL in values."""
    return key.isin(ENVIRONMENT_KEYS) & ~value.rlike(r"[\n\r\x00]")


def scopes_suffice(required: Column, granted: Column) -> Column:
    return F.size(F.array_except(required, granted)) == 0


def rate_limit(headers: Column) -> Column:
    """Struct limit, remaining, reset of a header map (lower-case names), null where not a number."""
    def number(name: str) -> Column:
        return F.try_to_number(F.try_element_at(headers, F.lit(name)), F.lit("999999999999")).cast("long")

    return F.struct(*(number(f"x-ratelimit-{k}").alias(k) for k in ("limit", "remaining", "reset")))


def tools_ready(tools: DataFrame, by: str) -> DataFrame:
    """For each group: whether all required tools are available, and the names of those that aren't."""
    failing = F.col("required") & ~F.col("available")
    return tools.groupBy(by).agg(F.bool_and(~failing).alias("ready"), F.array_join(F.array_sort(F.collect_set(F.when(failing, F.col("name")))), ",").alias("failing"))


def submodule_counts(entries: DataFrame, by: str = "root") -> DataFrame:
    """Submodules by status, and whether any was not resolved."""
    names = ("resolved", "unpinned", "rejected", "circular", "too_deep", "over_limit")
    return entries.groupBy(by).agg(*(F.count_if(F.col("status") == n).alias(n) for n in names), (F.count_if(F.col("status") != "resolved") > 0).alias("blind_spot"))


def last_stage(results: DataFrame, by: str = "session_id") -> DataFrame:
    """Each session's latest stage and status, and its stages' latencies summed."""
    return results.groupBy(by).agg(F.max_by("stage", "ord").alias("stage"), F.max_by("status", "ord").alias("status"), F.sum("latency_ms").alias("latency_ms"))


def children(nodes: DataFrame) -> DataFrame:
    """parent, child by children_ids: exploded and joined with the nodes that exist."""
    links = nodes.select(F.col("id").alias("parent"), F.explode("children_ids").alias("child"))
    return links.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")


def unsanitized(hits: DataFrame, sanitizers: DataFrame, on: list[str]) -> DataFrame:
    """Pattern hits without a sanitizer in the same place, and not seen before: an anti join."""
    return hits.join(sanitizers.select(*on).distinct(), on, "left_anti")


def conditional_branches(nodes: DataFrame) -> DataFrame:
    """CFG_TRUE and CFG_FALSE from a declarative conditional to the first two nodes inside its lines, if there are two."""
    # the lines after the first one, as far as there are any
    c = nodes.where("t = 'CONDITIONAL' and end_line > line").select("file", F.col("id").alias("src"), (F.col("line") + 1).alias("a"), F.col("end_line").alias("b"))
    inside = containing(c, nodes.select("file", F.col("id").alias("dst"), "line", F.col("line").alias("stop"), "ord"))
    ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy("file", "src").orderBy("ord"))).where("rn <= 2")
    pairs = ranked.groupBy("file", "src").agg(F.max("rn").alias("n"), F.min_by("dst", "rn").alias("yes"), F.max_by("dst", "rn").alias("no")).where("n = 2")
    return pairs.select("file", "src", F.explode(F.array(F.struct(F.col("yes").alias("dst"), F.lit("CFG_TRUE").alias("edge_type")), F.struct(F.col("no").alias("dst"), F.lit("CFG_FALSE").alias("edge_type")))).alias("e")).select("file", "src", "e.*")


def pinned(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries (path, ...) with the commit that the tree pins for their path; without one they are skipped."""
    return entries.join(links.select("path", F.col("sha").alias("pinned_sha")), "path", "left").withColumn("status", F.when(F.col("pinned_sha").isNull(), "skipped").otherwise("pinned"))
