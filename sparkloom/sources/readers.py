"""Sources: repositories as binary files, exported graphs, analyzer reports, configuration texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dims
from .writers import bucket

SARIF_SCHEMA = """struct<runs:array<struct<
 tool:struct<driver:struct<name:string,rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,
 results:array<struct<ruleId:string,level:string,message:struct<text:string>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>,
  relatedLocations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>>"""


def repository(spark: SparkSession, path: str, skipped=dims.SKIPPED_DIRS, max_bytes: int | None = None, pattern: str | None = None, ends: list[str] | None = None) -> DataFrame:
    """path, modificationTime, length, content of a tree's files without skipped directories and endings; length filters reach the reader.

    The graph layer's walk by default; the parser layer's has ``dims.PARSER_SKIPPED_DIRS`` and ``dims.PARSER_SKIPPED_ENDS``.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (r.option("pathGlobFilter", pattern) if pattern else r).load(path)
    df = df.where(walked(F.col("path"), skipped, ends))
    return df.where(F.col("length") <= max_bytes) if max_bytes else df


def walked(path: Column, skipped: list[str], ends: list[str] | None = None) -> Column:
    """Whether a walk yields a path: none of its parts is a skipped directory, and its name has none of the endings."""
    out = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skipped)))
    for end in ends or ():
        out = out & ~path.endswith(end)
    return out


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 text, malformed ones as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def relative_path(path: Column, root: str) -> Column:
    """Without scheme and root, forward slashes, no leading ./ (a leading dot of a name stays)."""
    p = F.regexp_replace(F.regexp_replace(path, "^file:(//)?", ""), r"\\", "/")
    p = F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p) if root else p
    return F.regexp_replace(p, r"^(\./|/)+", "")


def stream_repository(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)


def sarif_results(reports: DataFrame, column: str = "json", strict: bool = True, path: str | None = None) -> DataFrame:
    """result_ord, rule_id, level, file, line, col (from 0), rel_file, rel_line, rel_col from reports' JSON texts; strict fails on bad JSON.

    Reports are in the order of their path column, or else of their texts' digests, so that the last result is the same at any partitioning.
    """
    parsed = reports.select((F.col(path) if path else F.sha2(column, 256)).alias("_doc"), F.from_json(column, SARIF_SCHEMA, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("d"))
    runs = parsed.select("_doc", F.posexplode("d.runs").alias("_r", "run"))
    res = runs.select("_doc", "_r", F.posexplode("run.results").alias("_i", "x"))
    place, rel = F.col("x.locations")[0]["physicalLocation"], F.try_element_at("x.relatedLocations", F.lit(1))["physicalLocation"]

    def where(loc: Column, prefix: str) -> list[Column]:
        return [
            relative_path(loc["artifactLocation"]["uri"], "").alias(f"{prefix}file"), loc["region"]["startLine"].alias(f"{prefix}line"),
            F.when(loc.isNotNull(), F.greatest(F.coalesce(loc["region"]["startColumn"], F.lit(1)) - 1, F.lit(0))).alias(f"{prefix}col"),
        ]

    return res.where(F.size("x.locations") > 0).select(F.struct("_doc", "_r", "_i").alias("result_ord"), F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level"), *where(place, ""), *where(rel, "rel_"))


def sarif_rule_cwes(reports: DataFrame, column: str = "json") -> DataFrame:
    """rule_id, cwe from rules' external/cwe/cwe-N tags."""
    parsed = reports.select(F.from_json(column, SARIF_SCHEMA).alias("d")).select(F.explode("d.runs").alias("run")).select(F.explode("run.tool.driver.rules").alias("r"))
    return parsed.select(F.col("r.id").alias("rule_id"), F.explode("r.properties.tags").alias("tag")).where(F.lower("tag").startswith("external/cwe/cwe-")).select("rule_id", F.concat(F.lit("CWE-"), F.regexp_extract("tag", r"cwe-0*([0-9]+)$", 1)).alias("cwe")).distinct()


def json_graph(texts: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of exported JSON graphs, whichever of the usual key names they use; meta nodes are left out."""
    v = texts.select(F.try_parse_json(column).alias("v"))

    def items(name: str, schema: str) -> DataFrame:
        return v.select(F.explode(F.from_json(F.to_json(F.try_variant_get("v", f"$.{name}", "variant")), f"array<{schema}>")).alias("x"))

    n = items("nodes", "struct<id:string,_id:string,_label:string,label:string,nodeType:string,code:string,name:string,lineNumber:int,line:int,columnNumber:int>")
    nodes = n.select(F.coalesce("x.id", "x._id").alias("id"), F.coalesce("x._label", "x.label", "x.nodeType").alias("raw_type"), F.coalesce("x.code", F.lit("")).alias("raw_text"), F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.lineNumber", "x.line", F.lit(0)).alias("line"), F.coalesce("x.columnNumber", F.lit(0)).alias("col"))
    e = items("edges", "struct<outV:string,src:string,source:string,inV:string,dst:string,target:string,label:string,_label:string,edgeType:string>")
    edges = e.select(F.coalesce("x.outV", "x.src", "x.source").alias("src"), F.coalesce("x.inV", "x.dst", "x.target").alias("dst"), edge_label(F.coalesce("x.label", "x._label", "x.edgeType")).alias("edge_type"))
    return nodes.where(~F.col("raw_type").isin(dims.META_NODES)), edges


def edge_label(raw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in dims.EDGE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(raw)), F.lit("AST_CHILD"))


#: Keys of so many GraphML files are sent to where the edges are read; those of more meet them by file.
FEW_FILES = 1000


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: file, id, props map; edges: file, src, dst, edge_type, props map) of GraphML files by the XML source, keys resolved to attribute names.

    Keys and ids count within their own file. Of several values of an attribute the least is taken. Every edge is a row, from what it holds itself.
    """
    data = "array<struct<_key:string,_VALUE:string>>"

    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"))

    keys = read("key", "`_id` string, `_attr.name` string").groupBy("file", F.col("_id").alias("k")).agg(F.min("`_attr.name`").alias("name"))

    def props(df: DataFrame, by: list[str]) -> DataFrame:
        flat = df.select(*by, F.explode_outer("data").alias("d")).select(*by, F.col("d._key").alias("k"), F.col("d._VALUE").alias("value")).join(keys, ["file", "k"], "left")
        named = flat.groupBy(*by, F.coalesce("name", "k").alias("name")).agg(F.min("value").alias("value"))
        return named.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("props"))

    nodes = props(read("node", f"`_id` string, data {data}").withColumnRenamed("_id", "id"), ["file", "id"])
    edges = read("edge", f"`_source` string, `_target` string, data {data}").toDF("src", "dst", "data", "file")
    names = keys.where("k is not null and name is not null").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("names"))
    edges = edges.join(F.broadcast(names) if len(edges.inputFiles()) <= FEW_FILES else names, "file", "left")
    # sorted, the least value of a name is its first
    held = F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]).alias("name"), d["_VALUE"].isNull().alias("none"), d["_VALUE"].alias("value")))
    edges = edges.withColumn("held", F.array_sort(F.filter(held, lambda d: d["name"].isNotNull())))
    first = F.filter("held", lambda d, k: (k == 0) | (F.get("held", k - 1)["name"] != d["name"]))
    edges = edges.withColumn("props", F.map_from_entries(F.transform(first, lambda d: F.struct(d["name"], d["value"]))))
    return nodes, edges.select("file", "src", "dst", edge_label(F.coalesce(F.try_element_at("props", F.lit("labelE")), F.try_element_at("props", F.lit("label")), F.lit(""))).alias("edge_type"), "props")


def first_report(spark: SparkSession, path: str, pattern: str = "*.sarif") -> DataFrame:
    """path, json of the first report of a tree, by path; no rows if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.orderBy("path").limit(1).select("path", as_text(F.col("content")).alias("json"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry of sinks, sources and sanitizers from CSV with the columns language, kind, key, label, confidence, cwe; the order of its rows is their precedence."""
    return spark.read.option("header", True).schema("language string, kind string, key string, label string, confidence double, cwe string").csv(path)


def catalog(files: DataFrame, text: str = "text") -> DataFrame:
    """language, vuln_type, cwe, severity, node_types, pattern, sanitizers, keywords, sources, sinks, description, remediation, references of catalog files.

    Files (path, text) hold lists of entries that start with ``- vuln_type:``. One expression for each field of an entry; a file's language is its
    base name. Quotes are taken off, doubled single ones are one; folded texts are one line; keywords, sources, sinks and references are arrays.
    """
    entries = files.select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("language"), F.explode(F.slice(F.split(text, r"(?m)^\s*-\s+(?=vuln_type:)"), 2, 1 << 20)).alias("_e"))

    def value(key: str) -> Column:
        raw = F.regexp_extract("_e", rf"(?m)^\s*{key}:\s*(.*?)\s*$", 1)
        plain = F.regexp_replace(raw, r"\s+#.*$", "")
        single, double = raw.rlike("^'.*'$"), raw.rlike('^".*"$')
        inner = F.regexp_extract(raw, r"^.(.*).$", 1)
        return F.when(single, F.replace(inner, F.lit("''"), F.lit("'"))).when(double, inner).otherwise(plain)

    def items(key: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_extract("_e", rf"(?m)^\s*{key}:\s*\[(.*?)\]\s*$", 1), r"[\"']", ""), r",\s+", ",")

    quoted = r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'|([^\s,\[\]][^,\]]*)"

    def several(raw: Column) -> Column:
        """The members of an inline list, quoted or not."""
        each = F.regexp_extract_all(raw, F.lit(f"(?:{quoted})"), F.lit(0))
        plain = lambda x: F.when(x.rlike("^\"|^'"), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))).otherwise(F.trim(x))
        return F.filter(F.transform(each, plain), lambda x: x != "")

    def array(key: str) -> Column:
        return several(F.regexp_extract("_e", rf"(?m)^\s*{key}:\s*\[(.*)\]\s*$", 1)).alias(key)

    def folded(key: str) -> Column:
        block = F.regexp_extract("_e", rf"(?ms)^( *){key}:\s*>\s*\n(.*?)(?=^\1[\w-]|^\s*\z|\z)", 2)
        return F.coalesce(F.nullif(F.trim(F.regexp_replace(block, r"\s+", " ")), F.lit("")), value(key)).alias(key)

    listed = F.regexp_extract("_e", r"(?ms)^( *)references:\s*\n((?:\1\s+-[^\n]*\n?)*)", 2)
    references = F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^\s*-\s*(.*?)\s*$"), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return entries.select(
        "language", value("vuln_type").alias("vuln_type"), value("cwe").alias("cwe"), value("severity").alias("severity"), items("node_types").alias("node_types"), value("sink_pattern").alias("pattern"), items("sanitizers").alias("sanitizers"),
        array("keywords"), array("sources"), array("sinks"), folded("description"), folded("remediation"), references.alias("references"),
    )


def session_rows(spark: SparkSession, path: str, session: str, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of one session from a table partitioned by session or buckets of sessions: only its partition is read, and of it only the columns asked for."""
    rows = spark.read.parquet(path)
    found = bucket(rows.columns, F.lit(session))
    rows = (rows.where(F.col(found[0]) == found[1]).drop(found[0]) if found else rows).where(F.col("session_id") == session)
    rows = rows.select(*columns) if columns else rows
    return rows.orderBy(*order) if order else rows


#: What a node index needs.
INDEX = ["node_id", "node_type", "name", "file_path", "line", "label", "confidence", "cwe"]


def node_index(spark: SparkSession, path: str, session: str) -> DataFrame:
    return session_rows(spark, path, session, columns=INDEX)


def structure_csv(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, file, line, col of a structural query's CSV; rows that are short or whose line is no number go."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").schema("kind string, name string, file string, line string, col string").csv(path)
    return raw.select("kind", "name", "file", F.expr("try_cast(line as int)").alias("line"), F.coalesce(F.expr("try_cast(col as int)"), F.lit(0)).alias("col")).where("line is not null and file is not null")


def gitmodules(files: DataFrame, column: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """name, path, url, branch of each [submodule] section; larger files are left out."""
    sections = files.where(F.octet_length(column) <= max_bytes).select(*[c for c in files.columns if c != column], F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(\[submodule\s+\"[^\"]*\"\](?:(?!\n\s*\[).)*)"), F.lit(1))).alias("_s"))

    def value(key: str) -> Column:
        return F.trim(F.regexp_extract("_s", rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*(.*?)[ \t\r]*$", 1)).alias(key)

    return sections.select(*[c for c in sections.columns if c != "_s"], F.regexp_extract("_s", r'submodule\s+"([^"]*)"', 1).alias("name"), value("path"), value("url"), value("branch"))


def gitlinks(listing: DataFrame, column: str = "line") -> DataFrame:
    """path, sha of the 160000 entries of ls-tree lines."""
    p = r"^160000\s+commit\s+([0-9a-f]{40})\s+(.+)$"
    return listing.where(F.col(column).rlike(p)).select(F.regexp_extract(column, p, 2).alias("path"), F.regexp_extract(column, p, 1).alias("sha"))


def pinned_commits(listing: DataFrame, index: DataFrame, column: str = "line") -> DataFrame:
    """path, sha of submodules: of ls-tree lines, and where these don't list a path, of a git index's entries (path, mode, sha) of mode 160000."""
    listed = gitlinks(listing, column)
    links = index.where(F.col("mode") == 0o160000).select("path", "sha").distinct()
    return listed.unionByName(links.join(listed.select("path"), "path", "left_anti"))


def head_commit(head: Column, refs: Column, packed: Column) -> Column:
    """HEAD's commit: itself if detached, else its ref file (a map of name to text), else its line of packed-refs."""
    ref, plain = F.regexp_extract(head, r"^ref:\s*(\S+)", 1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = F.filter(F.split(packed, "\n"), lambda x: x.endswith(F.concat(F.lit(" "), ref)))
    return F.when(plain(head).rlike("^[0-9a-f]{40}$"), plain(head)).otherwise(F.coalesce(plain(F.try_element_at(refs, ref)), F.substring_index(F.try_element_at(rows, F.lit(1)), " ", 1)))


def python_ast(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """Nodes of Python sources by the standard library's parser: file_path, ord, node_id, raw_type, line, col, end_line, depth, parent_id, name.

    A table function over Arrow batches; a file that can't be parsed gives one node of type error.
    """
    import ast
    import hashlib

    from ..shipping import ship

    ship(files.sparkSession)
    schema = "file_path string, ord long, node_id string, raw_type string, line long, col long, end_line long, depth long, parent_id string, name string"

    def rows_of(where: str, source: str):
        def make(line: int, col: int, kind: str) -> str:
            return hashlib.sha256(f"{where}:{line}:{col}:{kind}".encode()).hexdigest()[:16]

        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return [(where, 0, make(1, 0, "error"), "error", 1, 0, 1, 0, None, None)]
        out, todo = [], [(tree, 0, None)]
        while todo:
            node, depth, parent = todo.pop()
            line, col, kind = getattr(node, "lineno", 1), getattr(node, "col_offset", 0), type(node).__name__
            me = make(line, col, kind)
            if kind == "Module" or hasattr(node, "lineno"):
                name = next((getattr(node, a) for a in ("name", "id", "attr", "arg") if isinstance(getattr(node, a, None), str)), None)
                out.append((where, len(out), me, kind, line, col, getattr(node, "end_lineno", line) or line, depth, parent, name))
                parent, depth = me, depth + 1
            todo.extend((c, depth, parent) for c in reversed(list(ast.iter_child_nodes(node))))
        return out

    def run(batches):
        import pyarrow as pa

        names = [f.strip().split()[0] for f in schema.split(",")]
        kinds = [pa.string() if "string" in f else pa.int64() for f in schema.split(",")]
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [r for where, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows_of(where, source or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    return files.select(F.col(path).alias("file_path"), F.col(text).alias("text")).mapInArrow(run, schema)
