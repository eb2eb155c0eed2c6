"""Registered queries that write the driver's tables out and read them back: walks, streams, upserts, reports, exchange formats.

What is written stands in the shared scratch folder. The SQL computes from the tables what must be there afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims, text as tx
from ..operators import findings as fi, graph as gr, ingestion as ig, nodes as no
from ..scratch import Scratch
from ..sources import formats as fo, readers as rd, writers as wr
from ..streaming import events as ev
from .queries import N, SQL, documents, register, sequence, table


def _tree(s: SparkSession, d: str) -> str:
    """The documents as a tree of text files, a folder for each language and source."""
    root = f"{Scratch(s, 'tree').root}/repo"
    table(s, d, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(root)
    return root


def _placed(files: DataFrame) -> DataFrame:
    """Adds lang and source, from a file's folders."""
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return files.select("*", part("lang"), part("source"))


WALK = "select lang, source, cast(sum(strlen(text) + 1) as bigint) as bytes, cast(sum(len(string_split(text, chr(10)))) as bigint) as lines from documents where lang <> 'de' group by all"


@register("repository_walk", WALK)
def repository_walk(s, d):
    files = rd.repository(s, _tree(s, d), skipped=["lang=de"], max_bytes=1 << 30)
    text = rd.as_text(F.col("content"))
    return _placed(files).groupBy("lang", "source").agg(F.sum("length").alias("bytes"), F.sum(F.size(F.split(text, "\n")) - 1).cast("long").alias("lines"))


@register("repository_stream", "select lang, source, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by all")
def repository_stream(s, d):
    """The tree as a stream of files into a table; a batch that is replayed changes nothing in it."""
    stream = rd.stream_repository(s, _tree(s, d), 40).where("length > 0").select("path", "length", F.sha2("content", 256).alias("sha256"))
    return _placed(ev.run_now(stream, "append")).groupBy("lang", "source").agg(F.sum("length").alias("bytes"))


@register("walked_manifest", "select lang, count(distinct source) as folders, cast(sum(strlen(text) + 1) as bigint) as bytes, cast(0 as bigint) as binaries from documents group by lang")
def walked_manifest(s, d):
    m = ig.manifest(rd.repository(s, _tree(s, d))).withColumnRenamed("relative_path", "path")
    return _placed(m).groupBy("lang").agg(F.count_distinct("source").alias("folders"), F.sum("size_bytes").alias("bytes"), F.count_if("is_binary").alias("binaries"))


@register("delivered_files", "select lang, count(*) as files from documents where lang <> 'fr' group by lang")
def delivered_files(s, d):
    """Content whose digest is the approved one; French files were changed on the way."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), "lang", "text")
    content = docs.select("relative_path", "lang", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return wr.deliver(docs.select("relative_path", F.sha2("text", 256).alias("sha256")), content).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


def _nodes(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(F.concat(F.lit("s:"), F.col("source")).alias("session_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("node_id"), F.col("lang").alias("label"), F.col("n_chars").cast("long").alias("line"), F.lit(None).cast("string").alias("name"))


@register("node_upserts", """select 's:' || source as session_id, 'n' || doc_id as node_id, case when n_chars > 1000 then 'long' else lang end as label, cast(n_chars as bigint) as line, case when n_chars > 1000 then 'x' end as name from documents""")
def node_upserts(s, d):
    """All nodes, then new labels and names for long ones: a null of the new row keeps the old value."""
    path = f"{Scratch(s, 'upserts').root}/nodes"
    wr.create_tables(s, path.rsplit("/", 1)[0], {"audit": wr.TABLES["audit"]})
    wr.upsert(s, _nodes(s, d), path, ["node_id"])
    new = _nodes(s, d).where("line > 1000").select("session_id", "node_id", F.lit("long").alias("label"), F.lit(None).cast("long").alias("line"), F.lit("x").alias("name"))
    wr.upsert(s, new.unionByName(new), path, ["node_id"])
    return wr.to_memory(s.read.parquet(path), "loom_upserted").select("session_id", "node_id", "label", "line", "name")


@register("edge_upserts", f"with {N} select file as session_id, id as src, nxt as dst from p where nxt is not null and t <> 'LITERAL' and t not in ('RETURN','BREAK','CONTINUE','RAISE') and nxt in (select id from p where t <> 'LITERAL')")
def edge_upserts(s, d):
    """Control-flow edges whose two ends are nodes of their session; literals aren't, and a second run adds none."""
    n, path = sequence(s, d), f"{Scratch(s, 'edges').root}/edges"
    nodes = n.where("t <> 'LITERAL'").select(F.col("file").alias("session_id"), F.col("id").alias("node_id"))
    edges = gr.cfg_next(n).select(F.col("file").alias("session_id"), "src", "dst", "edge_type", tx.edge_id(F.col("src"), F.col("dst"), F.col("edge_type")).alias("edge_id"))
    for _ in range(2):
        wr.write_edges(s, edges, nodes, path, buckets=64)
    return s.read.parquet(path).select("session_id", "src", "dst")


@register("point_updates", "select 'n' || doc_id as node_id, case when lang = 'fr' then 'francais' else lang end as label from documents")
def point_updates(s, d):
    n = _nodes(s, d)
    return wr.mark(n, n.where("label = 'fr'").select("node_id", F.lit("francais").alias("label")), column="label").select("node_id", "label")


@register("deleted_sessions", "select 's:' || source as session_id, count(*) as nodes from documents where source <> 'src3' group by source")
def deleted_sessions(s, d):
    path = f"{Scratch(s, 'deleted').root}/nodes"
    _nodes(s, d).write.partitionBy("session_id").parquet(path)
    wr.delete_session(s, path, "s:src3")
    wr.delete_session(s, path, "s:unknown")
    return s.read.parquet(path).groupBy("session_id").agg(F.count(F.lit(1)).alias("nodes"))


@register("session_index", "select 'n' || doc_id as node_id, lang as label, 'doc/' || doc_id as file_path from documents where source = 'src1'")
def session_index(s, d):
    """One session's nodes from a table partitioned by session: the index's columns only."""
    path = f"{Scratch(s, 'index').root}/nodes"
    rest = {"node_type": F.lit("CALL"), "file_path": F.concat(F.lit("doc/"), F.substring("node_id", 2, 20)), "confidence": F.lit(1.0), "cwe": F.lit(""), "raw_text": F.lit("not read")}
    _nodes(s, d).withColumns(rest).write.partitionBy("session_id").parquet(path)
    return rd.node_index(s, path, "s:src1").select("node_id", "label", "file_path")


@register("json_documents", "select doc_id, lang, source, n_chars from documents")
def json_documents(s, d):
    path = f"{Scratch(s, 'documents').root}/json"
    wr.documents(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return s.read.schema("doc_id long, lang string, source string, n_chars long").json(path)


@register("audit_rows", "select event_type as event, 2 * count(*) as rows, count(distinct user_id) as stages from events group by event_type")
def audit_rows(s, d):
    path, rows = f"{Scratch(s, 'audit').root}/audit", table(s, d, "events").select(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("stage"))
    for _ in range(2):
        wr.append_audit(rows, path)
    return s.read.parquet(path).where("logged_at is not null").groupBy("event").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("stage").alias("stages"))


def _reports(s, d) -> str:
    """A SARIF report for each user."""
    root = f"{Scratch(s, 'reports').root}/sarif"
    place = F.struct(F.struct(F.struct(F.concat(F.lit("./u"), F.col("user_id").cast("string"), F.lit(".py")).alias("uri")).alias("artifactLocation"), F.struct((F.col("event_id") % 1000).alias("startLine"), F.lit(3).alias("startColumn")).alias("region")).alias("physicalLocation"))
    level = F.when(F.col("event_type") == "error", "error").otherwise("note")
    results = table(s, d, "events").groupBy(F.col("user_id").alias("report")).agg(F.collect_list(F.struct(F.col("event_type").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))).alias("results"))
    results.select("report", F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))).alias("value")).write.partitionBy("report").text(root)
    return root


FOUND = "'u' || user_id || '.py' as file, cast(event_id % 1000 as int) as line, cast(2 as int) as col"


@register("sarif_files", f"select event_type as rule_id, {FOUND} from events where event_type = 'error'")
def sarif_files(s, d):
    """Reports through the registered reader, which gets the level's filter."""
    return fo.register(s).read.format("loom-sarif").option("pattern", "*.txt").load(_reports(s, d)).where("level = 'error'").select("rule_id", "file", "line", "col")


@register("first_reports", "select event_type as rule_id, count(*) as n from events where cast(user_id as varchar) = (select min(cast(user_id as varchar)) from events) group by event_type")
def first_reports(s, d):
    first = rd.first_report(s, _reports(s, d), "*.txt")
    return rd.sarif_results(first).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@register("structure_csv", "select event_type as kind, 'u' || user_id as file, cast(case when event_type = 'view' then 0 else event_id end as int) as col, cast(event_id as int) as line from events where event_type <> 'click'")
def structure_csv(s, d):
    """Structural rows of a CSV: a line that is no number drops the row, a column that is none counts as 0."""
    path, t = f"{Scratch(s, 'structure').root}/csv", F.col("event_type")
    number = F.col("event_id").cast("string")
    rows = table(s, d, "events").select(t.alias("kind"), F.lit("f, \"g\"").alias("name"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.when(t == "click", "?").otherwise(number).alias("line"), F.when(t == "view", "").otherwise(number).alias("col"))
    rows.write.option("header", True).csv(path)
    return rd.structure_csv(s, path).select("kind", "file", F.col("col").cast("int"), F.col("line").cast("int"))


def _graphml(s, d) -> str:
    root, n = f"{Scratch(s, 'graphml').root}/g", sequence(s, d)
    node = F.concat(F.lit('<node id="'), "id", F.lit('"><data key="l">'), "t", F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="e">CFG</data></edge>'))
    parts = n.select("file", node.alias("x")).unionByName(gr.cfg_next(n).select("file", edge.alias("x")))
    whole = F.concat(F.lit('<?xml version="1.0"?><graphml><key id="l" attr.name="label"/><key id="e" attr.name="labelE"/><graph>'), F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit("</graph></graphml>"))
    parts.groupBy("file").agg(whole.alias("value")).write.partitionBy("file").text(root)
    return root


GRAPHML = f"with {N} select file, id as src, nxt as dst, '{dims.EDGE_LABELS.get('CFG', 'AST_CHILD')}' as edge_type from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE')"


def _graphml_files(s, d, files: int = 64) -> str:
    """The same graphs in so many GraphML files, whatever the number of users: a node and an edge say whose they are."""
    root, n = f"{Scratch(s, 'graphml').root}/g", sequence(s, d)
    mine = F.coalesce(F.concat(F.lit('<data key="f">'), "file", F.lit("</data>")), F.lit(""))
    node = F.concat(F.lit('<node id="'), "id", F.lit('"><data key="l">'), "t", F.lit("</data>"), mine, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="e">CFG</data>'), mine, F.lit("</edge>"))
    of = F.pmod(F.xxhash64("file"), F.lit(files)).alias("of")
    parts = n.select(of, F.lit(1).alias("place"), node.alias("value")).unionByName(gr.cfg_next(n).select(of, F.lit(2).alias("place"), edge.alias("value")))
    for place, text in ((0, '<?xml version="1.0"?><graphml><key id="l" attr.name="label"/><key id="e" attr.name="labelE"/><key id="f" attr.name="file"/><graph>'), (3, "</graph></graphml>")):
        parts = parts.unionByName(s.range(files).select(F.col("id").alias("of"), F.lit(place).alias("place"), F.lit(text).alias("value")))
    parts.repartition("of").sortWithinPartitions("of", "place").drop("place").write.partitionBy("of").text(root)
    return root


@register("graphml_edges", GRAPHML)
def graphml_edges(s, d):
    _, edges = rd.graphml(s, f"{_graphml_files(s, d)}/*/*.txt")
    return edges.select(F.try_element_at("props", F.lit("file")).alias("file"), "src", "dst", "edge_type")


@register("graphml_nodes", f"with {N} select file, id, t as label from n")
def graphml_nodes(s, d):
    """Nodes of the exported graphs through the registered reader."""
    nodes = fo.register(s).read.format("loom-graphml").option("pattern", "*.txt").load(_graphml(s, d)).where("kind = 'node'")
    return nodes.select(F.regexp_extract("report", "/file=([^/]*)/", 1).alias("file"), "id", F.col("props")["label"].alias("label"))


@register("node_values", "select event_id, case event_id % 3 when 0 then props when 1 then event_type || ' = 1' end as value from events")
def node_values(s, d):
    """Literals' texts, what a configuration value's first = leads to, and none for other types."""
    e, k = table(s, d, "events"), F.col("event_id") % 3
    kind = F.when(k == 0, "LITERAL").when(k == 1, "CONFIG_VALUE").otherwise("CALL")
    raw = F.when(k == 1, F.concat(F.lit("key = "), "event_type", F.lit(" = 1 \n"))).otherwise(F.concat(F.lit(" "), "props", F.lit("\t")))
    return e.select("event_id", no.parser_value(kind, raw).alias("value"))


#: (node type, language, text before and behind the event's number, the name before and behind it); no name: null.
NAMES = [
    ("FUNCTION", "python", "async def f", "(x):", "f", ""), ("FUNCTION", "java", "public static int m", "(int a)", "m", ""), ("FUNCTION", "tsx", "export const c", " = () => 1", "c", ""), ("FUNCTION", "go", "func (r *R) g", "(x int)", "g", ""),
    ("FUNCTION", "rust", "pub fn r", "<T>(x: T)", "r", ""), ("FUNCTION", "cpp", "void A::h", "(int) const {", "h", ""), ("FUNCTION", "yaml", "def f", "(x)", None, None), ("CLASS", "rust", "impl T", " for U", "T", ""), ("CLASS", "cpp", "class C", " {", None, None),
    ("CALL", "python", " cursor.execute", "(q)", "cursor.execute", ""), ("CALL", "go", "os.e", "", "os.e", ""), ("CALL", "c", "9", "", None, None), ("ASSIGN", "python", "  a.b", ": int += 3", "a.b", ""), ("ASSIGN", "python", "call", "()", None, None),
    ("RESOURCE", "terraform", 'resource "aws" "w', '" {', "aws.w", ""), ("CONFIG_KEY", "terraform", '"key', '" = 1', "key", ""), ("IMPORT", "python", " import os", " ", "import os", ""), ("LOOP", "python", "for x", " in y", None, None),
]


@register("parser_names", "select node_type, language, cast(e.event_id as bigint) as event_id, before || e.event_id || behind as name from events e join (values " + ", ".join(f"({k}, '{t}', '{x}', {'null' if a is None else repr(a)}, {'null' if b is None else repr(b)})" for k, (t, x, _, _, a, b) in enumerate(NAMES)) + f") k(k, node_type, language, before, behind) on e.event_id % {len(NAMES)} = k.k")
def parser_names(s, d):
    kinds = F.array(*(F.struct(F.lit(t).alias("node_type"), F.lit(x).alias("language"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, x, a, b, _, _ in NAMES))
    e = table(s, d, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("k")).select("event_id", "k.*", F.concat("k.a", F.col("event_id").cast("string"), "k.b").alias("raw"))
    return e.select("node_type", "language", "event_id", no.parser_name(F.col("node_type"), F.col("raw"), F.col("language")).alias("name"))


@register("relative_submodules", """with b as (select page_id, url, regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '') as base from pages),
 p as (select page_id, regexp_extract(base, '^[a-z]+://[^/]+') as origin, list_filter(string_split(substr(base, length(regexp_extract(base, '^[a-z]+://[^/]+')) + 1), '/'), lambda x: x <> '') as parts from b)
 select page_id, case when len(parts) >= 1 then regexp_replace(origin || '/' || case when len(parts) > 1 then array_to_string(parts[:-2], '/') || '/' else '' end || 'sub' || page_id || '.git', '([^:])//+', '\\1/', 'g') end as url from p""")
def relative_submodules(s, d):
    """../subN.git of every page's url."""
    return table(s, d, "pages").select("page_id", ig.resolve_relative(F.concat(F.lit("../sub"), F.col("page_id").cast("string"), F.lit(".git")), F.col("url")).alias("url"))


NAMED = "case when ord % 2 = 0 then 'print' else name end"


@register("flows_without_builtins", SQL["dfg_flow"].replace("p as (select *, row_number() over w as pos", f"m as (select * replace ({NAMED} as name) from n), p as (select *, row_number() over w as pos", 1).replace("as q from n window", "as q from m window", 1).replace("and length(name) > 1", "and length(name) > 1 and name <> 'print'"))
def flows_without_builtins(s, d):
    """Every second node is named as a builtin: its uses have no flow."""
    return gr.dfg_flows(sequence(s, d).withColumn("name", F.expr(NAMED))).select("file", "src", "dst", "edge_type")


@register("raw_fragments", "select doc_id, substr(x, 6, 40) as fragment from (select doc_id, regexp_replace(text, '[^\\x01-\\x7F]', '?', 'g') as x from documents)")
def raw_fragments(s, d):
    plain = F.regexp_replace("text", r"[^\x01-\x7F]", "?").cast("binary")
    return table(s, d, "documents").select("doc_id", tx.raw_fragment(plain, F.lit(5), F.lit(45)).alias("fragment"))


@register("fanned_out", "select client, count(*) as n from events, (select unnest(['first', 'second']) as client) group by client")
def fanned_out(s, d):
    """A stream's batches to two clients and a dead one, which is dropped."""
    root = Scratch(s, "clients").root

    def dead(batch: DataFrame, number: int) -> None:
        raise OSError("gone")

    clients = {"dead": dead, "first": ev.idempotent(f"{root}/first"), "second": ev.idempotent(f"{root}/second")}
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet").select("event_id")
    ev.fan_out(stream, clients, f"{root}/checkpoint").awaitTermination()
    each = [ev.read_batches(s, f"{root}/{c}", stream.schema).select(F.lit(c).alias("client")) for c in sorted(clients)]
    return each[0].unionByName(each[1]).groupBy("client").agg(F.count(F.lit(1)).alias("n"))


@register("in_memory_files", "select lang, count(*) as files from documents group by lang")
def in_memory_files(s, d):
    files = documents(s, d).join(table(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "lang"), "file_path")
    return wr.to_memory(files, "loom_files").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))




@register("event_throughput", "select user_id, count(*) as n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds, case when max(ts) > min(ts) then round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) else 0.0 end as per_second from events group by user_id")
def event_throughput(s, d):
    return fi.throughput(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id").withColumn("seconds", F.round("seconds", 3))


@register("cross_session", """with st as (select user_id, arg_max(event_type, event_id) as state, count(*) filter (where event_type = 'click') as n_click, count(*) as n_events from events group by user_id),
 k as (select state, count(*) as n from st group by state) select (select count(*) from st) as sessions, (select string_agg(state || '=' || n, ',' order by state || '=' || n) from k) as states, cast(sum(n_click) as bigint) as sum_n_click, cast(sum(n_events) as bigint) as sum_n_events, max(n_click) as max_n_click, max(n_events) as max_n_events from st""")
def cross_session(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    return fi.cross_session(ev.status_rollup(e, ("click",)).withColumnRenamed("latest", "state"), ("n_click", "n_events"))


ADVICE = [("python", "CWE-78", "Unclean input reaches a shell.", "Pass a list."), ("python", "CWE-78", "Zz", "Zz"), ("python", "CWE-1", "Unknown.", "")]


@register("serialised_findings", """select 'n' || event_id as node_id, 'u' || user_id as file_path, event_id as line, case when event_type = 'error' then 'CWE-78' else 'CWE-1' end as cwe, case when event_type = 'error' then 'Command Injection' else 'Unclassified' end as title,
 case when event_type = 'error' then 'HIGH' when event_type = 'purchase' then 'HIGH' else 'MEDIUM' end as severity, round(value / 100, 2) as confidence, left(repeat(props, 60), 400) as text,
 case when event_type = 'error' then 'Unclean input reaches a shell.' else 'Unknown.' end as description, case when event_type = 'error' then 'Pass a list.' else '' end as remediation from events where event_type in ('error', 'purchase', 'view') and value / 100 >= 0.3""")
def serialised_findings(s, d):
    e, t = table(s, d, "events"), F.col("event_type")
    nodes = e.where(t.isin("error", "purchase", "view", "click")).select(
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("node_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").alias("line"), F.lit("python").alias("language"),
        F.when(t == "view", "SENSITIVE").when(t == "click", "SOURCE").otherwise("SINK").alias("label"), F.when(t == "error", "CWE-78").otherwise("CWE-1").alias("cwe"), (F.col("value") / 100).alias("confidence"), F.repeat("props", F.lit(60)).alias("raw_text"),
    )
    return fi.serialised(nodes, dims.frame(s, "cwes"), s.createDataFrame(ADVICE, "language string, cwe string, description string, remediation string"))


CAPABLE = [("grammar", "en", True, 1), ("server", "en", True, 2), ("server", "fr", False, 1), ("regex", "fr", True, 2), ("regex", "de", False, 1), ("a", "es", True, 1), ("b", "es", True, 1)]


@register("capable_backends", "select doc_id, case lang when 'en' then 'grammar' when 'fr' then 'regex' when 'es' then 'a' else 'fallback' end as backend from documents")
def capable_backends(s, d):
    files = table(s, d, "documents").select("doc_id", F.col("lang").alias("language"))
    return no.route_by_capability(files, s.createDataFrame(CAPABLE, "backend string, language string, available boolean, rank int")).select("doc_id", "backend")


@register("sealed_appends", "select source as session_id, count(*) as n, case when source in ('src1', 'src2') then 'MANIFEST_SEALED' end as error from documents group by source")
def sealed_appends(s, d):
    """Rows for sealed sessions are refused, a row each."""
    rows = table(s, d, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("relative_path"))
    accepted, refused = wr.append_unsealed(rows, rows.where("session_id in ('src1', 'src2')").select("session_id"))
    both = accepted.select("session_id", F.lit(None).cast("string").alias("error")).unionByName(refused.select("session_id", "error"))
    return both.groupBy("session_id", "error").agg(F.count(F.lit(1)).alias("n"))


REPLAYED = f"""{N}, e as (select file, id as src, nxt as dst from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE')), f as (select file, id from n where t = 'CALL'),
 told as (select file, 1 as part, lpad(cast(line as varchar), 12, '0') || ':' || id as place, 'node' as type, '{{"node_id":"' || id || '","node_type":"' || t || '","line":' || line || '}}' as payload from n
  union all select file, 2, src || ':' || dst || ':CFG_NEXT', 'edge', '{{"src":"' || src || '","dst":"' || dst || '","edge_type":"CFG_NEXT"}}' from e
  union all select file, 3, id, 'finding', '{{"node_id":"' || id || '","cwe":"CWE-1","severity":"LOW"}}' from f
  union all select n.file, 4, '', 'COMPLETE', '{{"node":' || count(*) || ',"edge":' || (select count(*) from e where e.file = n.file) || ',"finding":' || count(*) filter (where t = 'CALL') || '}}' from n group by n.file)"""


@register("replayed_sessions", f"with {REPLAYED} select file as session_id, row_number() over (partition by file order by part, place, payload) as seq, type, payload from told")
def replayed_sessions(s, d):
    n = sequence(s, d).withColumnRenamed("file", "session_id")
    edges = gr.cfg_next(sequence(s, d)).withColumnRenamed("file", "session_id")
    return ev.replay(n, edges, n.where("t = 'CALL'").select("session_id", "id", F.lit("CWE-1").alias("cwe"), F.lit("LOW").alias("severity")))


@register("replay_keeps_its_word", "select cast(user_id as varchar) as session_id, true as ok from events group by user_id")
def replay_keeps_its_word(s, d):
    """The counts that each replayed session claims at its end are those it has told."""
    return ev.complete_counts(replayed_sessions(s, d))


#: Folders and endings of file names by turns: what each walk keeps.
FOLDERS, ENDS = ["src", "node_modules", ".tox", "vendor", "lib"], [".py", ".min.js", ".class", ".js"]


@register("walk_rules", f"""select doc_id, {FOLDERS!r}[cast(doc_id % 5 as int) + 1] not in ('node_modules', '.tox') and {ENDS!r}[cast(doc_id % 4 as int) + 1] not in ('.min.js', '.class') as parsed, {FOLDERS!r}[cast(doc_id % 5 as int) + 1] not in ('node_modules', 'vendor') as listed from documents""")
def walk_rules(s, d):
    at = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % len(x) + 1).cast("int"))
    path = F.concat_ws("/", F.lit("repo"), at(FOLDERS), F.concat(F.lit("f"), F.col("doc_id").cast("string"), at(ENDS)))
    docs = table(s, d, "documents").select("doc_id", path.alias("path"))
    return docs.select("doc_id", rd.walked(F.col("path"), dims.PARSER_SKIPPED_DIRS, dims.PARSER_SKIPPED_ENDS).alias("parsed"), rd.walked(F.col("path"), dims.MANIFEST_SKIPPED_DIRS).alias("listed"))


@register("manifest_walks", """select source || '/f' || doc_id as path, case when lang = 'fr' then 'symlink_escape' else sha256(text) end as found from documents where lang <> 'de'""")
def manifest_walks(s, d):
    """French files are links out of the repository, German ones links within it: neither is in the manifest, the first are refused."""
    path = F.concat(F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"))
    docs = table(s, d, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"), "lang")
    target = F.when(F.col("lang") == "fr", F.lit("../../etc/passwd")).otherwise("../src1/x")
    listed, refused = ig.walk_manifest(docs.drop("lang"), docs.where("lang in ('fr', 'de')").select("path", target.alias("target")), "/repo")
    return listed.select(F.col("relative_path").alias("path"), F.col("sha256").alias("found")).unionByName(refused.withColumnRenamed("rule", "found"))
