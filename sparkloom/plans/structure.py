"""Registered queries of the block scanner, the parse cache and guarded stages over documents and pages, read as scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import node_id
from ..operators import blocks as bl, nodes as no
from ..scratch import Scratch
from .cache import ParseCache
from .queries import BOTH, LINES, NODES, documents, pages, register
from .stages import Stage, degraded, guarded, run_stages

_TILES = bl.TOKENS["javascript"].replace("'", "''") + r"|[{}()\[\]]|[^\"''`/{}()\[\]]+|[\s\S]"
#: Tokens tile the text, so places are sums of lengths; partners are neighbours within one depth, parents an as-of join one depth up.
SPANS = rf"""{BOTH}, k as (select file_path, unnest(x) as tok, generate_subscripts(x, 1) as k from (select file_path, regexp_extract_all(text, '{_TILES}') as x from files)),
 p as (select file_path, tok, k, cast(sum(length(tok)) over (partition by file_path order by k) as bigint) as stop from k),
 b as (select file_path, tok, k, stop, stop - 1 as start, tok in ('{{', '(', '[') as opener, case when tok in ('{{', '}}') then '{{' when tok in ('(', ')') then '(' else '[' end as bracket from p where tok in ('{{', '}}', '(', ')', '[', ']')),
 s as (select *, sum(case when opener then 1 else -1 end) over (partition by file_path, bracket order by k) as sums from b),
 f as (select *, least(0, min(sums) over (partition by file_path, bracket order by k)) as low from s),
 g as (select *, sums - low - cast(opener as int) as depth, not opener and low < coalesce(lag(low) over (partition by file_path, bracket order by k), 0) as lost from f),
 m as (select *, lead(opener) over w as o2, lead(stop) over w as stop2 from g where not lost window w as (partition by file_path, bracket, depth order by k)),
 o as (select file_path, bracket, start, depth, coalesce(not o2, false) as closed, stop2 from m where opener),
 a as (select o.*, q.start as parent_start from o asof left join (select file_path as fp, bracket as br, depth + 1 as d, start from o) q on q.fp = o.file_path and q.br = o.bracket and q.d = o.depth and o.start > q.start)"""
LINE = "1 + length(regexp_replace(left(text, cast({} as bigint)), '[^\\n]+', '', 'g'))"


def scripts(s, d):
    return documents(s, d).unionByName(pages(s, d)).withColumn("language", F.lit("javascript"))


@register("block_spans", f"""with {SPANS} select file_path, bracket, start, case when closed then stop2 else length(text) end as stop, {LINE.format('start')} as line, case when closed then {LINE.format('stop2 - 1')} else {LINE.format('length(text)')} end as end_line,
 start - (length(left(text, start)) - length(regexp_extract(left(text, start), '([^\\n]*)$', 1))) as col, cast(depth as int) as depth, parent_start, closed from a join files using (file_path)""")
def block_spans(s, d):
    return bl.spans(scripts(s, d)).drop("head")


@register("block_counts", f"""with {SPANS} select file_path, count(*) filter (where bracket = '{{') as blocks, coalesce(max(depth) filter (where bracket = '{{'), -1) + 1 as depth, count(*) filter (where bracket = '{{' and not closed) as unclosed from files left join a using (file_path) group by file_path""")
def block_counts(s, d):
    n = bl.structure_nodes(scripts(s, d))
    return n.groupBy("file_path").agg(F.count_if(F.col("t") != "PROGRAM").alias("blocks"), F.max("depth").cast("long").alias("depth"), F.count_if(F.col("attributes") == "unclosed").alias("unclosed"))


def parse_regex(new):
    """A cache's parser: the regex nodes of texts named by their digest; node ids are made from the path later, as they depend on it."""
    return no.fallback_nodes(new.select(F.col("sha").alias("file_path"), "text")).withColumnRenamed("file_path", "sha").drop("node_id")


@register("parse_cache", """with d as (select count(distinct text) as n from documents), b as (select count(distinct t) as n from (select text as t from documents union all select html from pages))
 select 1 as run, n as parsed, (select count(*) from documents) as files from d union all select 2, b.n - d.n, (select count(*) from documents) + (select count(*) from pages) from b, d union all select 3, 0, (select count(*) from documents) + (select count(*) from pages)""")
def parse_cache(s, d):
    """Three runs over a growing repository: documents, then pages too, then the same again."""
    first, both = documents(s, d), documents(s, d).unionByName(pages(s, d))
    cache, out = ParseCache(s, Scratch(s, "cache").root, "1", parse_regex), []
    for run, files in enumerate((first, both, both), 1):
        cache.nodes(files.withColumn("language", F.lit("python")))
        out.append((run, cache.parsed, files.count()))
    return s.createDataFrame(out, "run int, parsed long, files long")


@register("cached_nodes", f"with {BOTH}, {LINES}, {NODES} select substr(sha256(file_path || ':' || line || ':' || col || ':' || node_type), 1, 16) as node_id, file_path, line, node_type, cast(col as int) as col, raw_text from fb")
def cached_nodes(s, d):
    """The nodes of all files where the documents' come from an earlier run."""
    cache = ParseCache(s, Scratch(s, "cache").root, "1", parse_regex)
    language = F.lit("python")
    cache.nodes(documents(s, d).withColumn("language", language))
    n = cache.nodes(documents(s, d).unionByName(pages(s, d)).withColumn("language", language))
    return n.select(node_id(F.col("file_path"), F.col("line"), F.col("col"), F.col("node_type")).alias("node_id"), "file_path", "line", "node_type", "col", "raw_text")


def first_heading(path: str, text: str):
    """A strict parser: a document's lines that begin with a capital; one that has a line of over 2,000 characters is refused."""
    for k, line in enumerate(text.split("\n"), 1):
        if len(line) > 2000:
            raise ValueError(f"line {k} is too long")
        if "A" <= line[:1] <= "Z":
            yield k, len(line)


REFUSED = "l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as k from (select doc_id, string_split(text, chr(10)) as x from documents)), bad as (select doc_id, min(k) as k from l where length(line) > 2000 group by doc_id)"


@register("guarded_stage", f"""with {REFUSED} select 'doc/' || doc_id as file_path, 'PROGRAM' as node_type, cast(1 as bigint) as line, '{{"error":"ValueError: line ' || k || ' is too long"}}' as attributes from bad
 union all select 'doc/' || doc_id, 'HEADING', k, cast(length(line) as varchar) from l where line[1] between 'A' and 'Z' and doc_id not in (select doc_id from bad)""")
def guarded_stage(s, d):
    """A stage over all documents in which some fail: these are one node each, the others have theirs."""
    files = documents(s, d)

    def parse(state):
        rows, failures = guarded(state["files"], "headings", first_heading, "line long, size long")
        return {"nodes": rows.select("file_path", F.lit("HEADING").alias("node_type"), "line", F.col("size").cast("string").alias("attributes")), "failures": failures}

    def keep(state):
        return {"degraded": degraded(state["files"], state["failures"])}

    out = run_stages(s, [Stage("parse", parse), Stage("degrade", keep, when=lambda state: not state["failures"].isEmpty())], {"files": files})
    rest = out.state.get("degraded")
    nodes = out.state["nodes"]
    return nodes if rest is None else nodes.unionByName(rest.withColumn("line", F.col("line").cast("long")))
