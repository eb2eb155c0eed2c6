"""Registered queries of the engine's own operators over the driver's tables, and the same in DuckDB SQL.

Two adapters feed the operators: A-text takes ``documents`` and ``pages`` as files of lines; A-seq takes ``events`` as ordered nodes, a
user's events being a file in the order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dims, text as tx
from ..operators import annotate as an, findings as fi, graph as gr, ingestion as ig, nodes as no, sessions as se, validate as va
from ..shipping import ship
from ..sources import readers as rd
from ..streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def documents(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "text")


def pages(s, d) -> DataFrame:
    return table(s, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file_path"), F.col("html").alias("text"))


TYPES = ["IF", "LOOP", "BREAK", "CONTINUE", "TRY", "CATCH", "RAISE", "FINALLY", "RETURN", "PARAM", "ASSIGN", "ASSIGN", "AUGMENTED_ASSIGN", "IDENTIFIER", "IDENTIFIER", "MEMBER_ACCESS", "CALL", "LITERAL", "YIELD", "FUNCTION"]
KIND = "(event_id + length(event_type)) % 20"


def sequence(s, d) -> DataFrame:
    """A-seq: the events as nodes."""
    e = table(s, d, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kinds = F.array(*map(F.lit, TYPES))
    return e.select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.element_at(kinds, (F.expr(KIND) + 1).cast("int")).alias("t"), "line", F.lit(0).alias("col"), (F.col("line") + F.col("event_id") % 7).cast("int").alias("end_line"), F.lit("").alias("fn"),
        F.concat(F.lit("v"), F.regexp_extract("props", "([0-9]+)", 1)).alias("name"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), (F.col("event_id") - 3).cast("string"))).alias("parent_id"),
    )


N = f"""n as (select cast(user_id as varchar) as file, event_id as ord, 'e' || event_id as id,
 ({TYPES!r})[cast({KIND} as int) + 1] as t, line, 0 as col, cast(line + event_id % 7 as int) as end_line, '' as fn,
 'v' || regexp_extract(props, '([0-9]+)', 1) as name, case when event_id % 3 = 0 then 'e' || (event_id - 3) end as parent_id
 from (select *, row_number() over (partition by user_id order by ts, event_id) as line from events)),
p as (select *, row_number() over w as pos, lead(id) over w as nxt, row_number() over (partition by file order by end_line - line desc, line, col, ord) as q from n window w as (partition by file order by line, col, ord))"""


def prev(condition: str, value: str = "id") -> str:
    return f"last_value(case when {condition} then {value} end ignore nulls) over (partition by file order by pos rows between unbounded preceding and 1 preceding)"


def edge_query(name: str, f: Callable[[DataFrame], DataFrame], body: str, extra: str = "") -> None:
    register(name, f"with {N}{extra} {body}")(lambda s, d: f(sequence(s, d)).select("file", "src", "dst", "edge_type"))


edge_query("cfg_next", gr.cfg_next, "select file, id as src, nxt as dst, 'CFG_NEXT' as edge_type from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE')")
edge_query(
    "cfg_if",
    gr.cfg_branches,
    """select file, id as src, yes as dst, 'CFG_TRUE' as edge_type from i where yes is not null
 union all select file, id, coalesce(no, nxt), 'CFG_FALSE' from i where coalesce(no, nxt) is not null and (yes is null or coalesce(no, nxt) <> yes)""",
    """, i as (select a.file, a.id, a.nxt,
 arg_min(b.id, b.pos) filter (where a.end_line = 0 or b.line <= a.end_line) as yes,
 arg_min(b.id, b.pos) filter (where a.end_line > 0 and b.line > a.end_line and b.t <> 'IF') as no
 from p a left join p b on a.file = b.file and a.fn = b.fn and b.pos > a.pos and b.line > a.line where a.t = 'IF' group by all)""",
)
edge_query(
    "cfg_loop",
    gr.cfg_loops,
    """select file, id as src, nxt as dst, 'CFG_TRUE' as edge_type from p where t = 'LOOP' and nxt is not null
 union all select file, id, nxt, 'CFG_FALSE' from p where t = 'LOOP' and nxt is not null
 union all select file, id, lp, 'CFG_LOOP' from l where t in ('BREAK','CONTINUE') and lp is not null""",
    f", l as (select *, {prev("t = 'LOOP'")} as lp from p)",
)
edge_query(
    "cfg_exception",
    gr.cfg_exceptions,
    """select file, tr as src, id as dst, 'CFG_EXCEPTION' as edge_type from x where t = 'CATCH' and tr is not null
 union all select file, id, tr, 'CFG_EXCEPTION' from x where t = 'RAISE' and tr is not null
 union all select file, tr, id, 'CFG_FINALLY' from y where t = 'FINALLY' and tr is not null
 union all select file, ct, id, 'CFG_FINALLY' from y where t = 'FINALLY' and ct is not null""",
    f", x as (select *, {prev("t = 'TRY'")} as tr from p), y as (select *, {prev("t = 'CATCH' and tr is not null")} as ct from x)",
)
DEFS = "t in ('PARAM','ASSIGN','AUGMENTED_ASSIGN')"
edge_query("dfg_kills", gr.dfg_kills, f"select file, b as src, id as dst, 'DFG_KILLS' as edge_type from (select *, lag(id) over (partition by file, name order by pos) as b from p where {DEFS}) where b is not null and t <> 'PARAM'")
edge_query(
    "dfg_flow",
    gr.dfg_flows,
    f"""select file, df as src, id as dst, 'DFG_FLOW' as edge_type from (select *, last_value(case when {DEFS} then id end ignore nulls)
 over (partition by file, name order by pos rows between unbounded preceding and 1 preceding) as df from p) where df is not null and t in ('IDENTIFIER','MEMBER_ACCESS') and length(name) > 1""",
)
edge_query(
    "dfg_depends",
    gr.dfg_depends,
    """select distinct a.file, a.id as src, c.id as dst, 'DFG_DEPENDS' as edge_type from p a join p c on a.file = c.file and c.t = 'CALL' and a.id <> c.id
 where a.t in ('IDENTIFIER','LITERAL','CALL','MEMBER_ACCESS') and (a.parent_id = c.id or ((a.parent_id is null or not exists (select 1 from p o where o.file = a.file and o.id = a.parent_id))
 and a.line between c.line and coalesce(nullif(c.end_line, 0), c.line)))""",
)


def two_on_a_line(n: DataFrame) -> DataFrame:
    """Puts two neighbours on one line, for operators that look along a line."""
    return n.withColumns({"col": F.col("line") % 2, "line": F.floor(F.col("line") / 2).cast("int")})


edge_query(
    "dfg_return",
    lambda n: gr.dfg_returns(two_on_a_line(n)),
    f"""select file, df as src, ret as dst, 'DFG_FLOW' as edge_type from (select u.file, u.ret, arg_max(d.id, d.pos) as df from u join m d on d.file = u.file and d.name = u.name and d.pos < u.pos and d.{DEFS} group by u.file, u.ret, u.name) where df is not null""",
    """, m as (select file, id, t, name, line // 2 as line, line % 2 as col, pos from p),
 u as (select distinct r.file, r.id as ret, r.pos, i.name from m r join m i on r.file = i.file and r.line = i.line and i.col > r.col where r.t = 'RETURN' and i.t = 'IDENTIFIER')""",
)
INSIDE = "a.file = b.file and b.q > a.q and b.line >= a.line and greatest(b.end_line, b.line) <= a.end_line and a.id <> b.id and a.end_line - a.line >= 1"
edge_query("ast_parent", gr.ast_edges, f"select b.file, arg_max(a.id, a.q) as src, b.id as dst, 'AST_CHILD' as edge_type from p a join p b on {INSIDE} group by b.file, b.id")
edge_query("ast_child_first", lambda n: gr.ast_edges(n, "child_first"), f"select a.file, a.id as src, arg_min(b.id, b.q) as dst, 'AST_CHILD' as edge_type from p a join p b on {INSIDE} group by a.file, a.id")
edge_query("ast_siblings", lambda n: gr.ast_siblings(n.withColumn("parent_id", F.concat(F.lit("p"), (F.col("line") % 5).cast("string")))), "select file, id as src, nx as dst, 'AST_NEXT_SIBLING' as edge_type from (select *, lead(id) over (partition by file, line % 5 order by line, col, ord) as nx from n) where nx is not null")


@register("cfg_edge_counts", f"""with {N}, e as (select file, id, nxt, t from p where nxt is not null)
 select file, count(*) filter (where t not in ('RETURN','BREAK','CONTINUE','RAISE')) + count(*) filter (where t in ('TRY','FINALLY','AWAIT')) as next_raw,
 count(*) filter (where t not in ('RETURN','BREAK','CONTINUE','RAISE')) as next_distinct from e group by file""")
def cfg_edge_counts(s, d):
    e = gr.cfg(sequence(s, d), with_repeats=True).where("edge_type = 'CFG_NEXT'")
    return e.groupBy("file").agg(F.count(F.lit(1)).alias("next_raw"), F.count_distinct("edge_id").alias("next_distinct"))


@register("cfg_warnings", f"with {N} select file, id, 'line ' || line || ': generator suspends' as warning from n where t = 'YIELD'")
def cfg_warnings(s, d):
    return gr.cfg_warnings(sequence(s, d))


@register("enclosing_function", f"""with {N}, j as (select b.file, b.id, arg_min(a.id, (a.end_line - a.line) * 1000000000 + a.ord) as parent_function from n a join n b
 on a.file = b.file and a.t = 'FUNCTION' and b.line >= a.line and greatest(b.line, b.end_line) <= a.end_line and a.id <> b.id group by all)
 select n.file, n.id, j.parent_function from n left join j on n.file = j.file and n.id = j.id""")
def enclosing_function(s, d):
    n = sequence(s, d)
    # equal spans: the earlier node; ids compare as text, so ties are broken by a padded id
    padded = n.withColumn("id", F.concat(F.lit("e"), F.lpad(F.col("ord").cast("string"), 12, "0")))
    out = gr.enclosing(padded)
    plain = lambda c: F.concat(F.lit("e"), F.expr(f"cast(substring({c}, 2) as bigint)").cast("string"))
    return out.select("file", plain("id").alias("id"), plain("parent_function").alias("parent_function"))


LINES = "lines as (select file_path, ord as line, x as content from (select file_path, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as ord from files))"
DOCS = "files as (select 'doc/' || doc_id as file_path, text from documents)"
PAGES = "files as (select 'page/' || page_id as file_path, html as text from pages)"
SECRET = r"(?:password|secret|api_key|token|passwd|private_key)\s*=\s*[\"''][^\"'']{6,}[\"'']"


@register("hardcoded_secret", f"""with {DOCS}, {LINES}, h as (select file_path, line, length(regexp_extract(content, '^(.*?){SECRET}', 1)) as col, content from lines where regexp_matches(content, '{SECRET}'))
 select substr(sha256(file_path || ':' || line || ':' || col || ':ASSIGN'), 1, 16) as node_id, file_path, line, col, 'CWE-798' as cwe, 'MEDIUM' as severity from h""")
def hardcoded_secret(s, d):
    pattern = next(r[5] for r in dims.CATALOG if r[:2] == ("python", "Hardcoded Secret"))
    hit = no.lines(documents(s, d)).where(F.col("content").rlike(pattern)).withColumn("col", F.length(F.regexp_extract("content", f"^(.*?){pattern}", 1)))
    return hit.select(tx.node_id(F.col("file_path"), F.col("line"), F.col("col"), F.lit("ASSIGN")).alias("node_id"), "file_path", "line", "col", F.lit("CWE-798").alias("cwe"), F.lit("MEDIUM").alias("severity"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CATALOG_SQL = ", ".join(f"({_quoted(r[1])}, {_quoted(r[2])}, {_quoted(r[3])}, {_quoted(r[5])})" for r in dims.CATALOG)


@register("pattern_catalog", f"""with files as (select 'doc/' || doc_id as file_path, text from documents union all select 'page/' || page_id, html from pages), {LINES}, c(vuln_type, cwe, severity, pattern) as (values {CATALOG_SQL})
 select vuln_type, cwe, severity, count(*) as hits, count(distinct file_path) as files from lines, c where regexp_matches(content, pattern) group by all""")
def pattern_catalog(s, d):
    hits = no.pattern_hits(documents(s, d).unionByName(pages(s, d)), dims.frame(s, "catalog"))
    return hits.groupBy("vuln_type", "cwe", "severity").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("file_path").alias("files"))


NODES = r"""s as (select file_path, line, content, regexp_replace(content, '^\s+|\s+$', '', 'g') as s from lines), k as (select * from s where s <> '' and s not like '#%'),
 fb as (select file_path, line, 'FUNCTION' as node_type, 0 as col, length(content) as end_col, left(s, 200) as raw_text from k where regexp_matches(s, '^(?:async\s+)?(?:def|function|func|fn)\s+[A-Za-z0-9_]+\s*\(')
 union all select file_path, line, 'CALL', i - 1, i - 1 + length(c[i]), c[i] from (select *, unnest(generate_series(1, len(c))) as i from (select file_path, line, regexp_extract_all(s, '([A-Za-z0-9_]+)\s*\(', 1) as c from k where not regexp_matches(s, '^(?:async\s+)?(?:def|function|func|fn)\s+[A-Za-z0-9_]+\s*\(')))
 union all select file_path, line, 'IMPORT', 0, length(s), left(s, 200) from k where regexp_matches(s, '^(?:import|from|#include|use\s|require\s)') and not regexp_matches(s, '^(?:async\s+)?(?:def|function|func|fn)\s+[A-Za-z0-9_]+\s*\('))"""


def both_nodes(s, d) -> DataFrame:
    return no.fallback_nodes(documents(s, d).unionByName(pages(s, d)))


BOTH = "files as (select 'doc/' || doc_id as file_path, text from documents union all select 'page/' || page_id, html from pages)"


@register("fallback_nodes", f"with {BOTH}, {LINES}, {NODES} select substr(sha256(file_path || ':' || line || ':' || col || ':' || node_type), 1, 16) as node_id, file_path, line, node_type, cast(col as int) as col, cast(end_col as int) as end_col, raw_text from fb")
def fallback_nodes(s, d):
    return both_nodes(s, d).select("node_id", "file_path", "line", "node_type", "col", "end_col", "raw_text")


CASE_LABEL = "case " + " ".join(f"when regexp_matches(raw_text, {_quoted(p)}) then {_quoted(label)}" for p, label, _ in dims.CALL_PATTERNS) + " else 'NONE' end"


@register("classify_calls", f"with {BOTH}, {LINES}, {NODES} select raw_text as name, {CASE_LABEL} as label, count(*) as n from fb where node_type = 'CALL' group by all")
def classify_calls(s, d):
    calls = both_nodes(s, d).where("node_type = 'CALL'").groupBy("raw_text").agg(F.count(F.lit(1)).alias("n"))
    return calls.select(F.col("raw_text").alias("name"), no.classify_call(F.col("raw_text"))[0].alias("label"), "n")


@register("type_normalize", "select * from (select lower(p_type) as raw_type, " + "case " + " ".join(f"when regexp_matches(lower(p_type), '{w}') then '{t}'" for w, t in dims.TYPE_KEYWORDS) + """ else 'UNKNOWN' end as node_type, count(*) as n from part group by all) union all
 select k.raw, k.t, count(*) from events e join (values (0, 'call', 'CALL'), (1, 'function_definition', 'FUNCTION'), (2, 'augmented_assignment', 'AUGMENTED_ASSIGN'), (3, 'attribute', 'MEMBER_ACCESS'), (4, 'formal_parameters', 'PARAM'), (5, 'list_comprehension', 'COMPREHENSION'),
  (6, 'except_clause', 'CATCH'), (7, 'lambda', 'LAMBDA'), (8, 'for_statement', 'LOOP'), (9, 'qqq', 'UNKNOWN')) k(n, raw, t) on e.user_id % 10 = k.n group by all""")
def type_normalize(s, d):
    raw = F.array(*map(F.lit, ("call", "function_definition", "augmented_assignment", "attribute", "formal_parameters", "list_comprehension", "except_clause", "lambda", "for_statement", "qqq")))
    parts = table(s, d, "part").select(F.lit("sql").alias("language"), F.lower("p_type").alias("raw_type"))
    kind = F.element_at(raw, (F.col("user_id") % 10 + 1).cast("int"))
    calls = table(s, d, "events").select(F.when(kind == "formal_parameters", "javascript").otherwise("python").alias("language"), kind.alias("raw_type"))
    return no.normalize_types(parts.unionByName(calls), dims.frame(s, "type_map")).groupBy("raw_type", "node_type").agg(F.count(F.lit(1)).alias("n"))


NAMES = """select distinct w as name from (select unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_.]+)', 1)) as w from documents union all select unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_.]+)', 1)) from pages
 union all select case event_id % 3 when 0 then 'm' || event_id || '.pickle.loads' when 1 then 'os.system' else 'Eval' end from events)"""


def words(s, d) -> DataFrame:
    pattern = F.lit(r"([A-Za-z_][A-Za-z0-9_.]+)")
    both = table(s, d, "documents").select(F.col("text")).unionByName(table(s, d, "pages").select(F.col("html").alias("text")))
    k = F.col("event_id") % 3
    calls = table(s, d, "events").select(F.when(k == 0, F.concat(F.lit("m"), F.col("event_id").cast("string"), F.lit(".pickle.loads"))).when(k == 1, "os.system").otherwise("Eval").alias("name"))
    return both.select(F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("name")).unionByName(calls).distinct()


REG = "reg(kind_ord, key_ord, key, label, confidence, cwe) as (values " + ", ".join(f"({dims.KINDS.index(r[1])}, {i}, {_quoted(r[2])}, {_quoted(r[3])}, {r[4]!r}, {_quoted(r[5])})" for i, r in enumerate(r for r in dims.REGISTRY if r[0] == "python")) + ")"


def _words_test(words_: list[str], where: str) -> str:
    tests = {"in": "contains(low, '{}')", "start": "starts_with(low, '{}')", "end": "ends_with(low, '{}')"}
    return "(" + " or ".join(tests[k].format(w) for w in words_ for k in where.split("|")) + ")"


ANNOTATED = f"""names as ({NAMES}), {REG}, w as (select name, lower(name) as low from names),
 v as (select name, unnest([name, low, regexp_extract(name, '([^.]*)$', 1), lower(regexp_extract(name, '([^.]*)$', 1))]) as key, unnest([0, 1, 2, 3]) as v from w),
 one as (select name, arg_min(struct_pack(label := label, confidence := cast(confidence as double), cwe := cwe), v * 10000 + kind_ord * 1000 + key_ord) as b from v join reg using (key) group by name),
 two as (select name, arg_min(struct_pack(label := label, confidence := cast(confidence as double) * case when low = lower(key) then 1.0 else 0.75 end, cwe := cwe), kind_ord * 1000 + key_ord) as b from w join reg on ends_with(low, lower(key)) group by name),
 three as (select name, case when {_words_test(dims.SENSITIVE_WORDS, 'in')} then struct_pack(label := 'SENSITIVE', confidence := cast(0.55 as double), cwe := 'CWE-798') when {_words_test(dims.SANITIZER_WORDS, 'start|end')} then struct_pack(label := 'SANITIZER', confidence := cast(0.45 as double), cwe := '')
 when {_words_test(dims.SINK_WORDS, 'end')} then struct_pack(label := 'SINK', confidence := cast(0.40 as double), cwe := '') when {_words_test(dims.SOURCE_WORDS, 'start|end')} then struct_pack(label := 'SOURCE', confidence := cast(0.35 as double), cwe := '') end as b from w),
 a as (select w.name, coalesce(one.b, two.b, three.b, struct_pack(label := 'NONE', confidence := cast(0.0 as double), cwe := '')) as b, case when one.b is not null then 1 when two.b is not null then 2 when three.b is not null then 3 else 0 end as pass
 from w left join one using (name) left join two using (name) left join three using (name))"""


def annotated(s, d) -> DataFrame:
    n = words(s, d).select(F.col("name").alias("node_id"), "name", F.lit("CALL").alias("node_type"), F.lit("").alias("raw_text"), F.lit("python").alias("language"))
    return an.annotate(n, dims.frame(s, "registry"))


for _name, _passes in (("annotate_exact", (1,)), ("annotate_suffix", (2,)), ("annotate_heuristic", (3,)), ("annotate_full", (0, 1, 2, 3))):
    register(_name, f"with {ANNOTATED} select name, b.label as label, round(b.confidence, 6) as confidence, b.cwe as cwe, pass from a where pass in ({', '.join(map(str, _passes))})")(
        lambda s, d, p=_passes: annotated(s, d).where(F.col("pass").isin(list(p))).select("name", "label", "confidence", "cwe", "pass")
    )


@register("annotation_counts", f"with {ANNOTATED} select b.label as label, pass, count(*) as n, round(avg(b.confidence), 4) as confidence from a group by all")
def annotation_counts(s, d):
    return annotated(s, d).groupBy("label", "pass").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@register("base64_runs", "select 'doc/' || doc_id as file_path, len(regexp_extract_all(text, '[A-Za-z0-9+/]{40,}={0,2}')) as n from documents where regexp_matches(text, '[A-Za-z0-9+/]{40,}={0,2}')")
def base64_runs(s, d):
    return documents(s, d).select("file_path", F.regexp_count("text", F.lit(va.BASE64)).alias("n")).where("n > 0")


LINES_OF = "string_split(text, chr(10))"
CAPPED = f"array_to_string(list_transform({LINES_OF}[1:100000], lambda x: left(x, 4096)), chr(10))"
LONG = f"len(list_filter({LINES_OF}, lambda x: length(x) > 4096)) > 0"


@register("validator_flags", f"""select doc_id, case when strlen(text) > 5242880 then 'REJECTED' when {LONG} or len({LINES_OF}) > 100000 then 'TRUNCATED' else 'PASSED' end as status,
 length(regexp_replace(text, '[^\\p{{L}}]|[A-Za-z]', '', 'g')) > 50 as confusables, regexp_matches({CAPPED}, '[A-Za-z0-9+/]{{40,}}={{0,2}}') as base64, {LONG} as long_line, contains({CAPPED}, chr(65533)) as replaced from documents""")
def validator_flags(s, d):
    v = va.validate(table(s, d, "documents"))
    has = lambda w: F.array_contains("warnings", w)
    return v.select("doc_id", "status", has("confusables").alias("confusables"), has("base64").alias("base64"), has("line_length").alias("long_line"), has("malformed").alias("replaced"))


@register("line_caps", f"select doc_id, sha256({CAPPED}) as capped, length({CAPPED}) as n_chars from documents")
def line_caps(s, d):
    return va.validate(table(s, d, "documents")).select("doc_id", F.sha2("sanitized", 256).alias("capped"), F.length("sanitized").cast("long").alias("n_chars"))


@register("common_char", "select doc_id, round(max(n) * 1.0 / sum(n), 6) as share from (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(text, '')) as c from documents where text <> '') group by all) group by doc_id")
def common_char(s, d):
    ship(s)
    return table(s, d, "documents").where("text <> ''").select("doc_id", F.round(va.common_char_share(F.col("text")), 6).alias("share"))


SAN = "text"
for _p, _r in ((r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200b}-\x{200f}\x{feff}\x{00ad}]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"(?s)/\*.*?\*/", " [COMMENT] "), (r'(?s)""".*?"""', "[STRING_LITERAL]"), (r"(?s)'''.*?'''", "[STRING_LITERAL]"), (r'"(?:[^"\\]|\\.)*"', "[STRING_LITERAL]"), (r"'(?:[^'\\]|\\.)*'", "[STRING_LITERAL]"), (r"`(?:[^`\\]|\\.)*`", "[STRING_LITERAL]"), (r"(#|//)[^\n]*", "[COMMENT]"), (r"\b[0-9]{5,}\b", "[NUMBER]"), (r"[ \t]+", " ")):
    SAN = f"regexp_replace({SAN}, {_quoted(_p)}, {_quoted(_r)}, 'g')"


@register("sanitize_for_model", f"select doc_id, case when length(t) > 1024 then left(t, 1024) || ' [TRUNCATED]' else t end as safe from (select doc_id, array_to_string(list_filter(list_transform(string_split({SAN}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as t from documents)")
def sanitize_for_model(s, d):
    return table(s, d, "documents").select("doc_id", tx.sanitize_for_model(F.col("text")).alias("safe"))


@register("manifest_hash", "select source, count(*) as files, sum(strlen(text)) as bytes, sha256(string_agg(p, chr(10) order by p)) as hash from (select source, text, 'doc/' || doc_id || ':' || sha256(text) as p from documents) group by source")
def manifest_hash(s, d):
    t = manifest_rows(s, d)
    return fi.set_hash(t, ["source"], F.col("p")).join(t.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes")), "source")


@register("manifest_tree_hash", """select source, sum(n) as files, sha256(string_agg(h, chr(10) order by h)) as hash from (select source, count(*) as n, sha256(string_agg(p, chr(10) order by p)) as h from
 (select source, 'doc/' || doc_id || ':' || sha256(text) as p from documents) group by source, substr(sha256(p), 1, 3)) group by source""")
def manifest_tree_hash(s, d):
    t = manifest_rows(s, d)
    return fi.set_hash(t, ["source"], F.col("p"), digits=3).join(t.groupBy("source").agg(F.count(F.lit(1)).alias("files")), "source")


def manifest_rows(s, d) -> DataFrame:
    return table(s, d, "documents").withColumn("p", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)))


EDGE_NEXT = "e as (select file, substr(sha256(id || ':' || nxt || ':CFG_NEXT'), 1, 16) as edge_id from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE'))"


@register("graph_hash", f"""with {N}, {EDGE_NEXT}, a as (select file, string_agg('"' || id || '"', ', ' order by id) as ns from n group by file), b as (select file, string_agg('"' || edge_id || '"', ', ' order by edge_id) as es from e group by file)
 select file, sha256('{{"edges": [' || coalesce(es, '') || '], "nodes": [' || ns || ']}}') as graph_hash from a left join b using (file)""")
def graph_hash(s, d):
    n = sequence(s, d)
    e = gr.cfg_next(n).withColumn("edge_id", tx.edge_id(F.col("src"), F.col("dst"), F.col("edge_type")))
    return fi.graph_hash(n, e, "file")


@register("graph_metrics", f"""with {N}, x as (select file, count(*) as nodes, count(nxt) filter (where t not in ('RETURN','BREAK','CONTINUE','RAISE')) as edges from p group by file)
 select file, nodes, edges, case when nodes > 1 then round(edges / (nodes * (nodes - 1) / 2), 6) else 0.0 end as density from x""")
def graph_metrics(s, d):
    n = sequence(s, d)
    e = gr.cfg_next(n).groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    c = n.groupBy("file").agg(F.count(F.lit(1)).alias("nodes")).join(e, "file", "left").fillna(0, ["edges"])
    return c.select("file", "nodes", "edges", fi.density(F.col("nodes"), F.col("edges")).alias("density"))


@register("hotspots", f"with {N}, e as (select id as src, nxt as dst from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE')), x as (select src as id from e union all select dst from e) select id, count(*) as degree from x group by id having count(*) >= 2")
def hotspots(s, d):
    return fi.hotspots(gr.cfg_next(sequence(s, d)), 2)


FOUND = f"""f as (select file_path, line, vuln_type, cwe, severity, case severity when 'HIGH' then 0.9 when 'MEDIUM' then 0.6 else 0.3 end as confidence from (with {BOTH}, {LINES}, c(vuln_type, cwe, severity, pattern) as (values {CATALOG_SQL}) select * from lines, c where regexp_matches(content, pattern)))"""


def found(s, d) -> DataFrame:
    hits = no.pattern_hits(documents(s, d).unionByName(pages(s, d)), dims.frame(s, "catalog"))
    return hits.withColumn("confidence", F.when(F.col("severity") == "HIGH", 0.9).when(F.col("severity") == "MEDIUM", 0.6).otherwise(0.3))


@register("cwe_topk", f"with {FOUND} select cwe, count(*) as n, round(avg(confidence), 3) as confidence_avg from f group by cwe order by n desc, cwe limit 10")
def cwe_topk(s, d):
    return fi.cwe_counts(found(s, d), 10)


@register("severity_counts", f"with {FOUND} select count(*) filter (where severity = 'HIGH') as high_severity, count(*) filter (where severity = 'MEDIUM') as medium_severity, count(*) filter (where severity = 'LOW') as low_severity, count(*) as finding_count from f")
def severity_counts(s, d):
    return fi.severity_counts(found(s, d))


CASE_CWE = "case " + " ".join(f"when regexp_matches(raw_text, {_quoted(p)}) then {_quoted(cwe)}" for p, _, cwe in dims.CALL_PATTERNS) + " else '' end"


@register("security_summary", f"""with {BOTH}, {LINES}, {NODES}, c as (select file_path, substr(sha256(file_path || ':' || line || ':' || col || ':' || node_type), 1, 16) as node_id, {CASE_LABEL} as label, {CASE_CWE} as cwe from fb where node_type = 'CALL'),
 m as (select file_path, string_agg(cwe || '=' || ids, ';' order by cwe) as cwes from (select file_path, cwe, string_agg(node_id, ',' order by node_id) as ids from c where cwe <> '' group by all) group by file_path)
 select c.file_path, coalesce(string_agg(node_id, ',' order by node_id) filter (where label = 'SOURCE'), '') as source, coalesce(string_agg(node_id, ',' order by node_id) filter (where label = 'SINK'), '') as sink, '' as sanitizer, '' as sensitive,
 count(distinct cwe) filter (where cwe <> '') as n_cwes, coalesce(any_value(m.cwes), '') as cwes from c left join m on m.file_path = c.file_path group by c.file_path""")
def security_summary(s, d):
    label, cwe = no.classify_call(F.col("raw_text"))
    return fi.security_summary(both_nodes(s, d).where("node_type = 'CALL'").withColumns({"label": label, "cwe": cwe}))


@register("detection_metrics", """with j as (select source, toxic = 1 as truth, contains(lower(text), 'idiot') or contains(lower(text), 'moron') as predicted from documents join labels using (doc_id)),
 c as (select source, count(*) filter (where truth and predicted) as tp, count(*) filter (where not truth and predicted) as fp, count(*) filter (where truth and not predicted) as fn, count(*) filter (where not truth and not predicted) as tn from j group by source),
 r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as r from c)
 select source, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 4) as f1, round(case when fp + tn = 0 then 0.0 else fp / (fp + tn) end, 4) as false_positive_rate from r""")
def detection_metrics(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    low = F.lower("text")
    return fi.detection_metrics(j.select("source", (F.col("toxic") == 1).alias("truth"), (low.contains("idiot") | low.contains("moron")).alias("predicted")), "source")


@register("url_validate", r"""select page_id, case when scheme not in ('http', 'https') then 'scheme' when host = '' then 'no_host' when not regexp_matches(branch, '^[a-zA-Z0-9_\-./]+$') then 'branch' end as rule from
 (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) as branch from pages)""")
def url_validate(s, d):
    branch = F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1)
    rule = ig.validate_request(F.col("url"), branch, F.lit(None).cast("string"), F.lit(1), F.lit("ref"), schemes=("http", "https"))
    return table(s, d, "pages").select("page_id", rule.alias("rule"))


IPS = "select doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) as ip from documents"


@register("ssrf", f"""select doc_id, ip, coalesce(({' or '.join(f'n between {a} and {b}' for a, b in ig.BLOCKED_V4)}), false) as blocked from (select doc_id, ip,
 case when len(list_filter(string_split(ip, '.'), lambda x: cast(x as int) > 255 or (length(x) > 1 and x[1] = '0'))) = 0 then cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint) end as n from ({IPS}))""")
def ssrf(s, d):
    ip = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"), F.lit(1)))
    return table(s, d, "documents").select("doc_id", ip.alias("ip")).select("doc_id", "ip", ig.ssrf_blocked(F.col("ip")).alias("blocked"))


@register("redact", "select page_id, left(regexp_replace(u, '(https?://)[^@\\s/]+@', '\\1[REDACTED]@', 'g'), 500) as safe from (select page_id, replace(url, '://', '://user:' || page_id || '@') as u from pages)")
def redact(s, d):
    u = F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user:"), F.col("page_id").cast("string"), F.lit("@")))
    return table(s, d, "pages").select("page_id", tx.redact(u).alias("safe"))


@register("provider_match", """select provider, owner, count(*) as n from (select k.provider, case k.n when 4 then '' else split_part(split_part(url, '://', 2), '/', 2) end as owner from pages join (values (0, 'github'), (1, 'gitlab'), (2, 'bitbucket'), (3, 'azure'), (4, 'none')) k(n, provider) on page_id % 5 = k.n) group by all""")
def provider_match(s, d):
    hosts = F.array(*map(F.lit, ("https://github.com/", "https://gitlab.com/", "https://bitbucket.org/", "https://dev.azure.com/")))
    owner = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2))
    k = (F.col("page_id") % 5).cast("int")
    url = F.when(k == 4, "https://h.example/").otherwise(F.concat(F.try_element_at(hosts, k + 1), owner, F.lit("/repo.git")))
    return table(s, d, "pages").select(ig.provider(url).alias("provider"), ig.owner_repo(url)[0].alias("owner")).groupBy("provider", "owner").agg(F.count(F.lit(1)).alias("n"))


@register("rate_limit_low", "select s_suppkey, s_acctbal / 10 < greatest(10.0, 10000 * 0.05) as low from supplier")
def rate_limit_low(s, d):
    return table(s, d, "supplier").select("s_suppkey", ig.rate_limit_low(F.col("s_acctbal") / 10, F.lit(10000.0)).alias("low"))


@register("merge_primary", "select doc_id, case when lang = 'en' or source <> 'src0' then 'primary' else 'secondary' end as origin, length(text) as n from documents")
def merge_primary(s, d):
    """Every document is in one side or both: the overlap are the English documents of the first source."""
    t = table(s, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))
    primary, secondary = t.where("lang = 'en' or source <> 'src0'"), t.where("source = 'src0'")
    return gr.merge_results(primary.withColumn("origin", F.lit("primary")), secondary.withColumn("origin", F.lit("secondary")), ["doc_id"]).select("doc_id", "origin", "n")


def sarif_fixture(s, d) -> tuple[DataFrame, DataFrame]:
    """Reports of one result per event of two types, over the A-seq nodes."""
    n = sequence(s, d)
    rule = F.when(F.col("ord") % 2 == 0, "py/sql-injection").otherwise("x/unknown")
    location = lambda line, col: F.struct(F.struct(F.struct(F.concat(F.lit("./"), F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(line.cast("int").alias("startLine"), (col + 1).cast("int").alias("startColumn")).alias("region")).alias("physicalLocation"))
    r = n.where("t = 'CALL'").select("ord", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(rule.alias("ruleId"), F.lit("error").alias("level"), F.array(location(F.col("line"), F.col("ord") % 2)).alias("locations"), F.array(location(F.col("line") - 1, F.lit(0))).alias("relatedLocations"))).alias("results"))).alias("runs"))).alias("json"))
    results = rd.sarif_results(r).join(n.select("file", "line", F.col("ord").alias("_o")), ["file", "line"], "left").withColumn("result_ord", F.coalesce("_o", F.lit(-1))).drop("_o")
    return results, n


@register("sarif_matches", f"with {N} select rule_id, case when ord % 2 = 0 then 'exact' else 'line' end as matched, count(*) as n from (select ord, case when ord % 2 = 0 then 'py/sql-injection' else 'x/unknown' end as rule_id from n where t = 'CALL') group by all")
def sarif_matches(s, d):
    results, n = sarif_fixture(s, d)
    return fi.sarif_matches(results, n).groupBy("rule_id", "matched").agg(F.count(F.lit(1)).alias("n"))


@register("sarif_annotate", f"with {N} select id as node_id, 'SINK' as label, case when ord % 2 = 0 then 'CWE-89' else '' end as cwe, case when ord % 2 = 0 then 'py/sql-injection' else 'x/unknown' end as rule_id from n where t = 'CALL'")
def sarif_annotate(s, d):
    results, n = sarif_fixture(s, d)
    return fi.sarif_annotate(results, n, dims.frame(s, "sarif_rules"))


@register("sarif_edges", f"with {N} select id as src, id as dst, 'TAINT_SINK' as edge_type from n where t = 'CALL' union all select r.id, c.id, 'TAINT_SOURCE' from n c join n r on r.file = c.file and r.line = c.line - 1 where c.t = 'CALL'")
def sarif_edges(s, d):
    return fi.sarif_edges(*sarif_fixture(s, d))


@register("submodule_tree", """select r_name as root, n_name as url, n_nationkey as sha, cast(1 as int) as depth, 'resolved' as status from nation join region on n_regionkey = r_regionkey
 union all select r_name, 'https://h/' || s_suppkey, s_suppkey, 2, case when s_suppkey % 5 = 0 then 'unpinned' else 'resolved' end from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def submodule_tree(s, d):
    region, nation, supplier = (table(s, d, x) for x in ("region", "nation", "supplier"))
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("https://r/"), "r_name").alias("parent_url"), F.concat(F.lit("https://n/"), "n_name").alias("url"), F.col("n_nationkey").cast("string").alias("sha"), F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("path"))
    second = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("https://n/"), "n_name").alias("parent_url"), F.concat(F.lit("https://h/"), F.col("s_suppkey").cast("string")).alias("url"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey").cast("string")).alias("sha"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("path"))
    out = ig.resolve_submodules(region.select(F.concat(F.lit("https://r/"), "r_name").alias("url")), first.unionByName(second), max_total=1_000_000)
    key = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    return out.select(F.regexp_replace("root", "^https://r/", "").alias("root"), F.regexp_replace("url", "^https://n/", "").alias("url"), key.alias("sha"), "depth", "status")


# Written down apart from the dimension: each class under its parent.
FAMILIES = {
    "PipelineError": "IngestionError GraphBuildError VaultError",
    "IngestionError": "CredentialError TransportError AuthenticationError RepositoryError IntegrityError ValidationError SubmoduleError SandboxError AdapterError",
    "CredentialError": "CredentialNotFoundError CredentialExpiredError CredentialZeroingError",
    "TransportError": "TLSVerificationError SSRFBlockedError FetchTimeoutError",
    "AuthenticationError": "TokenRevokedError",
    "RepositoryError": "CommitNotFoundError BranchNotFoundError CommitMismatchError",
    "IntegrityError": "SymlinkEscapeError ManifestSealError CopyIntegrityError",
    "ValidationError": "URLValidationError BranchNameError CommitSHAError",
    "SubmoduleError": "SubmoduleURLError SubmoduleDepthError SubmoduleCommitError",
    "SandboxError": "PathPolicyViolation DeliveryError",
    "AdapterError": "RateLimitError PermissionDeniedError RepositoryNotFoundError",
    "GraphBuildError": "ParserUnavailableError ASTBuildError CFGBuildError DFGBuildError CPGAssemblyError Neo4jWriteError SARIFParseError TokenizationError",
    "VaultError": "VaultUnavailableError VaultAuthError VaultSecretNotFoundError",
}
ERR = ", ".join(f"('{c}', '{p}')" for p, names in FAMILIES.items() for c in names.split())


@register("error_closure", f"with recursive e(class, parent) as (values {ERR}), up(class, ancestor, distance) as (select class, parent, 1 from e union all select up.class, e.parent, distance + 1 from up join e on e.class = up.ancestor) select * from up")
def error_closure(s, d):
    return gr.ancestors(dims.frame(s, "errors"), "class", "parent")


@register("taint_paths", f"""with recursive {N}, e as (select distinct src, dst from (select df as src, id as dst from (select *, last_value(case when {DEFS} then id end ignore nulls) over (partition by file, name order by pos rows between unbounded preceding and 1 preceding) as df from p) where df is not null and t in ('IDENTIFIER','MEMBER_ACCESS') and length(name) > 1
 union all select b, id from (select *, lag(id) over (partition by file, name order by pos) as b from p where {DEFS}) where b is not null and t <> 'PARAM')),
 l as (select id, case when t = 'PARAM' then 'SOURCE' when t = 'MEMBER_ACCESS' then 'SINK' when t = 'AUGMENTED_ASSIGN' then 'SANITIZER' else 'NONE' end as label from n),
 r(source, here, depth, path) as (select id, id, 0, [id] from l where label = 'SOURCE' union all select r.source, e.dst, r.depth + 1, list_append(r.path, e.dst) from r join e on e.src = r.here join l on l.id = e.dst where l.label <> 'SANITIZER' and not list_contains(r.path, e.dst))
 select source, here as sink, depth, array_to_string(path, '>') as path from r join l on l.id = r.here where l.label = 'SINK' and depth > 0""")
def taint_paths(s, d):
    n = sequence(s, d)
    label = F.when(F.col("t") == "PARAM", "SOURCE").when(F.col("t") == "MEMBER_ACCESS", "SINK").when(F.col("t") == "AUGMENTED_ASSIGN", "SANITIZER").otherwise("NONE")
    return gr.taint_paths(n.withColumn("label", label), gr.dfg_flows(n).unionByName(gr.dfg_kills(n)))


@register("taint_reach", SQL["taint_paths"].split("select source, here as sink")[0] + "select source, here as sink, min(depth) as depth from r join l on l.id = r.here where l.label = 'SINK' and depth > 0 group by all")
def taint_reach(s, d):
    n = sequence(s, d)
    label = F.when(F.col("t") == "PARAM", "SOURCE").when(F.col("t") == "MEMBER_ACCESS", "SINK").when(F.col("t") == "AUGMENTED_ASSIGN", "SANITIZER").otherwise("NONE")
    return gr.taint_reach(n.withColumn("label", label), gr.dfg_flows(n).unionByName(gr.dfg_kills(n)))


STATUS = "select user_id as session_id, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'error') as n_error, count(*) filter (where event_type = 'purchase') as n_purchase, arg_max(event_type, event_id) as latest, count(*) as n_events from events group by user_id"


def session_events(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))


@register("status_rollup", STATUS)
def status_rollup(s, d):
    return ev.status_rollup(session_events(table(s, d, "events")), ("click", "error", "purchase"))


@register("streaming_status", STATUS)
def streaming_status(s, d):
    path = f"{d}/event[s].parquet"  # a stream reads a folder or a pattern: the table may be a file or a folder
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(path)
    return ev.run_now(ev.status_rollup(session_events(stream), ("click", "error", "purchase")))


@register("change_events", "select user_id as session_id, event_id as seq, event_type as type from (select *, lag(event_type) over (partition by user_id order by event_id) as b from events) where event_type is distinct from b")
def change_events(s, d):
    return ev.changed(session_events(table(s, d, "events")), "type")


@register("protocol_check", """with e as (select conv_id, turn, role, case role when 'system' then 1 when 'user' then 2 when 'assistant' then 3 else 0 end as p from conversations),
 x as (select *, row_number() over w as n, max(p) over (partition by conv_id order by turn, role rows between unbounded preceding and 1 preceding) as high, max(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn, role rows between unbounded preceding and 1 preceding) as done from e window w as (partition by conv_id order by turn, role))
 select rule, count(*) as n from (select case when n = 1 and p <> 1 then 'starts_late' when done = 1 then 'after_complete' when p > 0 and p < high then 'out_of_order' end as rule from x) where rule is not null group by rule""")
def protocol_check(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.struct("turn", "role").alias("seq"), F.col("role").alias("type"))
    return ev.protocol_violations(c, ["system", "user", "assistant"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("review_state", "select user_id as session_id, case when count(*) filter (where event_type = 'error') = 0 then 'not_reached' when count(*) filter (where event_type = 'purchase') = 0 then 'waiting' when arg_max(value, event_id) filter (where event_type = 'purchase') > 20 then 'approved' else 'rejected' end as state from events group by user_id")
def review_state(s, d):
    e = table(s, d, "events")
    sessions = e.groupBy(F.col("user_id").alias("session_id")).agg((F.count_if(F.col("event_type") == "error") > 0).alias("reached"))
    return fi.review_state(sessions, e.where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("approved")))


@register("review_summary", f"""with {FOUND}, g as (select *, file_path || ':' || line || ':' || vuln_type as node_id, split_part(file_path, '/', 1) as session from f), r as (select *, row_number() over (partition by session order by confidence desc, node_id) as rn from g)
 select session, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low, string_agg(node_id, ',' order by rn) filter (where rn <= 5) as preview from r group by session""")
def review_summary(s, d):
    g = found(s, d).select("*", F.concat_ws(":", "file_path", F.col("line").cast("string"), "vuln_type").alias("node_id"), F.substring_index("file_path", "/", 1).alias("session"), F.lit("SINK").alias("label"))
    return fi.review_summary(g, "session")


@register("token_sequence", """with w as (select doc_id, i as ord, list_filter(regexp_split_to_array(l[i], '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from (select doc_id, l, unnest(generate_series(1, len(l))) as i from (select doc_id, string_split(text, chr(10)) as l from documents))),
 k as (select doc_id, ord, case when len(ws) > 0 then ws[1:4] else ['[EMPTY]'] end as ws from w), c as (select *, coalesce(sum(len(ws)) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as b from k)
 select 'doc/' || doc_id as file_path, cast(b + i - 1 as bigint) as pos, ws[i] as token from (select *, unnest(generate_series(1, len(ws))) as i from c) where b + i - 1 < 512""")
def token_sequence(s, d):
    n = no.lines(documents(s, d)).select("file_path", F.col("line").alias("ord"), F.col("line").alias("node_id"), F.col("content").alias("raw_text"))
    return no.token_sequence(n).select("file_path", "pos", "token")


@register("viewer_caps", f"""with {N}, r as (select *, row_number() over (partition by file order by line, col, ord, id) as rn from n), e as (select file, id as src, nxt as dst, 'CFG_NEXT' as edge_type from p where nxt is not null and t not in ('RETURN','BREAK','CONTINUE','RAISE')),
 k as (select e.*, row_number() over (partition by e.file order by src, dst, edge_type) as rn from e join r a on a.id = e.src and a.rn <= 40 join r b on b.id = e.dst and b.rn <= 40)
 select file, src, dst, edge_type from k where rn <= 30""")
def viewer_caps(s, d):
    n = sequence(s, d)
    return gr.viewer_cap(n, gr.cfg_next(n), 40, 30)[1]


@register("name_extract", r"""select name, lower(name) as low, regexp_extract(name, '([^.]*)$', 1) as last, regexp_extract(name, '([A-Za-z_][A-Za-z0-9_]*)', 1) as base, coalesce(list_last(regexp_extract_all(regexp_replace(split_part(name || ': str = 1', '=', 1), '\s*:.*$', ''), '([A-Za-z_][A-Za-z0-9_]*)', 1)), '') as assigned from (""" + NAMES + ")")
def name_extract(s, d):
    v = tx.name_variants(F.col("name"))
    return words(s, d).select("name", F.lower("name").alias("low"), F.substring_index("name", ".", -1).alias("last"), tx.member_base(F.col("name")).alias("base"), tx.assigned_name(F.concat("name", F.lit(": str = 1"))).alias("assigned")).where(F.size(v) > 0)


@register("language_detect", """select case when regexp_matches(url, '\\.html?$') then 'html_like' else 'other' end as kind, language, count(*) as n from (select url, case regexp_extract(u, '[^/]\\.([^./]+)$', 1) when 'py' then 'python' when 'js' then 'javascript' when 'go' then 'go' else 'unknown' end as language from
 (select url, regexp_replace(url, '[?#].*$', '') || (['.py', '.js', '.go', ''])[cast(page_id % 4 as int) + 1] as u from pages)) group by all""")
def language_detect(s, d):
    u = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(F.array(F.lit(".py"), F.lit(".js"), F.lit(".go"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))
    language = no.detect_language(u, F.lit(""))[0]
    kind = F.when(F.col("url").rlike(r"\.html?$"), "html_like").otherwise("other")
    return table(s, d, "pages").select(kind.alias("kind"), language.alias("language")).groupBy("kind", "language").agg(F.count(F.lit(1)).alias("n"))


@register("delivery_check", "select 'doc/' || doc_id as relative_path, case when doc_id % 7 = 0 then 'missing' when doc_id % 5 = 0 then 'tampered' else 'ok' end as status from documents")
def delivery_check(s, d):
    m = documents(s, d).select(F.col("file_path").alias("relative_path"), F.sha2("text", 256).alias("sha256"))
    key = F.substring_index("relative_path", "/", -1).cast("long")
    got = m.where(key % 7 != 0).withColumn("sha256", F.when(key % 5 == 0, "x").otherwise(F.col("sha256")))
    return ig.verify_delivery(m, got)


@register("darken", "select p_partkey, '#' || lpad(lower(printf('%x', greatest(0, r - 40))), 2, '0') || '2828' as dark from (select p_partkey, p_size * 4 as r from part)")
def darken(s, d):
    c = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_size") * 4), 2, "0"), F.lit("5050"))
    return table(s, d, "part").select("p_partkey", tx.darken(c).alias("dark"))


@register("scale_cfg", """with p as (select l_orderkey, l_linenumber, l_returnflag, lead(l_linenumber) over w as nxt, last_value(case when l_linestatus = 'O' then l_linenumber end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding) as lp from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))
 select l_returnflag, count(nxt) as next_edges, count(lp) as loop_edges from p group by l_returnflag""")
def scale_cfg(s, d):
    """lead and latest-of-kind over lineitem: the control-flow windows at the largest table's scale."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = table(s, d, "lineitem").withColumn("nxt", F.lead("l_linenumber").over(w)).withColumn("lp", F.last(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return t.groupBy("l_returnflag").agg(F.count("nxt").alias("next_edges"), F.count("lp").alias("loop_edges"))


def _case(table: dict[str, str], key: str, default: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{default}' end"


LABEL = "case when t = 'PARAM' then 'SOURCE' when t = 'CALL' then 'SINK' when t = 'TRY' then 'SANITIZER' else 'NONE' end"


@register("viewer_nodes", f"""with {N}, l as (select *, {LABEL} as security from n), c as (select *, {_case(se.LABEL_COLOURS, 'security', '#6b7280')} as colour from l)
 select id, name || chr(10) || '(' || t || ')' as label, file || ':' || line as title, colour, case security when 'NONE' then 'dot' else 'diamond' end as shape, case security when 'NONE' then 8 else 14 end as size,
 '#' || lpad(printf('%x', greatest(0, cast('0x' || substr(colour, 2, 2) as int) - 40)), 2, '0') || lpad(printf('%x', greatest(0, cast('0x' || substr(colour, 4, 2) as int) - 40)), 2, '0') || lpad(printf('%x', greatest(0, cast('0x' || substr(colour, 6, 2) as int) - 40)), 2, '0') as border from c""")
def viewer_nodes(s, d):
    n = sequence(s, d)
    label = F.when(F.col("t") == "PARAM", "SOURCE").when(F.col("t") == "CALL", "SINK").when(F.col("t") == "TRY", "SANITIZER").otherwise("NONE")
    v = n.select("id", se.viewer_node(F.col("t"), label, F.col("name"), F.col("file"), F.col("line"), F.lit("")).alias("v"))
    return v.select("id", "v.label", "v.title", "v.colour", "v.shape", "v.size", "v.border")


@register("viewer_edges", f"""with {N}, e as (select id as src, nxt as dst, case t when 'ASSIGN' then 'DFG_FLOW' when 'CALL' then 'TAINT_SINK' when 'TRY' then 'OTHER' else 'CFG_NEXT' end as edge_type from p where nxt is not null)
 select edge_type, {_case(se.EDGE_COLOURS, 'edge_type', '#94a3b8')} as colour, case when contains(edge_type, 'DFG') or contains(edge_type, 'TAINT') then 2 else 1 end as width, contains(edge_type, 'CFG') as dashes, count(*) as n from e group by all""")
def viewer_edges(s, d):
    w = Window.partitionBy("file").orderBy(*gr.POSITION)
    kind = F.when(F.col("t") == "ASSIGN", "DFG_FLOW").when(F.col("t") == "CALL", "TAINT_SINK").when(F.col("t") == "TRY", "OTHER").otherwise("CFG_NEXT")
    e = sequence(s, d).withColumn("nxt", F.lead("id").over(w)).where("nxt is not null").select(kind.alias("edge_type"))
    counted = e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("edge_type", "n", se.viewer_edge(F.col("edge_type")).alias("v")).select("edge_type", "v.colour", "v.width", "v.dashes", "n")


@register("token_types", "select case p_size % 5 when 0 then 'classic_pat' when 1 then 'fine_grained_pat' when 2 then 'github_app' when 3 then 'oauth' else 'unknown' end as token_type, count(*) as n from part group by all")
def token_types(s, d):
    token = F.concat(F.element_at(F.array(*map(F.lit, ("ghp_", "github_pat_", "ghs_", "gho_", "x_"))), F.col("p_size") % 5 + 1), F.col("p_name"))
    return table(s, d, "part").select(se.token_type(token).alias("token_type")).groupBy("token_type").agg(F.count(F.lit(1)).alias("n"))


@register("environment_policy", "select k, count(*) as n, count(*) filter (where k in ('JAVA_HOME', 'GOPATH') and user_id % 3 <> 0) as allowed from (select case event_type when 'click' then 'JAVA_HOME' when 'view' then 'GOPATH' else upper(event_type) end as k, user_id from events) group by k")
def environment_policy(s, d):
    e = table(s, d, "events")
    key = F.when(F.col("event_type") == "click", "JAVA_HOME").when(F.col("event_type") == "view", "GOPATH").otherwise(F.upper("event_type"))
    value = F.when(F.col("user_id") % 3 == 0, "a\nb").otherwise("ok")
    return e.select(key.alias("k"), se.environment_allowed(key, value).alias("ok")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("allowed"))


@register("scopes", "select user_id, len(list_filter(['click', 'purchase'], lambda x: not list_contains(g, x))) = 0 as enough from (select user_id, list(distinct event_type) as g from events where value > 30 group by user_id)")
def scopes(s, d):
    granted = table(s, d, "events").where("value > 30").groupBy("user_id").agg(F.collect_set("event_type").alias("g"))
    return granted.select("user_id", se.scopes_suffice(F.array(F.lit("click"), F.lit("purchase")), F.col("g")).alias("enough"))


@register("tools_ready", "select p_brand, count(*) filter (where p_size > 25 and p_retailprice < 1000) = 0 as ready, coalesce(string_agg(distinct p_name, ',' order by p_name) filter (where p_size > 25 and p_retailprice < 1000), '') as failing from part group by p_brand")
def tools_ready(s, d):
    return se.tools_ready(table(s, d, "part").select("p_brand", F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("required"), (F.col("p_retailprice") >= 1000).alias("available")), "p_brand")


@register("http_errors", """select status, remaining, case when status = 401 then 'AuthError' when status = 403 and remaining = 0 then 'RateLimitError' when status = 429 then 'RateLimitError' when status = 403 then 'AuthError' when status = 404 then 'NotFoundError' when status >= 500 then 'ServerError' when status >= 400 then 'FetchError' end as error, count(*) as n
 from (select ([200, 401, 403, 404, 422, 429, 500])[cast(p_partkey % 7 as int) + 1] as status, p_size % 2 as remaining from part) group by all""")
def http_errors(s, d):
    t = table(s, d, "part").select(F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 422, 429, 500))), (F.col("p_partkey") % 7 + 1).cast("int")).alias("status"), (F.col("p_size") % 2).alias("remaining"))
    return t.groupBy("status", "remaining").agg(F.count(F.lit(1)).alias("n")).withColumn("error", ig.http_error(F.col("status"), F.col("remaining")))


@register("rate_limit_headers", "select s_suppkey, case when s_suppkey % 4 = 0 then null else s_suppkey end as remaining, cast(5000 as bigint) as quota from supplier")
def rate_limit_headers(s, d):
    left = F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.col("s_suppkey").cast("string"))
    h = se.rate_limit(F.create_map(F.lit("x-ratelimit-limit"), F.lit("5000"), F.lit("x-ratelimit-remaining"), left))
    return table(s, d, "supplier").select("s_suppkey", h.alias("h")).select("s_suppkey", "h.remaining", F.col("h.limit").alias("quota"))


@register("last_stage", "select user_id as session_id, arg_max(event_type, event_id) as stage, case when arg_max(value, event_id) > 10 then 'ok' else 'failed' end as status, round(sum(value), 2) as latency_ms from events group by user_id")
def last_stage(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.when(F.col("value") > 10, "ok").otherwise("failed").alias("status"), F.col("value").alias("latency_ms"))
    return se.last_stage(e).withColumn("latency_ms", F.round("latency_ms", 2))


@register("node_children", "select 'e' || a.event_id as parent, 'e' || b.event_id as child from events a join events b on b.event_id in (a.event_id * 2, a.event_id * 2 + 1) where a.event_id > 0")
def node_children(s, d):
    e = table(s, d, "events").where("event_id > 0")
    kids = F.transform(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1), lambda x: F.concat(F.lit("e"), x.cast("string")))
    return se.children(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), kids.alias("children_ids")))


@register("unsanitized_hits", f"with {FOUND} select file_path, line, vuln_type from f where not exists (select 1 from labels l where l.quality = 0 and f.file_path = 'page/' || l.doc_id)")
def unsanitized_hits(s, d):
    clean = table(s, d, "labels").where("quality = 0").select(F.concat(F.lit("page/"), F.col("doc_id").cast("string")).alias("file_path"))
    return se.unsanitized(found(s, d), clean, ["file_path"]).select("file_path", "line", "vuln_type")


@register("iac_conditionals", f"""with {N}, c as (select * from n where t = 'IF'), r as (select c.file, c.id as src, n.id as dst, row_number() over (partition by c.file, c.id order by n.ord) as rn, count(*) over (partition by c.file, c.id) as m from c join n on n.file = c.file and n.line > c.line and n.line <= c.end_line)
 select file, src, dst, case rn when 1 then 'CFG_TRUE' else 'CFG_FALSE' end as edge_type from r where rn <= 2 and m >= 2""")
def iac_conditionals(s, d):
    return se.conditional_branches(sequence(s, d).withColumn("t", F.when(F.col("t") == "IF", "CONDITIONAL").otherwise(F.col("t"))))


@register("pinned_submodules", "select s_name as path, case when o is null then 'skipped' else 'pinned' end as status, o as pinned_sha from supplier left join (select n_nationkey, sha256(n_name) as o from nation where n_nationkey % 2 = 0) on s_nationkey = n_nationkey and s_suppkey % 3 = 0")
def pinned_submodules(s, d):
    entries = table(s, d, "supplier").select(F.col("s_name").alias("path"), "s_nationkey", "s_suppkey")
    links = entries.where("s_suppkey % 3 = 0").join(table(s, d, "nation").where("n_nationkey % 2 = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select("path", F.sha2("n_name", 256).alias("sha"))
    return se.pinned(entries.select("path"), links).select("path", "status", "pinned_sha")


@register("submodule_counts", "select r_name as root, count(*) filter (where not (lvl = 2 and s_suppkey % 5 = 0)) as resolved, count(*) filter (where lvl = 2 and s_suppkey % 5 = 0) as unpinned, count(*) filter (where lvl = 2 and s_suppkey % 5 = 0) > 0 as blind_spot from (select r_name, 1 as lvl, null as s_suppkey from nation join region on n_regionkey = r_regionkey union all select r_name, 2, s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) group by r_name")
def submodule_counts(s, d):
    return se.submodule_counts(submodule_tree(s, d)).select("root", "resolved", "unpinned", "blind_spot")


@register("graph_limits", f"with {N}, x as (select file, count(*) as n_nodes, max(line % 50) as depth, count(nxt) filter (where t not in ('RETURN','BREAK','CONTINUE','RAISE')) as n_edges from p group by file) select *, n_nodes > 70 or n_edges > 60 or depth > 48 as tripped from x")
def graph_limits(s, d):
    n = sequence(s, d)
    return va.graph_limits(n.withColumn("depth", F.col("line") % 50), gr.cfg_next(n), 70, 60, 48)


@register("primary_language", "select case lang when 'en' then 'english' else lang end as language, count(*) as n from documents where lang not in ('xx') group by all order by n desc, min(doc_id) limit 1")
def primary_language(s, d):
    return fi.primary_language(table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "english").otherwise(F.col("lang")).alias("language")), ("xx",), seen="doc_id")


@register("build_rollup", "select count(*) as files, count(*) filter (where n_chars >= 500 and source <> 'src3') as processed, count(*) filter (where n_chars < 500) as skipped, count(*) filter (where n_chars >= 500 and source = 'src3') as error, (select string_agg(distinct lang, ',' order by lang) from documents where n_chars >= 500 and source <> 'src3') as languages, (select count(*) from events) as nodes from documents")
def build_rollup(s, d):
    status = F.when(F.col("n_chars") < 500, "skipped").when(F.col("source") == "src3", "error").otherwise("processed")
    return fi.build_rollup(table(s, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("lang").alias("language"), status.alias("status")), table(s, d, "events"))


@register("findings_ranked", f"with {ANNOTATED}, k(cwe, cwe_name, cwe_severity) as (values {', '.join(str(r) for r in dims.CWES)}) select a.name, b.label as label, b.cwe as cwe, round(b.confidence, 2) as confidence, coalesce(cwe_severity, case b.label when 'SINK' then 'HIGH' else 'MEDIUM' end) as severity, coalesce(cwe_name, 'Unclassified') as title from a left join k on k.cwe = b.cwe where b.label in ('SINK', 'SENSITIVE') and b.confidence >= 0.3")
def findings_ranked(s, d):
    return fi.findings(annotated(s, d), dims.frame(s, "cwes")).select("name", "label", "cwe", "confidence", "severity", "title")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Nodes of documents and pages by type and label, with the number of files and of secrets found in them."""
    nodes = both_nodes(s, d).withColumn("label", F.when(F.col("node_type") == "CALL", no.classify_call(F.col("raw_text"))[0]).otherwise("NONE"))
    secrets = hardcoded_secret(s, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("secrets"))
    return nodes.join(secrets, "file_path", "left").groupBy("node_type", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"), F.coalesce(F.sum("secrets"), F.lit(0)).alias("secrets"))


from . import flows, live, rules, stores, structure  # noqa: E402,F401  register their queries here
