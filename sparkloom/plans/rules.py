"""Registered queries of operators that the driver's tables have no rows for: small literal inputs that break each rule, and what must come out.

The SQL states the expected rows themselves, written down apart from the operators.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims, text as tx
from ..operators import annotate as an, findings as fi, graph as gr, ingestion as ig, nodes as no, sessions as se, validate as va
from ..sources import readers as rd, writers as wr
from ..streaming import events as ev
from .queries import register, sequence, session_events, table


def values(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "null"
    return ("true" if v else "false") if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> str:
    """SQL that gives these rows; columns are name type, name type, ..."""
    named = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select {', '.join(f'cast({n} as {t}) as {n}' for n, t in named)} from (values {body}) v({', '.join(n for n, _ in named)})"


def dealt(s: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """The cases by turns over all events: event_id and the columns of case event_id % len(rows), so that each rule meets as many rows as there are events."""
    cases = s.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_case long, {schema}")
    return table(s, d, "events").select("event_id", (F.col("event_id") % len(rows)).alias("_case")).join(cases, "_case").drop("_case")


def dealt_sql(columns: str, *rows: tuple) -> str:
    """SQL that gives what is expected of each case, by turns over all events."""
    return f"select e.event_id, v.* exclude (_case) from events e join ({expected(f'_case bigint, {columns}', *((k, *r) for k, r in enumerate(rows)))}) v on e.event_id % {len(rows)} = v._case"


@register("validator_gates", dealt_sql(
    "id int, status varchar, warnings varchar, sanitized varchar",
    (1, "PASSED", "", "plain text = 1"), (2, "PASSED", "null_bytes", "ab"), (3, "PASSED", "bidi", "ab"), (4, "PASSED", "zero_width", "ab"), (5, "TRUNCATED", "line_count", "a\nb\nc"), (6, "TRUNCATED", "line_length", "0123456789" * 2),
    (7, "PASSED", "nfkc", "file 5"), (8, "PASSED", "separators", "a\nb c"), (9, "PASSED", "malformed", "a�b"), (10, "PASSED", "nfkc", "a b c"), (11, "PASSED", "odd_spaces", "a b c"),
    (12, "PASSED", "dominating_char", "aaaaaaaaaaaaaaaaaaab"), (13, "PASSED", "nested_quantifier", 'x = "(a+)+"'), (14, "PASSED", "shebangs", "#!/bin/a\n#!/bin/b"), (15, "PASSED", "", "#!/bin/py\n# coding: x"),
    (16, "PASSED", "encodings", "# coding: x\n# encoding: y"), (17, "REJECTED", "too_large,line_count,line_length", ""), (18, "PASSED", "", ""),
))
def validator_gates(s, d):
    texts = [
        "plain text = 1", "a\x00b", "a‮b", "a​b", "a\nb\nc\nd", "0123456789" * 3, "ﬁle ５", "a b c", "a�b", "a b c", "a b c",
        "a" * 19 + "b", 'x = "(a+)+"', "#!/bin/a\n#!/bin/b", "#!/bin/py\n# coding: x", "# coding: x\n# encoding: y", "0123456789 " * 20 + "\n\n\n\n", None,
    ]
    v = va.validate(dealt(s, d, list(enumerate(texts, 1)), "id int, text string"), max_bytes=150, max_lines=3, max_line=20)
    return v.select("event_id", "id", "status", F.array_join("warnings", ",").alias("warnings"), "sanitized")


@register("submodule_rules", expected(
    "root varchar, path varchar, sha varchar, depth int, status varchar",
    ("https://r/1", "a", "s1", 1, "resolved"), ("https://r/1", "b", "s2", 1, "resolved"), ("https://r/1", "c", None, 1, "unpinned"), ("https://r/1", "d", "s3", 1, "rejected"), ("https://r/1", "../e", "s4", 1, "rejected"), ("https://r/1", "f", "s1", 1, "circular"),
    ("https://r/1", "a/x", "s5", 2, "resolved"), ("https://r/1", "a/x/y", "s6", 3, "too_deep"), ("https://r/1", "g", "s7", 1, "resolved"), ("https://r/1", "g/i", "s8", 2, "over_limit"), ("https://r/1", "h", None, 1, "over_limit"), ("https://r/2", "a", "s1", 1, "resolved"), ("https://r/2", "a/x", "s5", 2, "resolved"), ("https://r/2", "a/x/y", "s6", 3, "too_deep"),
))
def submodule_rules(s, d):
    """The same url with another sha is not circular, an entry met before is; four are resolved depth-first, then all is over the limit."""
    m = [
        ("https://r/1", "https://h/a", "s1", "a"), ("https://r/1", "https://h/a", "s2", "b"), ("https://r/1", "https://h/c", None, "c"), ("https://r/1", "file:///d", "s3", "d"), ("https://r/1", "https://h/e", "s4", "../e"), ("https://r/1", "https://h/a", "s1", "f"),
        ("https://r/1", "https://h/g", "s7", "g"), ("https://r/1", "https://h/h", None, "h"), ("https://r/2", "https://h/a", "s1", "a"),
    ]
    # modules of a fetched commit: those of https://h/a are known at s1 only, so b has none; each url stands for its commit
    lead = [("https://h/a#s1", "https://h/x", "s5", "a/x"), ("https://h/x#s5", "https://h/y", "s6", "a/x/y"), ("https://h/g#s7", "https://h/i", "s8", "g/i")]
    rows = [(p, u + (f"#{h}" if u == "https://h/a" else "#s7" if u == "https://h/g" else ""), h, w) for p, u, h, w in m] + [(p, u + (f"#{h}" if u == "https://h/x" else ""), h, w) for p, u, h, w in lead]
    out = ig.resolve_submodules(values(s, [("https://r/1",), ("https://r/2",)], "url string"), values(s, rows, "parent_url string, url string, sha string, path string"), max_total=4)
    return out.select("root", "path", "sha", "depth", "status")


@register("parser_languages", dealt_sql(
    "path varchar, language varchar, method varchar",
    ("a.pyi", "python", "extension"), ("b.hh", "cpp", "extension"), ("c.tfvars", "terraform", "extension"), ("d.jsx", "tsx", "extension"), ("e.rs", "rust", "extension"), ("f", "python", "shebang"), ("g", "javascript", "shebang"), ("h", "go", "content"), ("i", "javascript", "content"), ("j", "yaml", "content"), ("k", "unknown", "none"),
))
def parser_languages(s, d):
    rows = [("a.pyi", ""), ("b.hh", ""), ("c.tfvars", ""), ("d.jsx", ""), ("e.rs", ""), ("f", "#!/usr/bin/env python3\n"), ("g", "#!/usr/bin/node\n"), ("h", "package main\nfunc main() {}\n"), ("i", "import x from 'y';\nimport z from 'w';\nconst a = require('b')\n"), ("j", "---\nkey:\n"), ("k", "nothing here")]
    language, _, method = no.detect_language(F.col("path"), F.col("text"))
    return dealt(s, d, rows, "path string, text string").select("event_id", "path", language.alias("language"), method.alias("method"))


@register("path_policy", dealt_sql(
    "path varchar, allowed boolean, escapes boolean",
    ("a/b.py", True, False), ("a/../b.py", True, False), ("../b.py", False, False), ("a/../../b", False, False), ("/base/repo/x", True, False), ("/base/repository/x", False, False), ("/etc/passwd", False, False), ("./a", True, False), ("a/link", True, True), ("a/inner", True, False), ("a\x00b", False, False), (None, False, True),
))
def path_policy(s, d):
    targets = {"a/link": "../../../etc", "a/inner": "../b/c"}
    rows = [(p, targets.get(p, "same")) for p in ("a/b.py", "a/../b.py", "../b.py", "a/../../b", "/base/repo/x", "/base/repository/x", "/etc/passwd", "./a", "a/link", "a/inner", "a\x00b", None)]
    plain = F.col("target") == "same"
    escapes = F.when(plain & F.col("path").isNotNull() & ~F.col("path").contains("\x00"), F.lit(False)).otherwise(ig.symlink_escapes(F.col("path"), F.col("target"), "/base/repo"))
    return dealt(s, d, rows, "path string, target string").select("event_id", "path", ig.path_allowed(F.col("path"), "/base/repo").alias("allowed"), escapes.alias("escapes"))


H1, H2 = "a" * 40, "b" * 40


@register("prefetch_decisions", dealt_sql(
    "id int, outcome varchar, commit varchar, warning varchar",
    (1, "go_on", H1, None), (2, "too_large", None, "too_large"), (3, "too_large", None, "too_large"), (4, "go_on", H1, "archived"), (5, "go_on", None, "incomplete_sha"), (6, "go_on", H2, "sha_mismatch"), (7, "not_found", None, "not_found"), (8, "rate_limit", None, "rate_limit"),
    (9, "auth", None, "auth"), (10, "no_sha", None, "no_sha"), (11, "go_on", H2, "metadata_failed"), (12, "go_on", H2, None),
))
def prefetch_decisions(s, d):
    rows = [
        (1, 1024, 100, False, None, H1, None), (2, 200 * 1024, 100, False, None, H1, None), (3, 3000 * 1024, 9000, False, None, H1, None), (4, 1, 100, True, None, H1, None), (5, 1, 100, False, None, "abc", None), (6, 1, 100, False, H2, H1, None), (7, None, 100, None, H2, None, "RepositoryNotFoundError"),
        (8, None, 100, None, H2, None, "RateLimitError"), (9, None, 100, None, H2, None, "PermissionDeniedError"), (10, None, 100, None, None, None, "AdapterError"), (11, None, 100, None, H2, None, "AdapterError"), (12, 1, 100, False, H2, H2, None),
    ]
    df = dealt(s, d, rows, "id int, size_kb long, limit_mb long, archived boolean, asked string, head string, error string")
    outcome, commit, warning = ig.prefetch_decision(*(F.col(c) for c in ("size_kb", "limit_mb", "archived", "asked", "head", "error")))
    return df.select("event_id", "id", outcome.alias("outcome"), commit.alias("commit"), warning.alias("warning"))


def ingestion(s) -> dict[str, DataFrame]:
    r = [("s1", "https://h/a", "main", None, 1, "ref"), ("s2", "https://h/b", "main", None, 1, "ref"), ("s3", "ftp://h/c", "main", None, 1, "ref"), ("s4", "https://h/a", "main", None, 1, "ref"), ("s5", "https://h/none", "main", H2, 1, "ref")]
    m = [("https://h/a", 10, False, H1, None), ("https://h/b", 9_000_000, False, H1, None)]
    f = [("s1", "x.py", bytearray(b"x"), 1), ("s1", "y.py", bytearray(b"yy"), 2), ("s4", "x.py", bytearray(b"changed"), 7)]
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("x", "yy")}
    a = [("s1", "x.py", sha["x"]), ("s1", "y.py", sha["yy"]), ("s4", "x.py", sha["x"])]
    return ig.ingest(values(s, r, "session_id string, url string, branch string, sha string, depth int, credential string"), values(s, m, "url string, size_kb long, archived boolean, head_sha string, error string"), values(s, f, "session_id string, path string, content binary, length long"), values(s, a, "session_id string, relative_path string, sha256 string"))


@register("ingestion_results", expected("session_id varchar, commit varchar, warning varchar, files bigint, bytes bigint, status varchar", ("s1", H1, None, 2, 3, "ok"), ("s5", H2, "metadata_failed", 0, 0, "ok")))
def ingestion_results(s, d):
    return ingestion(s)["results"].select("session_id", "commit", "warning", "files", "bytes", "status")


@register("ingestion_failures", expected("session_id varchar, event varchar, stage varchar, error varchar", ("s2", "ingestion_failed", "prefetch", "too_large"), ("s3", "ingestion_failed", "validate", "scheme"), ("s4", "ingestion_failed", "deliver", "integrity")))
def ingestion_failures(s, d):
    return ingestion(s)["audit"]


SOURCES = [
    ("a.py", "python", "import os\nasync def run(x):\n    os.system(x); y = pickle.loads(x)\n    # eval(x)\n    helper(eval(x))\n"), ("b.js", "javascript", "export const go = async (a) => {\n  el.innerHTML (a)\n}\n"), ("c.go", "go", "func (s *Server) Do(r Req) {\n r.FormValue(x)\n}"),
    ("d.tf", "terraform", 'resource "aws_db" "main" {\n  password = f(1)\n}\nvariable "v" {}'), ("e.java", "java", "  public static void main(String[] a) {"), ("f.rs", "rust", "pub fn go<T>(x: T) {"), ("g.yaml", "yaml", "key: eval(x)"),
]


@register("parser_scan", expected(
    "file_path varchar, node_type varchar, name varchar, line int, col int, end_col int, label varchar, cwe varchar",
    ("a.py", "PROGRAM", "a.py", 0, 0, 0, "NONE", ""), ("a.py", "FUNCTION", "run", 2, 0, 17, "NONE", ""), ("a.py", "CALL", "os.system", 3, 4, 14, "SINK", "CWE-78"), ("a.py", "CALL", "pickle.loads", 3, 22, 35, "SINK", "CWE-502"), ("a.py", "CALL", "eval", 5, 11, 16, "SINK", "CWE-78"),
    ("b.js", "PROGRAM", "b.js", 0, 0, 0, "NONE", ""), ("b.js", "FUNCTION", "go", 1, 0, 32, "NONE", ""), ("b.js", "CALL", "el.innerHTML", 2, 2, 16, "SINK", "CWE-79"), ("c.go", "PROGRAM", "c.go", 0, 0, 0, "NONE", ""), ("c.go", "FUNCTION", "Do", 1, 0, 28, "NONE", ""),
    ("c.go", "CALL", "r.FormValue", 2, 1, 13, "SOURCE", "CWE-20"), ("d.tf", "PROGRAM", "d.tf", 0, 0, 0, "NONE", ""), ("d.tf", "FUNCTION", "aws_db", 1, 0, 26, "NONE", ""), ("d.tf", "FUNCTION", "v", 4, 0, 15, "NONE", ""), ("e.java", "PROGRAM", "e.java", 0, 0, 0, "NONE", ""),
    ("e.java", "FUNCTION", "main", 1, 0, 39, "NONE", ""), ("f.rs", "PROGRAM", "f.rs", 0, 0, 0, "NONE", ""), ("f.rs", "FUNCTION", "go", 1, 0, 20, "NONE", ""), ("g.yaml", "PROGRAM", "g.yaml", 0, 0, 0, "NONE", ""), ("g.yaml", "CALL", "eval", 1, 5, 10, "SINK", ""),
))
def parser_scan(s, d):
    n = no.parser_scan(values(s, SOURCES, "file_path string, language string, text string"), dims.frame(s, "registry"))
    return n.select("file_path", "node_type", "name", "line", "col", "end_col", "label", "cwe")


@register("catalog_nodes", expected(
    "node_id varchar, vuln_type varchar, cwe varchar, severity varchar",
    ("n1", "SQL Injection", "CWE-89", "HIGH"), ("n4", "Command Injection", "CWE-78", "HIGH"), ("n5", "Hardcoded Secret", "CWE-798", "MEDIUM"), ("n7", "Prototype Pollution", "CWE-1321", "HIGH"), ("n8", "Command Injection", "CWE-78", "HIGH"), ("n9", "Unencrypted Storage", "CWE-311", "MEDIUM"),
    ("n10", "Insecure Deserialisation", "CWE-502", "HIGH"), ("n12", "Missing Authentication", "CWE-306", "MEDIUM"),
))
def catalog_nodes(s, d):
    rows = [
        ("n1", "python", "CALL", "cursor.execute(q + x)"), ("n2", "python", "CALL", "cursor.execute(escape(x))"), ("n3", "python", "IMPORT", "cursor.execute(q)"), ("n4", "python", "ASSIGN", "r = subprocess.run(c, shell=True)"), ("n5", "python", "ASSIGN", "password = 'hunter22'"), ("n6", "python", "ASSIGN", "password = os.environ['x']"),
        ("n7", "javascript", "CALL", "Object.assign(a, b)"), ("n8", "go", "CALL", "exec.Command(x)"), ("n9", "terraform", "ASSIGN", "encrypted = false"), ("n10", "java", "CALL", "s.readObject ()".replace(" ", "")), ("n11", "rust", "CALL", "exec.Command(x)"), ("n12", "python", "FUNCTION", "@app.route('/x')"),
        ("n13", "python", "FUNCTION", "@app.route('/x') @login_required"),
    ]
    return no.catalog_hits(values(s, rows, "node_id string, language string, node_type string, raw_text string"), dims.frame(s, "catalog"))


CATALOG_FILE = """patterns:

  - vuln_type: "SQL Injection"
    cwe: "CWE-89"
    severity: HIGH
    node_types: [CALL, ASSIGN]
    keywords: ["query"]
    sink_pattern: '(query|["''])\\s*\\('
    sanitizers: ["escape", "quote"]
    description: >
      Text.

  - vuln_type: "Other"
    cwe: "CWE-1"
    severity: LOW   # a note
    node_types: [CALL]
    sink_pattern: "x\\\\("
    sanitizers: []
"""


@register("catalog_files", expected(
    "language varchar, vuln_type varchar, cwe varchar, severity varchar, node_types varchar, pattern varchar, sanitizers varchar",
    ("python", "SQL Injection", "CWE-89", "HIGH", "CALL,ASSIGN", "(query|[\"'])\\s*\\(", "escape,quote"), ("python", "Other", "CWE-1", "LOW", "CALL", "x\\\\(", ""),
))
def catalog_files(s, d):
    return rd.catalog(values(s, [("sinks/python.yaml", CATALOG_FILE)], "path string, text string")).select("language", "vuln_type", "cwe", "severity", "node_types", "pattern", "sanitizers")


SARIF = """{"runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"r1","properties":{"tags":["security","external/cwe/cwe-089","external/cwe/cwe-20"]}},{"id":"r2","properties":{"tags":["x"]}}]}},
"results":[{"ruleId":"r1","level":"error","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"./src/a.py"},"region":{"startLine":3,"startColumn":5}}}]},
{"ruleId":"r2","level":"note","locations":[{"physicalLocation":{"artifactLocation":{"uri":"b.py"},"region":{"startLine":1}}}]},{"ruleId":"r1","level":"warning","locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/a.py"},"region":{"startLine":3,"startColumn":5}}}]},{"ruleId":"r1","level":"error","locations":[]}]}]}"""


def reports(s) -> DataFrame:
    return values(s, [("a.sarif", SARIF)], "path string, json string")


@register("sarif_nodes", expected("file_path varchar, line int, col int, name varchar, label varchar, severity varchar, cwes varchar", ("src/a.py", 3, 4, "r1", "SINK", "warning", "CWE-20,CWE-89"), ("b.py", 1, 0, "r2", "SINK", "note", "")))
def sarif_nodes(s, d):
    return fi.sarif_nodes(rd.sarif_results(reports(s), path="path"), rd.sarif_rule_cwes(reports(s))).select("file_path", "line", "col", "name", "label", "severity", "cwes")


@register("sarif_counts", expected("tool varchar, results bigint, rules bigint, n_error bigint, n_warning bigint, n_note bigint", ("t", 3, 2, 1, 1, 1)))
def sarif_counts(s, d):
    return fi.sarif_counts(rd.sarif_results(reports(s), path="path").withColumn("tool", F.lit("t")))


GRAPH = '{"nodes":[{"id":"1","_label":"CALL","code":"f(x)","name":"f","lineNumber":3,"columnNumber":2},{"_id":"2","label":"IDENTIFIER","name":"x","line":3},{"id":"3","nodeType":"FILE"}],"edges":[{"src":"1","dst":"2","label":"REACHING_DEF"},{"outV":"1","inV":"2","_label":"odd"},{"source":"2","target":"1","edgeType":"cfg"}]}'


@register("json_graph_nodes", expected("id varchar, raw_type varchar, raw_text varchar, name varchar, line int, col int", ("1", "CALL", "f(x)", "f", 3, 2), ("2", "IDENTIFIER", "", "x", 3, 0)))
def json_graph_nodes(s, d):
    return rd.json_graph(values(s, [(GRAPH,)], "json string"))[0]


@register("json_graph_edges", expected("src varchar, dst varchar, edge_type varchar", ("1", "2", "DFG_FLOW"), ("1", "2", "AST_CHILD"), ("2", "1", "CFG_NEXT")))
def json_graph_edges(s, d):
    return rd.json_graph(values(s, [(GRAPH,)], "json string"))[1]


MODULES = '[submodule "libs/a"]\n\tpath = libs/a\n\turl = ../a.git\n\tbranch = main\n[core]\n\tx = 1\n[submodule "b"]\n  path=b\n  url=https://h/b\n'


@register("gitmodules", expected("name varchar, path varchar, url varchar, branch varchar, full_url varchar", ("libs/a", "libs/a", "../a.git", "main", "https://h/o/a.git"), ("b", "b", "https://h/b", "", "https://h/b")))
def gitmodules(s, d):
    m = rd.gitmodules(values(s, [("https://h/o/repo.git", MODULES)], "parent string, text string"))
    return m.select("name", "path", "url", "branch", ig.resolve_relative(F.col("url"), F.col("parent")).alias("full_url"))


@register("gitlinks", expected("path varchar, sha varchar", ("libs/a b", H1)))
def gitlinks(s, d):
    return rd.gitlinks(values(s, [(f"160000 commit {H1}\tlibs/a b",), (f"100644 blob {H2}\tx",), ("160000 commit short\ty",)], "line string"))


@register("head_commits", dealt_sql("id int, commit varchar, pinned boolean", (1, H1, True), (2, H2, False), (3, H1, True), (4, None, False)))
def head_commits(s, d):
    rows = [(1, f"{H1}\n", {}, ""), (2, "ref: refs/heads/main\n", {"refs/heads/main": f"{H2}\n"}, ""), (3, "ref: refs/heads/dev", {}, f"# pack\n{H2} refs/heads/main\n{H1} refs/heads/dev"), (4, "ref: refs/heads/none", {}, "")]
    commit = rd.head_commit(F.col("head"), F.col("refs"), F.col("packed"))
    c = dealt(s, d, rows, "id int, head string, refs map<string,string>, packed string").select("event_id", "id", F.nullif(commit, F.lit("")).alias("commit"))
    return c.select("event_id", "id", "commit", ig.pin_matches(F.lit(H1[:12]), F.col("commit")).alias("pinned"))


@register("texts_and_paths", dealt_sql(
    "id int, txt varchar, rel varchar, short varchar, fragment varchar",
    (1, "plain", "src/a.py", "plain", "lai"), (2, "a�b", ".hidden/x", "a�b", "�b"), (3, "a\x01b‮c", "x.py", "a bc", "\x01bc"),
))
def texts_and_paths(s, d):
    rows = [(1, bytearray(b"plain"), "file:///repo/src/a.py"), (2, bytearray(b"a\xffb"), "/repo/.hidden/x"), (3, bytearray("a\x01b‮c".encode()), ".\\x.py")]
    df = dealt(s, d, rows, "id int, content binary, path string").withColumn("txt", rd.as_text(F.col("content")))
    return df.select("event_id", "id", "txt", rd.relative_path(F.col("path"), "/repo").alias("rel"), tx.sanitize_short(F.col("txt")).alias("short"), tx.raw_fragment(F.col("content"), F.lit(1), F.when(F.col("id") == 1, 4).otherwise(99)).alias("fragment"))


@register("request_rules", dealt_sql(
    "id int, rule varchar",
    (1, None), (2, "url_missing"), (3, "url_too_long"), (4, "scheme"), (5, "credentials_in_url"), (6, "no_host"), (7, "ssrf"), (8, "ssrf"), (9, "branch"), (10, "commit_sha"), (11, "depth"), (12, "credential_ref"),
))
def request_rules(s, d):
    ok = ("https://h/a", "main", None, 1, "ref")
    rows = [
        (1, *ok), (2, "", *ok[1:]), (3, "https://h/" + "a" * 600, *ok[1:]), (4, "http://h/a", *ok[1:]), (5, "https://u:p@h/a", *ok[1:]), (6, "https:///a", *ok[1:]), (7, "https://10.1.2.3/a", *ok[1:]), (8, "https://localhost/a", *ok[1:]),
        (9, "https://h/a", "a b", *ok[2:]), (10, "https://h/a", "main", "xyz", 1, "ref"), (11, "https://h/a", "main", None, 0, "ref"), (12, "https://h/a", "main", None, 1, ""),
    ]
    df = dealt(s, d, rows, "id int, url string, branch string, sha string, depth int, credential string")
    return df.select("event_id", "id", ig.validate_request(*(F.col(c) for c in ("url", "branch", "sha", "depth", "credential"))).alias("rule"))


@register("submodule_entry_rules", dealt_sql(
    "id int, rule varchar",
    (1, None), (2, "empty_url"), (3, "filesystem_url"), (4, "filesystem_url"), (5, "scheme"), (6, "credentials_in_url"), (7, "no_host"), (8, "ssrf"), (9, "empty_path"), (10, "absolute_path"), (11, "absolute_path"), (12, "path_escapes"),
))
def submodule_entry_rules(s, d):
    rows = [(1, "https://h/a", "a"), (2, "", "a"), (3, "/srv/a", "a"), (4, "file:///a", "a"), (5, "ssh://h/a", "a"), (6, "https://u@h/a", "a"), (7, "https:///a", "a"), (8, "https://127.0.0.1/a", "a"), (9, "https://h/a", ""), (10, "https://h/a", "/a"), (11, "https://h/a", "a\\b"), (12, "https://h/a", "a/../../b")]
    return dealt(s, d, rows, "id int, url string, path string").select("event_id", "id", ig.validate_submodule(F.col("url"), F.col("path")).alias("rule"))


@register("node_names", dealt_sql(
    "id int, name varchar, value varchar",
    (1, "run", None), (2, "Box", None), (3, "os.system", None), (4, "os.path", None), (5, "x", "1 + 2"), (6, "first", None), (7, "text", '"text"'), (8, "key", None),
))
def node_names(s, d):
    rows = [(1, "FUNCTION", "def run(x):"), (2, "CLASS", "public class Box {"), (3, "CALL", "os.system(x)"), (4, "IMPORT", "import os.path"), (5, "ASSIGN", "x = 1 + 2"), (6, "IDENTIFIER", "first.second"), (7, "LITERAL", '"text"'), (8, "CONFIG_KEY", "key: value")]
    return dealt(s, d, rows, "id int, t string, raw string").select("event_id", "id", no.extract_name(F.col("t"), F.col("raw")).alias("name"), no.extract_value(F.col("t"), F.col("raw")).alias("value"))


@register("backends", dealt_sql("language varchar, first_choice varchar, without_first varchar", ("python", "codeql", "tree_sitter"), ("rust", "tree_sitter", "tree_sitter"), ("tsx", "tree_sitter", "tree_sitter"), ("unknown", "fallback", "fallback"), ("cobol", "fallback", "fallback")))
def backends(s, d):
    df = dealt(s, d, [(x,) for x in ("python", "rust", "tsx", "unknown", "cobol")], "language string")
    return df.select("event_id", "language", no.route_backend(F.col("language"), ["codeql", "tree_sitter"]).alias("first_choice"), no.route_backend(F.col("language"), ["tree_sitter"]).alias("without_first"))


@register("registry_languages", dealt_sql(
    "name varchar, language varchar, label varchar, confidence double, cwe varchar, pass int",
    ("os.system", "python", "SINK", 0.95, "CWE-78", 1), ("my.pickle.loads", "python", "SINK", 0.7425, "CWE-502", 2), ("innerHTML", "javascript", "SINK", 0.95, "CWE-79", 1), ("el.innerHTML", "javascript", "SINK", 0.95, "CWE-79", 1), ("r.FormValue", "go", "SOURCE", 0.99, "CWE-20", 1), ("web::Query", "rust", "SOURCE", 0.99, "CWE-20", 1),
    ("Runtime.exec", "java", "SINK", 0.99, "CWE-78", 1), ("privileged", "terraform", "SINK", 0.95, "CWE-250", 1), ("db_password", "terraform", "SENSITIVE", 0.55, "CWE-798", 3), ("os.system", "go", "SINK", 0.4, "", 3), ("print", "python", "NONE", 0.0, "", 0), ("getBody", "go", "SOURCE", 0.35, "", 3),
))
def registry_languages(s, d):
    names = [("os.system", "python"), ("my.pickle.loads", "python"), ("innerHTML", "javascript"), ("el.innerHTML", "javascript"), ("r.FormValue", "go"), ("web::Query", "rust"), ("Runtime.exec", "java"), ("privileged", "terraform"), ("db_password", "terraform"), ("os.system", "go"), ("print", "python"), ("getBody", "go")]
    n = dealt(s, d, [(f"{k}", "CALL", a, "", b) for k, (a, b) in enumerate(names)], "node_id string, node_type string, name string, raw_text string, language string")
    n = n.withColumn("node_id", F.col("event_id").cast("string"))
    return an.annotate(n, dims.frame(s, "registry")).select("event_id", "name", "language", "label", "confidence", "cwe", "pass")


@register("phase_rules", expected("session_id varchar, seq int, rule varchar", ("b", 1, "starts_late"), ("c", 3, "out_of_order"), ("d", 10, "after_complete")))
def phase_rules(s, d):
    whole = ["PARSE", "AST", "NORMALIZE", "CFG", "DFG", "CPG_MERGE", "GRAPHCODEBERT", "ANNOTATE", "COMPLETE"]
    rows = [*(("a", k, p) for k, p in enumerate(whole, 1)), ("b", 1, "AST"), ("b", 2, "CFG"), ("c", 1, "PARSE"), ("c", 2, "NORMALIZE"), ("c", 3, "AST"), *(("d", k, p) for k, p in enumerate([*whole, "PARSE"], 1))]
    return ev.protocol_violations(values(s, rows, "session_id string, seq int, type string"))


@register("complete_counts", expected("session_id varchar, ok boolean", ("a", True), ("b", False), ("c", False)))
def complete_counts(s, d):
    rows = [("a", "node", None), ("a", "node", None), ("a", "edge", None), ("a", "COMPLETE", '{"node":2,"edge":1,"finding":0}'), ("b", "node", None), ("b", "COMPLETE", '{"node":2,"edge":0,"finding":0}'), ("c", "node", None)]
    return ev.complete_counts(values(s, rows, "session_id string, type string, payload string"))


@register("merged_events", expected(
    "session_id varchar, seq int, channel varchar, payload varchar",
    ("a", 1, "log", "x"), ("a", 2, "log", "x"), ("a", 2, "graph", "n"), ("a", 1, "metrics", "1"), ("a", 3, "metrics", "2"), ("a", 1, "state", "waiting"), ("a", 4, "state", "approved"), ("b", 2, "metrics", "1"),
))
def merged_events(s, d):
    e = lambda *rows: values(s, list(rows), "session_id string, seq int, payload string")
    return ev.merged(e(("a", 1, "x"), ("a", 2, "x")), e(("a", 2, "n")), e(("a", 1, "1"), ("a", 2, "1"), ("a", 3, "2"), ("b", 2, "1")), e(("a", 1, "waiting"), ("a", 2, "waiting"), ("a", 4, "approved")))


@register("heartbeats", expected("session_id varchar, ts double, kind varchar", ("a", 0.0, "event"), ("a", 15.0, "heartbeat"), ("a", 30.0, "heartbeat"), ("a", 40.0, "event"), ("a", 41.0, "event"), ("a", 41.0, "end"), ("b", 5.0, "event"), ("b", 20.0, "event")))
def heartbeats(s, d):
    rows = [("a", 0.0, "PARSE"), ("a", 40.0, "AST"), ("a", 41.0, "COMPLETE"), ("b", 5.0, "PARSE"), ("b", 20.0, "AST")]
    return ev.with_heartbeats(values(s, rows, "session_id string, ts double, type string"), 15.0)


@register("session_counts", "select user_id as session_id, count(*) filter (where event_type = 'click') as nodes, count(*) filter (where event_type = 'view') as edges, count(*) filter (where event_type = 'error') as findings from events where event_type in ('click', 'view', 'error') group by user_id")
def session_counts(s, d):
    e = session_events(table(s, d, "events"))
    return fi.session_counts(*(e.where(F.col("type") == t) for t in ("click", "view", "error")))


@register("backend_counts", """select session_id, backends, latency from (select session_id, string_agg(b || '=' || n, ',' order by b) as backends from (select user_id as session_id, event_type as b, count(*) as n from events group by all) group by session_id)
 join (select session_id, string_agg(st || '=' || ms, ',' order by st) as latency from (select user_id as session_id, 's' || event_id % 3 as st, cast(sum(event_id % 100) as bigint) as ms from events group by all) group by session_id) using (session_id)""")
def backend_counts(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("backend"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("stage"), (F.col("event_id") % 100).alias("latency_ms"))
    return fi.backend_counts(e)


@register("confidence_by_severity", "select case p_size % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity, count(*) as n, round(avg(p_size / 100), 3) as confidence_avg from part group by all")
def confidence_by_severity(s, d):
    severity = F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.col("p_size") % 3 + 1).cast("int"))
    return fi.confidence_by_severity(table(s, d, "part").select(severity.alias("severity"), (F.col("p_size") / 100).alias("confidence")))


@register("known_edges", "select 'e' || a.event_id as src, 'e' || b.event_id as dst, 'X' as edge_type from events a join events b on b.event_id = a.event_id + 7 where a.event_id % 2 = 0")
def known_edges(s, d):
    """Each edge is given twice, and once to a node that isn't there."""
    n = sequence(s, d).select("id", "ord")
    edges = n.where("ord % 2 = 0").select(F.col("id").alias("src"), F.concat(F.lit("e"), (F.col("ord") + 7).cast("string")).alias("dst"), F.lit("X").alias("edge_type"))
    return gr.keep_known_edges(edges.unionByName(edges).unionByName(edges.withColumn("dst", F.lit("none"))), n)


@register("catalog_languages", dealt_sql("given varchar, language varchar", ("ts", "javascript"), ("TSX", "javascript"), ("hcl", "terraform"), ("Go", "go"), ("cobol", "python")))
def catalog_languages(s, d):
    return dealt(s, d, [(x,) for x in ("ts", "TSX", "hcl", "Go", "cobol")], "given string").select("event_id", "given", se.catalog_language(F.col("given")).alias("language"))


@register("cfg_conditions", expected("src varchar, dst varchar, condition varchar", ("a", "b", "if x:"), ("c", "d", "y" * 80)))
def cfg_conditions(s, d):
    rows = [("f", 1, "a", "IF", 1, 0, 2, "", "", "if x:"), ("f", 2, "b", "CALL", 2, 0, 2, "", "", "g()"), ("f", 3, "c", "IF", 3, 0, 4, "", "", "y" * 200), ("f", 4, "d", "CALL", 4, 0, 4, "", "", "h()"), ("f", 5, "e", "IF", 5, 0, 5, "", "", "no body")]
    return gr.cfg_conditions(values(s, rows, "file string, ord int, id string, t string, line int, col int, end_line int, fn string, name string, normalized_text string")).select("src", "dst", "condition")


@register("language_warnings", expected("id varchar, line int, kind varchar", ("1", 1, "context_exit"), ("3", 3, "event_loop"), ("4", 4, "early_return"), ("5", 5, "deferred"), ("6", 6, "concurrent"), ("8", 8, "jump_target")))
def language_warnings(s, d):
    rows = [("1", "WITH", 1, "python", []), ("2", "WITH", 2, "java", []), ("3", "AWAIT", 3, "TSX", []), ("4", "TRY", 4, "rust", []), ("5", "BLOCK", 5, "go", ["is_defer"]), ("6", "BLOCK", 6, "go", ["is_goroutine"]), ("7", "BLOCK", 7, "go", None), ("8", "BREAK", 8, "cpp", ["is_goto"]), ("9", "BREAK", 9, "c", [])]
    return gr.language_warnings(values(s, [("f", *r) for r in rows], "file string, id string, t string, line int, language string, flags array<string>")).select("id", "line", "kind")


@register("truncated_graphs", """with n as (select cast(user_id as varchar) as file, event_id, row_number() over (partition by user_id order by ts, event_id) as line from events), k as (select file, event_id, line, lead(event_id) over (partition by file order by line) as nxt from n)
 select file, count(*) filter (where line <= 50) as nodes, least(20, count(nxt) filter (where line < 50)) as edges from k group by file""")
def truncated_graphs(s, d):
    n = sequence(s, d).withColumn("t", F.lit("CALL"))
    nodes, edges = gr.truncate_graph(n, gr.cfg_next(n), 50, 20)
    counted = edges.groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes")).join(counted, "file", "left").fillna(0, ["edges"])


#: Raw types of the parser layer and what they are there; events stand for a parser's nodes.
PARSED = [
    ("python", "function_definition", "FUNCTION"), ("python", "assignment", "ASSIGN"), ("python", "if_statement", "IF"), ("python", "elif_clause", "ELIF"), ("python", "else_clause", "ELSE"), ("python", "return_statement", "RETURN"),
    ("python", "attribute", "ATTRIBUTE"), ("python", "subscript", "SUBSCRIPT"), ("python", "tuple", "TUPLE"), ("python", "conditional_expression", "TERNARY"), ("python", "except_clause", "CATCH"), ("python", "with_statement", "BLOCK"),
    ("java", "method_invocation", "CALL"), ("java", "interface_declaration", "INTERFACE"), ("java", "switch_label", "CASE"), ("javascript", "arrow_function", "LAMBDA"), ("typescript", "object", "DICT"), ("tsx", "template_string", "LITERAL"),
    ("rust", "match_arm", "CASE"), ("rust", "trait_item", "INTERFACE"), ("go", "defer_statement", "EXPRESSION_STATEMENT"), ("go", "composite_literal", "DICT"), ("terraform", "attribute", "CONFIG_KEY"), ("terraform", "for_expr", "LOOP"),
    ("yaml", "tag", "TYPE_ANNOTATION"), ("yaml", "document", "MODULE"), ("c", "declaration", "ASSIGN"), ("cpp", "preproc_include", "IMPORT"), ("python", "my_function", "UNKNOWN"), ("terraform", "member_expression", "UNKNOWN"),
]


@register("parser_types", "select language, raw_type, node_type, count(*) as n from events e join (values " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(PARSED)) + f") k(k, language, raw_type, node_type) on (e.event_id + e.user_id) % {len(PARSED)} = k.k group by all")
def parser_types(s, d):
    kinds = F.array(*(F.struct(F.lit(a).alias("language"), F.lit(b).alias("raw_type")) for a, b, _ in PARSED))
    nodes = table(s, d, "events").select(F.element_at(kinds, ((F.col("event_id") + F.col("user_id")) % len(PARSED) + 1).cast("int")).alias("k")).select("k.*")
    return no.normalize_types(nodes, dims.frame(s, "parser_type_map"), guess=False).groupBy("language", "raw_type", "node_type").agg(F.count(F.lit(1)).alias("n"))


@register("graph_schema", "select * exclude (event_id), count(*) as n from (" + dealt_sql("node_id varchar, node_type varchar, language varchar, start_line int, end_line int, raw_text varchar, normalized_text varchar, parent_function varchar", ("n1", "CALL", "go", 3, 0, "f()", "", "p"), ("n2", "UNKNOWN", "unknown", 0, 0, "", "", "")) + ") group by all")
def graph_schema(s, d):
    rows = [("n1", "CALL", "go", 3, "f()", "p"), ("n2", None, None, None, None, None)]
    return no.to_graph_schema(dealt(s, d, rows, "node_id string, node_type string, language string, line int, raw_text string, parent_id string")).groupBy("node_id", "node_type", "language", "start_line", "end_line", "raw_text", "normalized_text", "parent_function").agg(F.count(F.lit(1)).alias("n"))


@register("node_filters", expected("kind varchar, ids varchar", ("functions", "1"), ("calls", "2,3"), ("sinks", "2"), ("sources", "")))
def node_filters(s, d):
    n = values(s, [("1", "FUNCTION", "NONE", 0.0), ("2", "CALL", "SINK", 0.9), ("3", "CALL", "SOURCE", 0.2)], "node_id string, node_type string, label string, confidence double")
    parts = {"functions": no.of_types(n, "FUNCTION"), "calls": no.of_types(n, "CALL"), "sinks": no.labelled(n, "SINK", 0.5), "sources": no.labelled(n, "SOURCE", 0.5)}
    rows = [p.agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("ids")).select(F.lit(k).alias("kind"), "ids") for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register("adapters", dealt_sql("url varchar, provider varchar, error varchar", ("https://github.com/o/r", "github", None), ("https://gitlab.com/o/r", "gitlab", "ADAPTER_NOT_IMPLEMENTED"), ("https://h/o/r", "none", "ADAPTER_NOT_IMPLEMENTED")))
def adapters(s, d):
    name, error = ig.adapter(F.col("url"))
    return dealt(s, d, [(u,) for u in ("https://github.com/o/r", "https://gitlab.com/o/r", "https://h/o/r")], "url string").select("event_id", "url", name.alias("provider"), error.alias("error"))


@register("plain_projections", expected("columns varchar", ("session_id,url",)))
def plain_projections(s, d):
    df = values(s, [("s", "u", "t", "c", "k")], "session_id string, url string, access_token string, credential_ref string, private_key string")
    return values(s, [(",".join(ig.without_secrets(df).columns),)], "columns string")


@register("sealed_manifests", "select source as session_id, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes, sha256(string_agg('doc/' || doc_id || ':' || sha256(text), chr(10) order by 'doc/' || doc_id || ':' || sha256(text))) as hash from documents group by source")
def sealed_manifests(s, d):
    m = table(s, d, "documents").select(F.col("source").alias("session_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    return wr.seal(m)
