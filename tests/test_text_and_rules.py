import hashlib

import pytest

from pyspark.sql import functions as F

from sparkloom.functions import dims, text as tx, types
from sparkloom.sources import readers as rd
from sparkloom.operators import annotate as an, findings as fi, ingestion as ig, nodes as no, validate as va


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ids(spark):
    r = one(spark, tx.node_id(F.lit("f"), F.lit(1), F.lit(2), F.lit("CALL")), tx.edge_id(F.lit("a"), F.lit("b"), F.lit("T")), tx.edge_id(F.lit("a"), F.lit("b"), F.lit("T"), "->"))
    assert list(r) == [hashlib.sha256(s).hexdigest()[:16] for s in (b"f:1:2:CALL", b"a:b:T", b"a->b:T")]


@pytest.mark.parametrize(
    ("text", "safe"),
    [("x = 'p' # c", "x = [STRING_LITERAL] [COMMENT]"), ("/* a\nb */ 123456 ‮z", "[COMMENT] [NUMBER] z"), ("a  \n\n  b\t c", "a\nb c"), ("", ""), (None, ""), ("y" * 2000, "y" * 1024 + " [TRUNCATED]")],
)
def test_sanitize(spark, text, safe):
    assert one(spark, tx.sanitize_for_model(F.lit(text).cast("string")))[0] == safe


def test_small_functions(spark):
    r = one(
        spark, tx.assigned_name(F.lit("self.q: str = f(x)")), tx.member_base(F.lit("request.args")), tx.extension(F.lit("a/B.PY")), tx.extension(F.lit("a/.py")), tx.darken(F.lit("#ff2010")),
        tx.redact(F.lit("see https://u:p@h/x")), tx.sanitize_short(F.lit("a\x00b\x07c")), tx.raw_fragment(F.lit(b"ab\xffcd"), F.lit(1), F.lit(4)), tx.name_variants(F.lit("Os.System")),
    )
    assert list(r) == ["q", "request", "py", "", "#d70000", "see https://[REDACTED]@h/x", "ab c", "b�c", ["Os.System", "os.system", "System", "system"]]


def test_fallback_nodes(spark):
    src = "def f(a):\n  # c\nimport os\nx = g(h(1))\n"
    got = [(r.node_type, r.line, r.col, r.raw_text) for r in no.fallback_nodes(spark.createDataFrame([("f", src), ("n", None)], "file_path string, text string")).collect()]
    assert got == [("FUNCTION", 1, 0, "def f(a):"), ("IMPORT", 3, 0, "import os"), ("CALL", 4, 0, "g"), ("CALL", 4, 1, "h")]


@pytest.mark.parametrize(("path", "text", "want"), [("a.rs", "", ("rust", 1.0, "extension")), ("a", "#!/usr/bin/env python3", ("python", 0.85, "shebang")), ("a", "def f(x):\n  pass\ndef g(y):", ("python", 0.8, "content")), ("a", "hello", ("unknown", 0.0, "none"))])
def test_language(spark, path, text, want):
    assert tuple(one(spark, *no.detect_language(F.lit(path), F.lit(text)))) == want


def test_routing_and_types(spark):
    assert one(spark, no.route_backend(F.lit("python"), ["tree_sitter"]), no.route_backend(F.lit("rust"), []), no.route_backend(F.lit("java"), ["codeql", "tree_sitter"]))[:] == ("tree_sitter", "fallback", "codeql")
    df = spark.createDataFrame([("python", "call"), ("go", "for_range"), ("go", "zzz")], "language string, raw_type string")
    assert {r.raw_type: r.node_type for r in no.normalize_types(df, dims.frame(spark, "type_map")).collect()} == {"call": "CALL", "for_range": "LOOP", "zzz": "UNKNOWN"}


@pytest.mark.parametrize(
    ("name", "raw", "kind", "want"),
    [
        ("os.system", "", "CALL", ("SINK", 0.95, "CWE-78", 1)), ("x.EVAL", "", "CALL", ("SINK", 0.98, "CWE-78", 1)), ("db.pickle.loads", "", "CALL", ("SINK", 0.7425, "CWE-502", 2)), ("my_password", "", "IDENTIFIER", ("SENSITIVE", 0.55, "CWE-798", 3)),
        ("escape_it", "", "CALL", ("SANITIZER", 0.45, "", 3)), ("do_render", "", "CALL", ("SINK", 0.4, "", 3)), ("header_of", "", "CALL", ("SOURCE", 0.35, "", 3)), ("plain", "", "CALL", ("NONE", 0.0, "", 0)), ("eval", "", "LITERAL", ("NONE", 0.0, "", 0)), (None, "", "CALL", ("NONE", 0.0, "", 0)),
    ],
)
def test_annotate(spark, name, raw, kind, want):
    df = spark.createDataFrame([("n", kind, name, raw, "python")], "node_id string, node_type string, name string, raw_text string, language string")
    r = an.annotate(df, dims.frame(spark, "registry")).first()
    assert (r.label, r.confidence, r.cwe, r["pass"]) == want and 0 <= r.confidence <= 1


def test_validate(spark):
    rows = [("a\x00b‮​",), ("#!x\n#!y",), ("A" * 50,), ("z" * 30,), (None,), ("x" * 100 + "\n" + "y",), ("line\u2028sep\u00a0ï",)]
    got = [(r.warnings, r.status, r.sanitized) for r in va.validate(spark.createDataFrame(rows, "text string"), max_bytes=95, max_line=40).collect()]
    assert got[0] == (["null_bytes", "bidi", "zero_width"], "PASSED", "ab")
    assert got[1][0] == ["shebangs"]
    assert got[2][:2] == (["line_length", "dominating_char", "base64"], "TRUNCATED")
    assert got[4] == ([], "PASSED", "")
    assert got[5][1:] == ("REJECTED", "")
    assert got[6] == (["nfkc", "separators"], "PASSED", "line\nsep ï")


@pytest.mark.parametrize(
    ("url", "branch", "sha", "rule"),
    [("", "m", "", "url_missing"), ("http://h/x", "m", "", "scheme"), ("https://u:p@h/x", "m", "", "credentials_in_url"), ("https:///x", "m", "", "no_host"), ("https://10.1.2.3/x", "m", "", "ssrf"), ("https://LOCALHOST:8/x", "m", "", "ssrf"), ("https://h/x", "a;b", "", "branch"), ("https://h/x", "m", "xyz", "commit_sha"), ("https://h/x", "a/b-c.d", "abcdef1", None), ("https://" + "h" * 600, "m", "", "url_too_long"), ("https://[::1]/x", "m", "", "ssrf"), ("https://[fe80::1]/x", "m", "", "ssrf"), ("https://8.8.8.8/x", "m", "", None)],
)
def test_requests(spark, url, branch, sha, rule):
    assert spark.createDataFrame([(url, branch, sha)], "u string, b string, s string").select(ig.validate_request(F.col("u"), F.col("b"), F.col("s"), F.lit(1), F.lit("c"), with_v6=True)).first()[0] == rule


def test_submodule_urls(spark):
    parent = F.lit("https://h/o/r.git")
    assert one(spark, *(ig.resolve_relative(F.lit(u), parent) for u in ("../x", "./y", "../../z/w", "../../../../q", "https://k/a")))[:] == ("https://h/o/x", "https://h/o/r/y", "https://h/z/w", None, "https://k/a")
    v = ig.validate_submodule
    assert one(spark, v(F.lit("git://h/x"), F.lit("p")), v(F.lit("https://h/x"), F.lit("a/../b")), v(F.lit("/x"), F.lit("p")), v(F.lit("https://h/x"), F.lit("p")))[:] == ("scheme", "path_escapes", "filesystem_url", None)


def test_submodule_resolution(spark):
    mods = [("https://h/r", "https://h/a", "1", "a"), ("https://h/a", "https://h/b", "2", "b"), ("https://h/b", "https://h/c", "3", "c"), ("https://h/a", "https://h/r", "4", "loop"), ("https://h/r", "https://h/u", None, "u")]
    out = ig.resolve_submodules(spark.createDataFrame([("https://h/r",)], "url string"), spark.createDataFrame(mods, "parent_url string, url string, sha string, path string"))
    assert {(r.path, r.depth, r.status) for r in out.collect()} == {("a", 1, "resolved"), ("u", 1, "unpinned"), ("b", 2, "resolved"), ("loop", 2, "resolved"), ("c", 3, "too_deep"), ("a", 3, "too_deep"), ("u", 3, "too_deep")}


def test_provider_http_pins_limits(spark):
    r = one(spark, ig.provider(F.lit("https://github.com/o/audit.git")), ig.owner_repo(F.lit("https://github.com/o/audit.git"))[1], ig.http_error(F.lit(403), F.lit(0)), ig.http_error(F.lit(404), F.lit(5)), ig.pin_matches(F.lit("abcdef1"), F.lit("ABCDEF1234")), ig.pin_matches(F.lit("abc"), F.lit(None).cast("string")), ig.rate_limit_low(F.lit(9), F.lit(60)), ig.rate_limit_low(F.lit(300), F.lit(5000)))
    assert r[:] == ("github", "audit", "RateLimitError", "NotFoundError", True, False, True, False)


def test_manifest_and_delivery(spark):
    files = spark.createDataFrame([("a.py", b"x", 1), ("b.bin", b"", 0), ("c", b"q\x00", 2)], "path string, content binary, length long")
    m = ig.manifest(files)
    assert {r.relative_path: r.is_binary for r in m.collect()} == {"a.py": False, "b.bin": True, "c": True}
    other = m.where("relative_path <> 'c'").withColumn("sha256", F.when(F.col("relative_path") == "a.py", "0").otherwise(F.col("sha256")))
    assert {r.relative_path: r.status for r in ig.verify_delivery(m, other).collect()} == {"a.py": "tampered", "b.bin": "ok", "c": "missing"}


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁ ｘ", 0.25), (None, 0.0), ("aab", 2 / 3), ("", 0.0)], "text string, share double")
    got = df.select("text", "share", va.nfkc("text").alias("n"), va.common_char_share("text").alias("s")).collect()
    assert [r.n for r in got] == ["fi x", None, "aab", ""] and all(abs(r.s - r.share) < 1e-9 for r in got[1:])


def test_metrics_numbers(spark):
    f = spark.createDataFrame([("CWE-1", "HIGH", 0.9), ("CWE-1", "HIGH", 0.8), ("CWE-2", "MEDIUM", 0.5)], "cwe string, severity string, confidence double")
    assert fi.severity_counts(f).first()[:] == (2, 1, 0, 3)
    assert fi.cwe_counts(f, 1).collect() == [("CWE-1", 2, 0.85)]
    assert one(spark, fi.density(F.lit(50), F.lit(30)), fi.density(F.lit(1), F.lit(0)))[:] == (0.02449, 0.0)
    j = spark.createDataFrame([("c", True, True), ("c", True, False), ("c", False, True), ("d", False, False)], "cwe string, truth boolean, predicted boolean")
    got = {r.cwe: (r.precision, r.recall, r.f1, r.false_positive_rate) for r in fi.detection_metrics(j).collect()}
    assert got == {"c": (0.5, 0.5, 0.5, 1.0), "d": (0.0, 0.0, 0.0, 0.0)}


def test_hash_forms(spark):
    rows = spark.createDataFrame([("g", "b"), ("g", "a")], "g string, p string")
    assert fi.set_hash(rows, ["g"], F.col("p")).first().hash == hashlib.sha256(b"a\nb").hexdigest()
    bucket = sorted(hashlib.sha256(x).hexdigest() for x in (b"a", b"b"))  # the two start with different digits
    assert fi.set_hash(rows, ["g"], F.col("p"), digits=3).first().hash == hashlib.sha256("\n".join(sorted(hashlib.sha256(x).hexdigest() for x in (b"a", b"b"))).encode()).hexdigest() and bucket[0][:3] != bucket[1][:3]


def test_type_map_of_every_language(spark):
    rows = [("javascript", "formal_parameters", "PARAM"), ("tsx", "formal_parameters", "PARAM"), ("python", "attribute", "MEMBER_ACCESS"), ("terraform", "attribute", "ASSIGN"), ("go", "range_clause", "LOOP"), ("java", "method_invocation", "CALL"), ("yaml", "block_mapping", "MAPPING"), ("c", "if_statement", "IF"), ("go", "nothing known", "UNKNOWN")]
    got = no.normalize_types(spark.createDataFrame([r[:2] for r in rows], "language string, raw_type string"), dims.frame(spark, "type_map")).collect()
    assert sorted((r.language, r.raw_type, r.node_type) for r in got) == sorted(rows)
    for tables in (types.GRAPH_TYPES, types.PARSER_TYPES):
        assert len({r[:2] for r in types.rows(tables)}) == len(types.rows(tables))


def test_parser_types_of_every_language(spark):
    rows = [("python", "function_definition", "FUNCTION"), ("python", "assignment", "ASSIGN"), ("python", "if_statement", "IF"), ("python", "else_clause", "ELSE"), ("python", "attribute", "ATTRIBUTE"), ("python", "return_statement", "RETURN"), ("java", "switch_label", "CASE"), ("tsx", "arrow_function", "LAMBDA"), ("cpp", "declaration", "ASSIGN"), ("Terraform", "attribute", "CONFIG_KEY"), ("yaml", "tag", "TYPE_ANNOTATION"), ("go", "composite_literal", "DICT"), ("rust", "match_arm", "CASE"), ("rust", "my_function", "UNKNOWN"), ("cobol", "identifier", "UNKNOWN"), (None, "identifier", "UNKNOWN")]
    got = no.normalize_types(spark.createDataFrame([r[:2] for r in rows], "language string, raw_type string"), dims.frame(spark, "parser_type_map"), guess=False).collect()
    assert sorted(map(str, ((r.language, r.raw_type, r.node_type) for r in got))) == sorted(map(str, rows))
    counts = {k: sum(len(r.split()) for _, r in v) for k, v in types.PARSER_TYPES.items() if not isinstance(v, str)}
    assert counts == {"python": 61, "java": 49, "javascript": 52, "rust": 48, "go": 43, "terraform": 24, "yaml": 17, "c": 33}


def test_own_registry_and_catalog(spark, tmp_path):
    (tmp_path / "r.csv").write_text("language,kind,key,label,confidence,cwe\npython,sinks,my.call,SINK,0.8,CWE-1\n")
    reg = rd.registry(spark, str(tmp_path / "r.csv"))
    nodes = spark.createDataFrame([("1", "CALL", "x.my.call", "", "python"), ("2", "CALL", "os.system", "", "python")], "node_id string, node_type string, name string, raw_text string, language string")
    got = {r.node_id: (r.label, r.confidence, r["pass"]) for r in an.annotate(nodes, reg).collect()}
    assert got == {"1": ("SINK", 0.6, 2), "2": ("SINK", 0.4, 3)}
    (tmp_path / "go.yaml").write_text("patterns:\n  - vuln_type: A\n    cwe: CWE-2\n    severity: LOW\n    node_types: [CALL]\n    sink_pattern: 'f\\('\n    sanitizers: []\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "go.yaml")).select("path", F.col("content").cast("string").alias("text"))
    assert [r[:7] for r in rd.catalog(files).collect()] == [("go", "A", "CWE-2", "LOW", "CALL", "f\\(", "")]


CATALOG_ENTRY = """patterns:

  - vuln_type: "A"
    cwe: "CWE-2"
    severity: LOW
    node_types: [CALL, ASSIGN]
    keywords: ["f(", ".raw(", 'it''s', plain word]
    sink_pattern: 'g\\('
    sources: ["request", "a, b"]
    sinks: []
    sanitizers: ["clean"]
    description: >
      First line
      and second.
    remediation: >
      Do not.
    references:
      - "https://a.org/x"
      - https://b.org
  - vuln_type: B
    description: "Short"
"""


def test_all_fields_of_a_catalog(spark):
    got = rd.catalog(spark.createDataFrame([("x/go.yaml", CATALOG_ENTRY)], "path string, text string")).collect()
    a, b = got
    assert (a.keywords, a.sources, a.sinks, a.references) == (["f(", ".raw(", "it's", "plain word"], ["request", "a, b"], [], ["https://a.org/x", "https://b.org"])
    assert (a.description, a.remediation, b.description, b.vuln_type, b.keywords, b.references) == ("First line and second.", "Do not.", "Short", "B", [], [])
    catalog = rd.catalog(spark.createDataFrame([("x/go.yaml", CATALOG_ENTRY)], "path string, text string")).where("vuln_type = 'A'")
    nodes = [("1", "go", "CALL", "f(x)"), ("2", "go", "CALL", "g(x)"), ("3", "go", "CALL", "h(x)"), ("4", "go", "CALL", "f(clean(x))"), ("5", "go", "IF", "f(x)")]
    assert sorted(r.node_id for r in no.catalog_hits(spark.createDataFrame(nodes, "node_id string, language string, node_type string, raw_text string"), catalog).collect()) == ["1", "2"]
