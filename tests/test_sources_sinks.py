import json

import pytest

from pyspark.sql import functions as F

from sparkloom.sources import readers as rd, writers as wr


def test_repository_skips_and_reads(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "node_modules/b.js").write_text("no")
    got = rd.repository(spark, str(tmp_path)).select(rd.relative_path(F.col("path"), str(tmp_path)).alias("p"), rd.as_text(F.col("content")).alias("t")).collect()
    assert [(r.p, r.t) for r in got] == [("src/a.py", "x = '�'\n")]
    assert rd.repository(spark, str(tmp_path), max_bytes=2).count() == 0
    assert rd.repository(spark, str(tmp_path), max_bytes=8).count() == 1


def test_relative_path_keeps_dot_names(spark):
    row = spark.range(1).select(rd.relative_path(F.lit("file:///r/./x"), "/r").alias("a"), rd.relative_path(F.lit(".github/x"), "").alias("b"), rd.relative_path(F.lit("./a\\b"), "").alias("c")).first()
    assert (row.a, row.b, row.c) == ("x", ".github/x", "a/b")


def test_sarif(spark):
    doc = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "r", "properties": {"tags": ["external/cwe/cwe-089", "x"]}}]}}, "results": [
        {"ruleId": "r", "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "./a.py"}, "region": {"startLine": 3, "startColumn": 5}}}], "relatedLocations": [{"physicalLocation": {"artifactLocation": {"uri": "b.py"}, "region": {"startLine": 1}}}]},
        {"ruleId": "q", "locations": []}]}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "json string")
    (r,) = rd.sarif_results(df).collect()
    assert (r.rule_id, r.file, r.line, r.col, r.rel_file, r.rel_line, r.rel_col) == ("r", "a.py", 3, 4, "b.py", 1, 0)
    assert rd.sarif_rule_cwes(df).collect() == [("r", "CWE-89")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        rd.sarif_results(spark.createDataFrame([("{bad",)], "json string")).collect()


def test_json_graph(spark):
    doc = {"nodes": [{"id": "1", "_label": "CALL", "code": "f()", "lineNumber": 2}, {"_id": "2", "nodeType": "META_DATA"}], "edges": [{"outV": "1", "inV": "2", "label": "CFG"}, {"src": "1", "dst": "2", "edgeType": "odd"}]}
    nodes, edges = rd.json_graph(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    assert [(n.id, n.raw_type, n.line) for n in nodes.collect()] == [("1", "CALL", 2)]
    assert sorted(e.edge_type for e in edges.collect()) == ["AST_CHILD", "CFG_NEXT"]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<graphml><key id="k0" for="node" attr.name="CODE" attr.type="string"/><key id="k1" for="edge" attr.name="labelE"/><graph><node id="1"><data key="k0">f()</data></node><node id="2"/><edge source="1" target="2"><data key="k1">REACHING_DEF</data></edge></graph></graphml>')
    nodes, edges = rd.graphml(spark, str(tmp_path / "g.xml"))
    assert {r.id: r.props for r in nodes.collect()}["1"] == {"CODE": "f()"}
    assert [(r.src, r.dst, r.edge_type) for r in edges.collect()] == [("1", "2", "DFG_FLOW")]


def test_graphml_keys_count_in_their_file(spark, tmp_path):
    for name, attribute in (("a", "CODE"), ("b", "NAME")):
        (tmp_path / f"{name}.xml").write_text(f'<graphml><key id="d0" for="node" attr.name="{attribute}"/><graph><node id="1"><data key="d0">{name}</data></node></graph></graphml>')
    got = {r.file.rsplit("/", 1)[1]: (r.id, r.props) for r in rd.graphml(spark, str(tmp_path))[0].collect()}
    assert got == {"a.xml": ("1", {"CODE": "a"}), "b.xml": ("1", {"NAME": "b"})}


@pytest.mark.parametrize("few", [0, 1000])
def test_graphml_edges_between_the_same_nodes(spark, tmp_path, monkeypatch, few):
    """Each edge has its own type and attributes, whatever others its ends have; keys count in their file."""
    monkeypatch.setattr(rd, "FEW_FILES", few)
    for name, key in (("a", '<key id="k" attr.name="labelE"/><key id="n" attr.name="note"/>'), ("b", '<key id="n" attr.name="labelE"/>'), ("c", "")):
        edges = '<edge source="1" target="2"><data key="k">AST</data></edge><edge source="1" target="2"><data key="k">CFG</data><data key="n">y</data><data key="n">x</data><data key="n"/></edge><edge source="1" target="2"/>'
        (tmp_path / f"{name}.xml").write_text(f"<graphml>{key}<graph>{edges}</graph></graphml>")
    got = sorted((r.file[-5], r.src, r.dst, r.edge_type, sorted(r.props.items())) for r in rd.graphml(spark, str(tmp_path))[1].collect())
    plain = [("AST_CHILD", []), ("AST_CHILD", [("k", "AST")])]
    want = {"a": [("AST_CHILD", []), ("AST_CHILD", [("labelE", "AST")]), ("CFG_NEXT", [("labelE", "CFG"), ("note", "x")])], "b": [*plain, ("AST_CHILD", [("k", "CFG"), ("labelE", "x")])], "c": [*plain, ("AST_CHILD", [("k", "CFG"), ("n", "x")])]}
    assert got == sorted((f, "1", "2", *e) for f in want for e in want[f])


def test_graphml_edges_are_read_from_few_files(spark, data):
    from sparkloom.plans import stores as st

    root = st._graphml_files(spark, data, 3)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    assert files.count() == 3
    from xml.etree import ElementTree

    graphs = [ElementTree.fromstring(r.content) for r in files.collect()]
    assert sum(len(g.findall(".//node")) for g in graphs) == spark.read.parquet(f"{data}/events.parquet").count()


def test_reports_and_session_reads(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.sarif").write_text('{"runs":[]}')
    assert rd.first_report(spark, str(tmp_path)).first().path.endswith("/a.sarif") and rd.first_report(spark, str(tmp_path), "*.none").count() == 0
    rows = spark.createDataFrame([("s1", "n2", "CALL", "f", "a.py", 2, "SINK", 0.9, "CWE-1", "x"), ("s1", "n1", "CALL", "g", "a.py", 1, "NONE", 0.0, "", "y"), ("s2", "n3", "CALL", "h", "b.py", 1, "NONE", 0.0, "", "z")], "session_id string, node_id string, node_type string, name string, file_path string, line int, label string, confidence double, cwe string, raw_text string")
    rows.write.partitionBy("session_id").parquet(str(tmp_path / "nodes"))
    assert [r.node_id for r in rd.session_rows(spark, str(tmp_path / "nodes"), "s1", order=["line"]).collect()] == ["n1", "n2"]
    index = rd.node_index(spark, str(tmp_path / "nodes"), "s1")
    assert index.columns == rd.INDEX and index.count() == 2
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan and "raw_text" not in plan


def test_csv_and_git_texts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("kind,name,file,line,col\ncall,f,a.py,3,1\ncall,g,a.py,x,1\n")
    assert [tuple(r) for r in rd.structure_csv(spark, str(tmp_path / "s.csv")).collect()] == [("call", "f", "a.py", 3, 1)]
    text = '[submodule "a"]\n\tpath = libs/a\n\turl = ../a.git\n[submodule "b"]\n path=b\n url = https://h/b\n branch = main\n'
    got = rd.gitmodules(spark.createDataFrame([(1, text)], "repo int, text string")).collect()
    assert [(r.name, r.path, r.url, r.branch) for r in got] == [("a", "libs/a", "../a.git", ""), ("b", "b", "https://h/b", "main")]
    listing = spark.createDataFrame([("160000 commit " + "a" * 40 + "\tlibs/a",), ("100644 blob " + "b" * 40 + "\tx",)], "line string")
    assert [tuple(r) for r in rd.gitlinks(listing).collect()] == [("libs/a", "a" * 40)]
    head = spark.range(1).select(rd.head_commit(F.lit("ref: refs/heads/m"), F.create_map(F.lit("x"), F.lit("y")), F.lit("# p\n" + "c" * 40 + " refs/heads/m")).alias("h")).first().h
    assert head == "c" * 40


def test_python_ast(spark):
    got = rd.python_ast(spark.createDataFrame([("a.py", "def f(x):\n    return g(x)\n"), ("b.py", "def (")], "file_path string, text string")).collect()
    kinds = [r.raw_type for r in got if r.file_path == "a.py"]
    assert kinds[0] == "Module" and {"FunctionDef", "Return", "Call", "Name"} <= set(kinds)
    assert [r.raw_type for r in got if r.file_path == "b.py"] == ["error"]
    ids = {r.node_id for r in got}
    assert all(r.parent_id in ids for r in got if r.parent_id)


def test_upsert_and_delete(spark, tmp_path):
    path = str(tmp_path / "nodes")
    schema = "session_id string, node_id string, v int"
    wr.upsert(spark, spark.createDataFrame([("s1", "a", 1), ("s1", "b", 1), ("s2", "a", 1)], schema), path, ["node_id"])
    wr.upsert(spark, spark.createDataFrame([("s1", "a", 2), ("s1", "a", 3), ("s1", "c", 1)], schema), path, ["node_id"], order="v")
    got = sorted((r.session_id, r.node_id, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("s1", "a", 3), ("s1", "b", 1), ("s1", "c", 1), ("s2", "a", 1)]
    # a null of a new row keeps the old value, a new column is added
    wr.upsert(spark, spark.createDataFrame([("s1", "a", None, "w")], schema + ", w string"), path, ["node_id"])
    got = {r.node_id: (r.v, r.w) for r in spark.read.option("mergeSchema", True).parquet(path).where("session_id = 's1'").collect()}
    assert got == {"a": (3, "w"), "b": (1, None), "c": (1, None)}
    assert wr.delete_session(spark, path, "s1") == 3
    assert spark.read.parquet(path).count() == 1


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_writes_a_file_a_session_and_only_what_changes(spark, tmp_path):
    path, schema = tmp_path / "t", "session_id string, node_id string, v int"
    rows = [(s, f"n{k}", k) for s in ("007", "7", "a/b", None) for k in range(40)]
    wr.upsert(spark, spark.createDataFrame(rows, schema).repartition(4), str(path), ["node_id"])
    first = _files(path)
    assert len(first) == 4
    wr.upsert(spark, spark.createDataFrame(rows, schema), str(path), ["node_id"])
    assert _files(path) == first
    wr.upsert(spark, spark.createDataFrame([("7", "n1", -1), ("7", "n2", None)], schema), str(path), ["node_id"])
    assert len(set(_files(path)) & set(first)) == 3
    want = [(s, n, -1 if (s, n) == ("7", "n1") else v) for s, n, v in rows]
    got = spark.read.schema("node_id string, v int, session_id string").parquet(str(path)).select("session_id", "node_id", "v")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_many_sessions_in_buckets(spark, tmp_path):
    path, schema = tmp_path / "t", "session_id string, edge_id string, v int"
    rows = [(f"{s:03}", f"e{k}", k) for s in range(60) for k in range(4)]
    wr.upsert(spark, spark.createDataFrame(rows, schema).repartition(4), str(path), ["edge_id"], buckets=5)
    first = _files(path)
    assert len(first) == 5
    wr.upsert(spark, spark.createDataFrame(rows, schema), str(path), ["edge_id"])
    assert _files(path) == first
    wr.upsert(spark, spark.createDataFrame([("003", "e1", 9), ("003", "new", 8)], schema), str(path), ["edge_id"])
    assert len(set(_files(path)) & set(first)) == 4
    want = {(s, e): v for s, e, v in rows} | {("003", "e1"): 9, ("003", "new"): 8}
    one = rd.session_rows(spark, str(path), "003")
    assert sorted(one.columns) == ["edge_id", "session_id", "v"] and {(r.session_id, r.edge_id): r.v for r in one.collect()} == {k: v for k, v in want.items() if k[0] == "003"}
    assert wr.delete_session(spark, str(path), "3") == 0 and wr.delete_session(spark, str(path), "003") == 5 and wr.delete_session(spark, str(path), "003") == 0
    got = spark.read.parquet(str(path)).collect()
    assert len(got) == 236 and {(r.session_id, r.edge_id): r.v for r in got} == {k: v for k, v in want.items() if k[0] != "003"}
    # a bucket of one session goes with it
    wr.upsert(spark, spark.createDataFrame([("x", "e", 1)], schema), str(tmp_path / "one"), ["edge_id"], buckets=5)
    assert wr.delete_session(spark, str(tmp_path / "one"), "x") == 1 and not _files(tmp_path / "one")


def test_edges_need_nodes(spark, tmp_path):
    nodes = spark.createDataFrame([("s", "a"), ("s", "b")], "session_id string, node_id string")
    edges = spark.createDataFrame([("s", "e1", "a", "b"), ("s", "e2", "a", "zz")], "session_id string, edge_id string, src string, dst string")
    wr.write_edges(spark, edges, nodes, str(tmp_path / "e"))
    assert [r.edge_id for r in spark.read.parquet(str(tmp_path / "e")).collect()] == ["e1"]


def test_delivery_documents_marks_audit(spark, tmp_path):
    content = spark.createDataFrame([("a", b"x"), ("b", b"y")], "relative_path string, content binary")
    approved = content.select("relative_path", F.sha2(F.when(F.col("relative_path") == "a", F.col("content")).otherwise(F.lit(b"z")), 256).alias("sha256"))
    assert [r.relative_path for r in wr.deliver(approved, content).collect()] == ["a"]
    wr.documents(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == '{"a":1,"b":"x"}'
    wr.append_audit(spark.createDataFrame([("s", "ok")], "session_id string, result string"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1
    n = spark.createDataFrame([("a", False), ("b", False)], "node_id string, annotated boolean")
    assert sorted(wr.mark(n, spark.createDataFrame([("b", True)], "node_id string, annotated boolean")).collect()) == [("a", False), ("b", True)]


def test_tables_are_made_once(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert wr.create_tables(spark, root) == list(wr.TABLES) and wr.create_tables(spark, root) == []
    assert spark.read.parquet(f"{root}/edges").columns == ["session_id", "edge_id", "src", "dst", "edge_type"]
    assert wr.to_memory(spark.createDataFrame([("s", 1)], "session_id string, n int"), "rows_of_s").count() == 1
