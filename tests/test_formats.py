"""Registered readers against the functions over texts, and git's own listing."""

import json
import subprocess

import pytest

from pyspark.sql import functions as F

from sparkloom.sources import formats as fo, readers as rd

SARIF = {"runs": [{"results": [
    {"ruleId": "r1", "level": "error", "message": {"text": "x"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///a.py"}, "region": {"startLine": 3, "startColumn": 5}}}], "relatedLocations": [{"physicalLocation": {"artifactLocation": {"uri": "./b\\c.py"}, "region": {"startLine": 1}}}]},
    {"ruleId": "r2", "level": "note", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "z.py"}, "region": {"startLine": 9}}}]},
    {"ruleId": "r3", "locations": []},
]}, {"results": []}]}


@pytest.fixture(scope="module")
def session(spark):
    return fo.register(spark)


def test_sarif_agrees(session, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.sarif").write_text(json.dumps(SARIF))
    (tmp_path / "x.json").write_text("{")
    df = session.read.format("loom-sarif").option("bytesPerPartition", "100").load(str(tmp_path))
    columns = ["rule_id", "level", "file", "line", "col", "rel_file", "rel_line", "rel_col"]
    texts = session.read.format("binaryFile").load(f"{tmp_path}/*.sarif").select(rd.as_text(F.col("content")).alias("json"))
    assert sorted(map(str, df.select(*columns).collect())) == sorted(map(str, rd.sarif_results(texts).select(*columns).collect()))
    assert df.rdd.getNumPartitions() == 3
    assert df.where("level = 'error'").count() == 3 and df.where("level in ('note', 'none')").count() == 3
    one = df.where(F.col("report") == str(tmp_path / "1.sarif"))
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1
    assert df.where("line > 5").count() == 3


def test_broken_reports(session, tmp_path):
    (tmp_path / "a.sarif").write_text("{")
    (tmp_path / "b.sarif").write_text(json.dumps(SARIF))
    read = session.read.format("loom-sarif")
    with pytest.raises(Exception):
        read.load(str(tmp_path)).count()
    assert read.option("mode", "permissive").load(str(tmp_path)).count() == 2
    assert session.read.format("loom-sarif").option("pattern", "*.none").load(str(tmp_path)).count() == 0


def test_graphml_agrees(session, tmp_path):
    (tmp_path / "g.graphml").write_text('<?xml version="1.0"?><graphml><key id="k" attr.name="label"/><key id="c" attr.name="code"/><graph><node id="1"><data key="k">CALL</data><data key="c">f()</data></node><node id="2"/><edge source="1" target="2"><data key="k">AST</data></edge></graph></graphml>')
    nodes, edges = rd.graphml(session, str(tmp_path / "g.graphml"))
    df = session.read.format("loom-graphml").load(str(tmp_path))
    assert sorted((r.id, r.props or {}) for r in df.where("kind = 'node'").collect()) == sorted((r.id, r.props or {}) for r in nodes.collect())
    assert [(r.src, r.dst, r.edge_type) for r in df.where("kind = 'edge'").collect()] == [(r.src, r.dst, r.edge_type) for r in edges.collect()]


def test_gitmodules_agrees(session, tmp_path):
    text = '[core]\n\tx = 1\n[submodule "a b"]\n\tpath = libs/a\n\turl = https://x/y.git\n[submodule "c"]\n\turl=../z\n\tbranch = main\r\n'
    (tmp_path / ".gitmodules").write_text(text)
    want = rd.gitmodules(session.createDataFrame([(text,)], "text string")).select("name", "path", "url", "branch")
    got = session.read.format("loom-gitmodules").load(str(tmp_path)).select("name", "path", "url", "branch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("version", [2, 3, 4])
def test_git_index_agrees_with_git(session, tmp_path, version):
    def git(*a):
        return subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, text=True, check=True).stdout

    git("init", "-q")
    for name in ("a.txt", "dir/some long name.py", "dir/some longer name.py", "é.c", *(f"d{k}/" + "x" * k for k in range(1, 20))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    git("add", ".")
    git("update-index", "--add", "--cacheinfo", "160000," + "ab" * 20 + ",libs/sub")
    if version == 3:
        (tmp_path / "later").write_text("x")
        git("add", "-N", "later")  # an extended flag makes it version 3
    elif version == 4:
        git("update-index", "--index-version", "4")
    want = [(m[0], m[1], m[2], p) for m, p in ((x.split("\t")[0].split(" "), x.split("\t")[1]) for x in git("-c", "core.quotepath=off", "ls-files", "-s").splitlines())]
    df = session.read.format("loom-gitindex").load(str(tmp_path / ".git"))
    assert sorted((f"{r.mode:06o}", r.sha, str(r.stage), r.path) for r in df.collect()) == sorted(want)
    listing = session.createDataFrame([("100644 blob " + "0" * 40 + "\ta.txt",)], "line string")
    assert [tuple(r) for r in rd.pinned_commits(listing, df).collect()] == [("libs/sub", "ab" * 20)]
    listing = session.createDataFrame([("160000 commit " + "c" * 40 + "\tlibs/sub",)], "line string")
    assert [tuple(r) for r in rd.pinned_commits(listing, df).collect()] == [("libs/sub", "c" * 40)]


def test_no_index():
    with pytest.raises(ValueError):
        list(fo.GitIndex.rows(b"DIRX" + b"\0" * 20))
    with pytest.raises(ValueError):
        list(fo.GitIndex.rows(b"DIRC" + (9).to_bytes(4, "big") + b"\0" * 8))
