"""Edge operators against a procedural restatement on random files, and the invariants of the edges."""

import random

import pytest

from sparkloom.operators import graph as gr

KINDS = ["IF", "LOOP", "BREAK", "CONTINUE", "TRY", "CATCH", "RAISE", "FINALLY", "RETURN", "PARAM", "ASSIGN", "AUGMENTED_ASSIGN", "IDENTIFIER", "MEMBER_ACCESS", "CALL", "LITERAL"]
SCHEMA = "file string, ord int, id string, t string, line int, col int, end_line int, fn string, name string, parent_id string"


def random_nodes(seed):
    r, out = random.Random(seed), []
    for f in range(6):
        for k in range(r.randrange(0, 40)):
            line = r.randrange(1, 25)
            out.append((f"f{f}", k, f"f{f}n{k}", r.choice(KINDS), line, r.randrange(0, 3), r.choice([0, line, line + r.randrange(0, 8)]), r.choice(["", "g"]), r.choice(["aa", "bb", "c", "print", ""]), r.choice([None, f"f{f}n{r.randrange(0, 40)}"])))
    return out


def ordered(rows):
    files = {}
    for n in sorted(rows, key=lambda n: (n[0], n[4], n[5], n[1])):
        files.setdefault(n[0], []).append(n)
    return files.values()


def cfg_by_hand(rows):
    out = set()
    for ns in ordered(rows):
        tr = ct = lp = None
        for i, n in enumerate(ns):
            nxt = ns[i + 1][2] if i + 1 < len(ns) else None
            if nxt and n[3] not in gr.SILENT:
                out.add((n[2], nxt, "CFG_NEXT"))
            if n[3] == "IF":
                later = [m for m in ns[i + 1 :] if m[7] == n[7] and m[4] > n[4]]
                yes = next((m[2] for m in later if n[6] == 0 or m[4] <= n[6]), None)
                no = next((m[2] for m in later if n[6] > 0 and m[4] > n[6] and m[3] != "IF"), nxt)
                if yes:
                    out.add((n[2], yes, "CFG_TRUE"))
                if no and no != yes:
                    out.add((n[2], no, "CFG_FALSE"))
            if n[3] == "LOOP" and nxt:
                out |= {(n[2], nxt, "CFG_TRUE"), (n[2], nxt, "CFG_FALSE")}
            if n[3] in ("BREAK", "CONTINUE") and lp:
                out.add((n[2], lp, "CFG_LOOP"))
            if n[3] == "CATCH" and tr:
                out.add((tr, n[2], "CFG_EXCEPTION"))
            if n[3] == "RAISE" and tr:
                out.add((n[2], tr, "CFG_EXCEPTION"))
            if n[3] == "FINALLY":
                out |= {(x, n[2], "CFG_FINALLY") for x in (tr, ct) if x}
            lp = n[2] if n[3] == "LOOP" else lp
            ct = n[2] if n[3] == "CATCH" and tr else ct
            tr = n[2] if n[3] == "TRY" else tr
    return out


@pytest.mark.parametrize("seed", range(4))
def test_control_flow(spark, seed):
    rows = random_nodes(seed)
    got = gr.cfg(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(e.src, e.dst, e.edge_type) for e in got} == cfg_by_hand(rows)
    assert all(e.src != e.dst for e in got)


@pytest.mark.parametrize("seed", range(4))
def test_data_flow(spark, seed):
    rows, want, back = random_nodes(seed + 50), set(), {}
    for ns in ordered(rows):
        defs = {}
        for i, n in enumerate(ns):
            back[n[2]] = i
            if n[3] in gr.DEFINES and n[8]:
                if n[3] != "PARAM" and n[8] in defs:
                    want.add((defs[n[8]], n[2], "DFG_KILLS"))
                defs[n[8]] = n[2]
            elif n[3] in ("IDENTIFIER", "MEMBER_ACCESS") and n[8] in ("aa", "bb") and n[8] in defs:
                want.add((defs[n[8]], n[2], "DFG_FLOW"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(e.src, e.dst, e.edge_type) for e in gr.dfg_kills(df).union(gr.dfg_flows(df)).collect()}
    assert got == want
    assert all(back[a] < back[b] for a, b, _ in got)


def test_depends_by_parent_and_by_range(spark):
    rows = [("f", 0, "call", "CALL", 1, 0, 200, "", "", None), ("f", 1, "kid", "IDENTIFIER", 300, 0, 0, "", "x", "call"), ("f", 2, "near", "LITERAL", 130, 0, 0, "", "", None), ("f", 3, "lost", "LITERAL", 5, 0, 0, "", "", "gone"), ("f", 4, "owned", "LITERAL", 6, 0, 0, "", "", "kid"), ("g", 0, "other", "LITERAL", 5, 0, 0, "", "", None)]
    got = {(e.src, e.dst) for e in gr.dfg_depends(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("kid", "call"), ("near", "call"), ("lost", "call")}


def test_containment(spark):
    rows = [("f", 0, "m", "CLASS", 1, 0, 10, "", "", None), ("f", 1, "a", "FUNCTION", 2, 0, 5, "", "", None), ("f", 2, "b", "CALL", 3, 0, 3, "", "", None), ("f", 3, "c", "CALL", 7, 0, 0, "", "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(e.src, e.dst) for e in gr.ast_edges(df).collect()} == {("m", "a"), ("a", "b"), ("m", "c")}
    assert {(e.src, e.dst) for e in gr.ast_edges(df, "child_first").collect()} == {("m", "a"), ("a", "b")}
    assert {(r.id, r.parent_function) for r in gr.enclosing(df).collect()} == {("m", None), ("a", None), ("b", "a"), ("c", None)}


def test_taint_stops_at_sanitizers_and_cycles(spark):
    nodes = spark.createDataFrame([("s", "SOURCE"), ("x", "NONE"), ("z", "SANITIZER"), ("k", "SINK"), ("k2", "SINK")], "id string, label string")
    edges = spark.createDataFrame([("s", "x"), ("x", "s"), ("x", "k"), ("s", "z"), ("z", "k2")], "src string, dst string")
    assert [(r.source, r.sink, r.depth, r.path) for r in gr.taint_paths(nodes, edges).collect()] == [("s", "k", 2, "s>x>k")]
    assert [tuple(r) for r in gr.taint_reach(nodes, edges).collect()] == [("s", "k", 2)]
    # a chain of nine edges is one path
    chain = spark.createDataFrame([(f"c{k}", "SOURCE" if k == 0 else "SINK" if k == 9 else "NONE") for k in range(10)], "id string, label string")
    links = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(9)], "src string, dst string")
    assert [(r.source, r.sink, r.depth) for r in gr.taint_paths(chain, links).collect()] == [("c0", "c9", 9)] == [tuple(r) for r in gr.taint_reach(chain, links).collect()]


def test_merge_and_known_edges(spark):
    a, b = spark.createDataFrame([(1, "p")], "k int, v string"), spark.createDataFrame([(1, "s"), (2, "s")], "k int, v string")
    assert sorted(gr.merge_results(a, b, ["k"]).collect()) == [(1, "p"), (2, "s")]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("a", "x", "T")], "src string, dst string, edge_type string")
    assert gr.keep_known_edges(edges, nodes).count() == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (gr.cfg, gr.dfg_flows, gr.dfg_kills, gr.dfg_depends, gr.dfg_returns, gr.ast_edges, gr.ast_siblings, gr.cfg_warnings):
        assert f(none).count() == 0
