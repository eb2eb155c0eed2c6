"""Containment by bins of lines against all pairs, and over one file of 200,000 nodes."""

import random

import pytest

from sparkloom.operators import graph as gr, sessions as se

SCHEMA = "file string, ord long, id string, t string, line int, col int, end_line int, fn string, name string"


def by_hand(nodes, mode):
    key = lambda n: (n[4] - n[6], n[4], n[5], n[1])
    out = set()
    for n in nodes:
        if mode == "parent":
            around = [c for c in nodes if c[6] - c[4] >= 1 and c[0] == n[0] and c[4] <= n[4] and max(n[6], n[4]) <= c[6] and key(c) < key(n)]
            if around:
                out.add((max(around, key=key)[2], n[2]))
        elif n[6] - n[4] >= 1:
            inside = [c for c in nodes if c[0] == n[0] and n[4] <= c[4] and max(c[6], c[4]) <= n[6] and key(c) > key(n)]
            if inside:
                out.add((n[2], min(inside, key=key)[2]))
    return out


@pytest.mark.parametrize("mode", ["parent", "child_first"])
def test_containment_equals_all_pairs(spark, mode):
    r = random.Random(7)
    nodes = []
    for f in ("a", "b"):
        for k in range(120):
            line = r.randrange(1, 300)
            nodes.append((f, k, f"{f}{k}", r.choice(["CALL", "FUNCTION"]), line, r.randrange(3), line + r.choice([0, 0, 0, 1, 2, 5, 17, 64, 200]) if r.random() < 0.95 else 0, "", ""))
    got = gr.ast_edges(spark.createDataFrame(nodes, SCHEMA), mode).collect()
    assert {(x.src, x.dst) for x in got} == by_hand(nodes, mode) and len(got) == len(by_hand(nodes, mode))


def test_enclosing_function(spark):
    r = random.Random(8)
    nodes = [("a", k, f"n{k:03d}", r.choice(["CALL", "FUNCTION"]), (line := r.randrange(1, 200)), 0, line + r.choice([0, 1, 3, 9, 50]), "", "") for k in range(100)]
    want = {}
    for n in nodes:
        around = [c for c in nodes if c[3] == "FUNCTION" and c[4] <= n[4] and n[6] <= c[6] and c[2] != n[2]]
        want[n[2]] = min(around, key=lambda c: (c[6] - c[4], c[2]))[2] if around else None
    assert {x.id: x.parent_function for x in gr.enclosing(spark.createDataFrame(nodes, SCHEMA)).collect()} == want


def test_a_file_of_many_nodes(spark):
    """200,000 nodes, nested six deep: a join on the file alone would meet 2e10 pairs."""
    n = 200_000
    spans = "case when id % 1000 = 0 then 999 when id % 100 = 0 then 99 when id % 10 = 0 then 9 else 0 end"
    nodes = spark.range(n).selectExpr("'f' as file", "id as ord", "concat('n', id) as id", "case when id % 10 = 0 then 'FUNCTION' else 'CALL' end as t", "cast(id + 1 as int) as line", "0 as col", f"cast(id + 1 + {spans} as int) as end_line", "'' as fn", "'' as name")
    parent = gr.ast_edges(nodes)
    wrong = parent.selectExpr("cast(substring(src, 2) as long) as p", "cast(substring(dst, 2) as long) as c").where("p <> case when c % 10 <> 0 then c - c % 10 when c % 100 <> 0 then c - c % 100 else c - c % 1000 end")
    assert parent.count() == n - n // 1000 and wrong.isEmpty()
    inner = gr.enclosing(nodes).where("parent_function is not null").count()
    assert inner == n - n // 1000
    branches = se.conditional_branches(nodes.selectExpr("file", "ord", "id", "case when t = 'FUNCTION' then 'CONDITIONAL' else t end as t", "line", "col", "end_line"))
    assert branches.count() == 2 * (n // 10)
