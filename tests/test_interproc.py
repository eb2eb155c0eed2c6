"""Flows across functions against a walk with explicit call stacks, on random programs with recursion."""

import random
from collections import defaultdict

import pytest

from sparkloom.operators import interproc as ip
from sparkloom.scratch import Scratch

SCHEMAS = {"flows": "src string, dst string", "args": "call string, position int, arg string", "params": "function string, position int, param string", "returns": "function string, ret string", "calls": "call string, caller string, function string"}


def random_program(rng, functions, acyclic):
    p = {k: [] for k in SCHEMAS}
    for f in range(functions):
        nodes = [f"n{f}_{k}" for k in range(8)]
        p["params"] += [(f"f{f}", 1, nodes[0]), (f"f{f}", 2, nodes[1])]
        p["returns"].append((f"f{f}", nodes[7]))
        p["flows"] += [tuple(rng.sample(nodes, 2)) for _ in range(6)]
        for k in (4, 5):
            to = rng.randrange(f + 1, functions) if acyclic and f + 1 < functions else rng.randrange(functions)
            if not acyclic or to > f:
                p["calls"].append((nodes[k], f"f{f}", f"f{to}"))
                p["args"] += [(nodes[k], i, rng.choice(nodes)) for i in (1, 2) if rng.random() < 0.8]
    return p


def walks(p, start, matched):
    """Pairs (root, node): reachable with an empty stack (matched) or at all. Summaries are found first by a plain fixpoint, as stacks of recursive programs don't end."""
    flows, owner, known = defaultdict(set), {x: (f, i) for f, i, x in p["params"]}, set()
    returns, ret_of = {r: f for f, r in p["returns"]}, defaultdict(set)
    for f, r in p["returns"]:
        ret_of[f].add(r)
    for a, b in p["flows"]:
        flows[a].add(b)
    callee = defaultdict(set)
    for c, _, f in p["calls"]:
        callee[c].add(f)

    def across():
        out = defaultdict(set)
        for c, i, a in p["args"]:
            for f in callee[c]:
                if (f, i) in known:
                    out[a].add(c)
        return out

    def reach(x, *maps):
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for m in maps:
                for z in m[y] - seen:
                    seen.add(z)
                    todo.append(z)
        return seen

    while True:
        over = across()
        more = {owner[x] for x in owner for y in reach(x, flows, over) if returns.get(y) == owner[x][0]}
        if more == known:
            break
        known = more
    if matched:
        return known
    up, down = defaultdict(set), defaultdict(set)
    for c, _, f in p["calls"]:
        for r in ret_of[f]:
            up[r].add(c)
    by = {(f, i): x for f, i, x in p["params"]}
    for c, i, a in p["args"]:
        for f in callee[c]:
            if (f, i) in by:
                down[a].add(by[f, i])
    return {(x, z) for x in start for y in reach(x, flows, over, up) for z in reach(y, flows, over, down)}


@pytest.mark.parametrize("seed,acyclic", [(1, True), (2, False)])
def test_flows_match_calls_and_returns(spark, seed, acyclic):
    rng = random.Random(seed)
    p = random_program(rng, 14, acyclic)
    program = ip.Program(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in p.items()})
    assert {tuple(r) for r in ip.summaries(program).collect()} == walks(p, [], True)
    nodes = sorted({x for e in p["flows"] for x in e})
    sources, sinks = rng.sample(nodes, 12), set(rng.sample(nodes, 30))
    ids = lambda x: spark.createDataFrame([(v,) for v in x], "id string")
    got = {tuple(r) for r in ip.flows_between(program, ids(sources), ids(sinks)).collect()}
    assert got == {(a, b) for a, b in walks(p, sources, False) if b in sinks} and got


def test_a_value_does_not_leave_by_another_call(spark):
    """id(a) and id(b): a reaches the first call's value only, two calls deep."""
    p = {
        "flows": [("p", "r"), ("q", "a2"), ("c2", "s")], "params": [("id", 1, "p"), ("twice", 1, "q")], "returns": [("id", "r"), ("twice", "s")],
        "calls": [("c2", "twice", "id"), ("x", "main", "twice"), ("y", "main", "twice")], "args": [("c2", 1, "a2"), ("x", 1, "a"), ("y", 1, "b")],
    }
    program = ip.Program(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in p.items()})
    got = ip.flows_between(program, spark.createDataFrame([("a",), (None,)], "id string"), spark.createDataFrame([("x",), ("y",), ("r",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("a", "r")}
    assert {tuple(r) for r in ip.summaries(program).collect()} == {("id", 1), ("twice", 1)}


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_mutual_reach(spark, seed):
    rng = random.Random(seed)
    names = [f"f{k:02}" for k in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(48)]
    got = {r.function: r for r in ip.call_components(spark.createDataFrame([*edges, (None, "f01"), ("f02", None), ("f03", "unknown")], "caller string, function string"), spark.createDataFrame([(n,) for n in names], "function string")).collect()}
    to = {n: set() for n in names}
    for _ in names:
        for a, b in edges:
            to[a] |= {b} | to[b]
    comp = {n: max({n} | {m for m in to[n] if n in to[m]}) for n in names}
    level = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in edges:
            if comp[a] != comp[b]:
                low = level[b] + 1
                for m in names:
                    if comp[m] == comp[a]:
                        level[m] = max(level[m], low)
    assert {n: (r.component, r.recursive, r.level) for n, r in got.items()} == {n: (comp[n], n in to[n], level[n]) for n in names}


NODES = "file string, id string, t string, name string, parent_function string"


def random_nodes(rng, files, functions, calls, names):
    """Functions of files, calls in them or outside, of names that their file has, others have, or none has."""
    made = [(f"a{k % files}", f"f{k:02}", "FUNCTION", rng.choice(["", *names]), None) for k in range(functions)]
    return made + [(f := rng.choice(made), (f[0], f"c{k}", "CALL", rng.choice(["", "x.y."]) + rng.choice([*names, "unknown"]), f[1] if rng.random() < 0.9 else None))[1] for k in range(calls)]


def linked(nodes):
    out = []
    for file, call, t, name, caller in nodes:
        if t == "CALL":
            those = [(f, g) for f, g, kind, n, _ in nodes if kind == "FUNCTION" and n and n == name.rsplit(".", 1)[-1]]
            near = [g for f, g in those if f == file]
            out += [(call, caller, g) for g in near or [g for _, g in those]]
    return out


@pytest.mark.parametrize("sizes", [(1024, 128, 128, 1 << 23), (3, 2, 2, 40)])
def test_links_equal_a_loop(spark, monkeypatch, sizes):
    for name, value in zip(("PART", "BLOCK", "GROUP", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(ip, name, value)
    nodes = random_nodes(random.Random(5), 9, 60, 80, ["n1", "n2", "n3", "n4"])
    got = [tuple(r) for r in ip.link_calls(spark.createDataFrame(nodes, NODES)).collect()]
    assert sorted(got, key=repr) == sorted(linked(nodes), key=repr) and len(got) > 200
    assert ip.link_calls(spark.createDataFrame(nodes[:60], NODES)).collect() == []


def test_links_of_a_name_with_many_functions_are_small(spark, tmp_path):
    """4,000,000 links, written in less than half a byte each."""
    n = spark.range(20_200).selectExpr("concat('a', id) as file", "concat('e', id * 7919) as id", "if(id < 200, 'CALL', 'FUNCTION') as t", "'n' as name", "cast(null as string) as parent_function")
    ip.link_calls(n.orderBy("id")).write.parquet(str(tmp_path / "links"))
    assert spark.read.parquet(str(tmp_path / "links")).count() == 4_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "links").glob("*.parquet")) < 2_000_000


@pytest.mark.parametrize("seed,calls", [(1, 14), (2, 25), (3, 60)])
def test_components_through_names(spark, seed, calls):
    """Names in place of their pairs: the same components, recursion and levels as with the pairs."""
    nodes = random_nodes(random.Random(seed), 15, 40, calls, [f"n{k}" for k in range(12)])
    df = spark.createDataFrame(nodes, NODES)
    functions, scratch = df.where("t = 'FUNCTION'").selectExpr("id as function"), Scratch(spark, "names")
    named = ip.calls_by_name(df, scratch)
    got = ip.call_components(named.near, functions, scratch, named).collect()
    want = ip.call_components(spark.createDataFrame(linked(nodes), "call string, caller string, function string"), functions).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 40 and max(r.level for r in got)


def test_components_do_not_list_the_pairs_of_a_name(spark):
    n = spark.range(4000).selectExpr("concat('a', cast(id / 2 as int)) as file", "concat('e', id) as id", "if(id % 2 = 0, 'FUNCTION', 'CALL') as t", "if(id % 4 < 2, if(id % 2 = 0, 'n', 'm'), if(id % 2 = 0, 'm', 'n')) as name", "if(id % 2 = 1, concat('e', id - 1), null) as parent_function")
    scratch = Scratch(spark, "pairs")
    named = ip.calls_by_name(n, scratch)
    got = ip.call_components(named.near, n.where("t = 'FUNCTION'").selectExpr("id as function"), scratch, named).collect()
    assert {(r.component, r.recursive, r.level) for r in got} == {("e998", True, 0)} and len(got) == 2000
    assert max(spark.read.parquet(p).count() for p in scratch.made if not p.endswith("-gone")) <= 4000


def test_empty_program(spark):
    program = ip.Program(**{k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()})
    assert ip.summaries(program).collect() == []
    assert ip.reserved_edges(program).collect() == []
    one = spark.createDataFrame([("x",)], "id string")
    assert [tuple(r) for r in ip.flows_between(program, one, one).collect()] == [("x", "x")]
