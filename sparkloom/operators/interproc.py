"""Data flow across functions: reserved edge kinds, call components, function summaries, flows whose calls and returns match.

A program is five tables (``Program``): flows inside functions, arguments and parameters by position, returned nodes, and which function a call
calls. A call's node stands for its value. All of it is equi joins on node, call or function ids, advanced by what is new in each round
and written out, so a plan holds one round; a function that everything calls is a hot key of one side only, which skew-join splitting takes.

* ``summaries``: parameter k of f flows to what f returns. Callees come first: functions are taken by their level in the condensed call
  graph, and only components with recursion go round again.
* ``flows_between``: from source to sink along flows, summaries, and then either out of functions (a returned node to each call of its
  function) or into them (an argument to its parameter), never out again after having gone in: what goes in and comes out is a summary's.
  So a value that enters a function at one call does not come out at another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch


@dataclass
class Program:
    """flows: src, dst. args: call, position, arg. params: function, position, param. returns: function, ret. calls: call, caller, function."""

    flows: DataFrame
    args: DataFrame
    params: DataFrame
    returns: DataFrame
    calls: DataFrame


@dataclass
class Named:
    """Calls by name. near: call, caller, function of the call's file. far: call, caller, called, a name that no function of the call's file has; it calls them all. functions: function, called, its name."""

    near: DataFrame
    far: DataFrame
    functions: DataFrame


def calls_by_name(nodes: DataFrame, scratch: Scratch) -> Named:
    """Calls of nodes (file, id, t, name, parent_function), written out. Methods are called by their last name part; a call outside any function has a null caller."""
    last = F.when(F.col("t") == "CALL", F.regexp_extract("name", r"([^.]*)$", 1)).otherwise(F.col("name"))
    held = scratch.put(nodes.where("t = 'CALL' or t = 'FUNCTION' and name <> ''").select("file", "t", "id", last.alias("called"), "parent_function"), "named")
    calls = held.where("t = 'CALL'").select("file", F.col("id").alias("call"), F.col("parent_function").alias("caller"), "called")
    functions = held.where("t = 'FUNCTION'").select("file", F.col("id").alias("function"), "called")
    near = scratch.put(calls.join(functions, ["file", "called"]).select("call", "caller", "function"), "near")
    far = scratch.put(calls.join(near.select("call").distinct(), "call", "left_anti").select("call", "caller", "called"), "far")
    return Named(near, far, functions.select("function", "called"))


#: Where calls meet all functions of their name, about: calls of a part, functions of a block, blocks of a group, pairs that a task lists.
PART, BLOCK, GROUP, PAIRS = 1024, 128, 128, 1 << 23


def _pairs(far: DataFrame, functions: DataFrame, scratch: Scratch) -> DataFrame:
    """call, caller, function: each call with each function of its name.

    These are as many as both sides of a name multiplied, and so is the work, but not what is shuffled: parts of calls and blocks of functions are arrays, the
    blocks copied for each part of their name, the parts for each group of blocks. The tasks are as many as the pairs ask for; a row of a task is one
    block and one part. A block is listed for one call after another, which repeats within what a column's compression sees, however many functions a name has.
    """
    n, m = F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("m")
    parts, blocks = F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.col("m") / BLOCK).alias("blocks")
    sizes = far.groupBy("called").agg(n).join(functions.groupBy("called").agg(m), "called").select("called", parts, blocks, (F.col("n") * F.col("m")).alias("pairs"))
    sizes = scratch.put(sizes, "sizes")
    tasks = 1 + (sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    left = functions.join(sizes, "called").groupBy("called", "parts", F.pmod(F.xxhash64("function"), "blocks").alias("block")).agg(F.collect_list("function").alias("functions"))
    left = left.select("called", "functions", F.floor(F.col("block") / GROUP).alias("group"), upto(F.col("parts")).alias("part"))
    right = far.join(sizes, "called").groupBy("called", "blocks", F.pmod(F.xxhash64("call"), "parts").alias("part")).agg(F.collect_list(F.struct("call", "caller")).alias("calls"))
    right = right.select("called", "calls", upto(F.ceil(F.col("blocks") / GROUP)).alias("group"), "part")
    key = ["called", "group", "part"]
    # by merging: a block meets one part, and what both list is all that a task holds of the pairs at once
    both = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key)
    return both.select("functions", F.explode("calls").alias("c")).select("c.call", "c.caller", F.explode("functions").alias("function"))


def link_calls(nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """call, caller, function for CALL nodes by name: the functions of that name in the same file, else those of any file.

    nodes: file, id, t, name, parent_function. Methods are called by their last name part. A call of an unknown name is left out; one
    outside any function has a null caller.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "links")
    named = calls_by_name(nodes, scratch)
    return named.near.unionByName(_pairs(named.far, named.functions, scratch))


def reserved_edges(program: Program) -> DataFrame:
    """src, dst, edge_type: PARAM_OF (parameter to its function), ARG_OF (argument to its call), RETURNS_TO (returned node to each call of its function)."""
    p = program
    kinds = [
        p.params.select(F.col("param").alias("src"), F.col("function").alias("dst"), F.lit("PARAM_OF").alias("edge_type")),
        p.args.select(F.col("arg").alias("src"), F.col("call").alias("dst"), F.lit("ARG_OF").alias("edge_type")),
        p.returns.join(p.calls, "function").select(F.col("ret").alias("src"), F.col("call").alias("dst"), F.lit("RETURNS_TO").alias("edge_type")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("src is not null and dst is not null").distinct()


def _spread(start: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of everything that roots reach along edges (src, dst), themselves included; each pair is visited once."""
    front = seen = scratch.put(start.select("node", "root").distinct(), name)
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "root").distinct()
        front = scratch.put(step.join(seen, ["node", "root"], "left_anti"), name)
        seen = seen.unionByName(front)
    return seen


def call_components(calls: DataFrame, functions: DataFrame, scratch: Scratch | None = None, by_name: Named | None = None) -> DataFrame:
    """function, component, recursive, level: strongly connected components of the call graph and their place in the condensed graph.

    calls: caller, function; functions: function. A component is named by its largest function; recursive says that its functions can
    call themselves; level is 0 where nothing is called, else one more than the highest level called. Functions on no cycle are trimmed
    off first, from both ends; what is left is coloured by the largest function that reaches it, and each colour's own function searched
    backwards, until no edge is left. With by_name, its far calls count as well: a name is a node that its calls lead to and that leads to its functions,
    whose pairs are never listed. Being a step of no length, it changes neither components nor levels; it sorts below all functions, so it names none.
    """
    scratch = scratch or Scratch(calls.sparkSession, "components")
    every, pairs, is_name = functions.select("function"), calls.select("caller", "function"), F.lit(False)
    if by_name:
        as_function, as_name, is_name = lambda c: F.concat(F.lit("="), c), lambda c: F.concat(F.lit(" "), c), F.col("component").startswith(" ")
        names = by_name.functions.select("called").distinct()
        every = every.select(as_function("function").alias("function")).unionByName(names.select(as_name("called").alias("function")))
        pairs = pairs.select(as_function("caller").alias("caller"), as_function("function").alias("function"))
        pairs = pairs.unionByName(by_name.far.select(as_function("caller").alias("caller"), as_name("called").alias("function"))).unionByName(by_name.functions.select(as_name("called").alias("caller"), as_function("function").alias("function")))
    every = scratch.put(every.where("function is not null").distinct(), "functions")
    known = every.withColumnRenamed("function", "src"), every.withColumnRenamed("function", "dst")
    edges = pairs.toDF("src", "dst").distinct().join(known[0], "src", "left_semi").join(known[1], "dst", "left_semi")
    edges = scratch.put(edges, "edges")
    own = edges.where("src = dst").select(F.col("src").alias("function")).distinct()
    left, size = scratch.put(edges.where("src <> dst"), "left"), -1
    found = every.limit(0).select("function", F.col("function").alias("component"))
    while True:
        while size != (size := left.count()):  # trims the ends of chains
            heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = scratch.put(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi"), "left")
        if not size:
            break
        colour = scratch.put(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        moved = True
        while moved:  # the largest function that reaches each
            offered = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
            new = scratch.put(colour.join(offered, "node", "left").select("node", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") > F.col("colour")).alias("moved")), "colour")
            moved = not new.where("moved").isEmpty()
            colour = new.select("node", "colour")
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("of")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("too"))
        inside = scratch.put(left.join(a, "src").join(b, "dst").where("of = too").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        roots = colour.where("node = colour").select("node", F.col("colour").alias("root"))
        mine = scratch.put(_spread(roots, inside, scratch, "back").select(F.col("node").alias("function"), F.col("root").alias("component")), "mine")
        found = found.unionByName(mine)
        gone = mine.select("function")
        left = scratch.put(left.join(gone.withColumnRenamed("function", "src"), "src", "left_anti").join(gone.withColumnRenamed("function", "dst"), "dst", "left_anti"), "left")
        size = -1
    named = scratch.put(every.join(found, "function", "left").select("function", F.coalesce("component", "function").alias("component")), "named")
    several = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    recursive = named.join(own, "function", "left_semi").select("component").union(several).distinct().withColumn("recursive", F.lit(True))
    to = named.select(F.col("function").alias("src"), F.col("component").alias("up")), named.select(F.col("function").alias("dst"), F.col("component").alias("down"))
    between = scratch.put(edges.join(to[0], "src").join(to[1], "dst").where("up <> down").select("up", "down").distinct(), "between")
    # a level at a time: components all of whose callees have theirs; a name that is in none with a function is open as long as one of its functions
    levels, open_, level = named.limit(0).select("component", F.lit(0).alias("level")), scratch.put(named.select("component").distinct(), "open"), 0

    def waiting(which: DataFrame) -> DataFrame:
        return between.join(which.select(F.col("component").alias("down")), "down", "left_semi").select(F.col("up").alias("component")).distinct()

    while not open_.isEmpty():
        ready = scratch.put(open_.where(~is_name).join(waiting(open_), "component", "left_anti").withColumn("level", F.lit(level)), "ready")
        levels, open_, level = levels.unionByName(ready), scratch.put(open_.join(ready, "component", "left_anti"), "open"), level + 1
        if by_name:
            open_ = scratch.put(open_.where(~is_name).unionByName(open_.where(is_name).join(waiting(open_), "component", "left_semi")), "open")
    out = named.join(levels, "component").join(recursive, "component", "left").select("function", "component", F.coalesce("recursive", F.lit(False)).alias("recursive"), "level")
    plain = lambda c: F.substring(c, F.lit(2), F.length(c)).alias(c)
    return out.where(~F.col("function").startswith(" ")).select(plain("function"), plain("component"), "recursive", "level") if by_name else out


def _call_steps(program: Program, found: DataFrame) -> DataFrame:
    """(src, dst): arguments to the value of their call, where the called function's summary (function, position) says so."""
    return program.args.join(program.calls.select("call", "function"), "call").join(found, ["function", "position"], "left_semi").select(F.col("arg").alias("src"), F.col("call").alias("dst")).distinct()


def summaries(program: Program, scratch: Scratch | None = None) -> DataFrame:
    """function, position: parameters whose value the function can return, through whatever it calls."""
    spark = program.flows.sparkSession
    scratch = scratch or Scratch(spark, "summaries")
    p = program
    functions = p.params.select("function").union(p.returns.select("function")).union(p.calls.select("function")).union(p.calls.select(F.col("caller").alias("function"))).where("function is not null").distinct()
    where = scratch.put(call_components(p.calls, functions, scratch), "components")
    # what a parameter reaches inside its function needs no callee: once for all functions
    roots = p.params.select(F.col("param").alias("node"), F.col("param").alias("root"))
    reach = scratch.put(_spread(roots, p.flows, scratch, "inside"), "reach")
    owner = p.params.select(F.col("param").alias("root"), "function", "position")
    ends = p.returns.select(F.col("ret").alias("node"), "function")

    def returned(pairs: DataFrame) -> DataFrame:
        return pairs.join(owner, "root").join(ends, ["node", "function"], "left_semi").select("function", "position").distinct()

    found = scratch.put(returned(reach), "found")
    depth = where.agg(F.max("level")).first()[0]
    for level in range(-1 if depth is None else depth + 1):
        found, reach = _raise(p, where, level, found, reach, returned, scratch)
    return found


def _raise(p: Program, where: DataFrame, level: int, found: DataFrame, reach: DataFrame, returned, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Summaries of one level's functions, whose callees outside their component are done; rounds go on while a recursive component finds more."""
    here = where.where(F.col("level") == level)
    mine = scratch.put(p.calls.join(here.select(F.col("function").alias("caller")), "caller", "left_semi"), "calls")
    again = not here.where("recursive").isEmpty()
    tried = None
    while True:
        steps = scratch.put(_call_steps(Program(p.flows, p.args, p.params, p.returns, mine), found), "steps")
        new = steps if tried is None else scratch.put(steps.join(tried, ["src", "dst"], "left_anti"), "steps")
        if new.isEmpty():
            return found, reach
        # from what reaches an argument to what its call's value reaches, through this level's calls as far as they are known
        start = reach.join(new, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "root").distinct().join(reach, ["node", "root"], "left_anti")
        more = _spread(start, p.flows.select("src", "dst").unionByName(steps), scratch, "through")
        more = scratch.put(more.join(reach, ["node", "root"], "left_anti"), "more")
        reach, tried = reach.unionByName(more), steps
        fresh = scratch.put(returned(more).join(found, ["function", "position"], "left_anti"), "fresh")
        found = found.unionByName(fresh)
        if not again or fresh.isEmpty():
            return found, reach


def flows_between(program: Program, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """source, sink: pairs of nodes (id) that a value connects on a path whose calls and returns match; a source that is a sink reaches itself.

    sources and sinks hold the column id. Two phases of breadth-first equi joins: out of functions first, then into them; each (source,
    node, phase) is visited once.
    """
    scratch = Scratch(program.flows.sparkSession, "interproc")
    p = Program(**{k: scratch.put(v, k) for k, v in vars(program).items()})
    known = scratch.put(summaries(p, scratch), "summaries")
    level_ = scratch.put(p.flows.select("src", "dst").unionByName(_call_steps(p, known)).distinct(), "level")
    out = p.returns.join(p.calls, "function").select(F.col("ret").alias("src"), F.col("call").alias("dst"))
    into = p.args.join(p.calls, "call").join(p.params, ["function", "position"]).select(F.col("arg").alias("src"), F.col("param").alias("dst"))
    up, down = scratch.put(level_.unionByName(out).distinct(), "up"), scratch.put(level_.unionByName(into).distinct(), "down")
    start = sources.select(F.col("id").alias("node"), F.col("id").alias("root")).where("node is not null")
    reached = scratch.put(_spread(start, up, scratch, "upwards"), "upper")
    every = _spread(reached, down, scratch, "downwards")
    return every.join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(F.col("root").alias("source"), F.col("node").alias("sink")).distinct()
