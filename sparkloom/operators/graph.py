"""Edges from ordered nodes: control flow, data flow, containment; imports' merge; reachability step by step.

Nodes: file, ord, id, t, line, col, end_line, fn, name. Order within a file is (line, col, ord). Everything is a window over a file, whose
windows share one sort, or an equi join: ranges of lines meet in bins of about their own length (``containing``), never on the file alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dims
from ..functions.text import edge_id
from ..scratch import Scratch

POSITION = ["line", "col", "ord"]
SILENT = ["RETURN", "BREAK", "CONTINUE", "RAISE"]


def _in_order() -> Window:
    return Window.partitionBy("file").orderBy(*POSITION)


def _latest(condition: Column, value: str = "id") -> Column:
    """The value of the last node before this one, in its file, that meets the condition."""
    return F.last(F.when(condition, F.col(value)), ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))


def _edges(df: DataFrame, src: str, dst: str, edge_type: str) -> DataFrame:
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select("file", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(edge_type).alias("edge_type"))


def cfg_next(nodes: DataFrame) -> DataFrame:
    """CFG_NEXT to the successor, but for nodes that leave."""
    n = nodes.withColumn("next", F.lead("id").over(_in_order())).where(~F.col("t").isin(SILENT))
    return _edges(n, "id", "next", "CFG_NEXT")


def cfg_branches(nodes: DataFrame) -> DataFrame:
    """CFG_TRUE and CFG_FALSE of IF nodes.

    TRUE goes to the first later node on a greater line of the same (file, fn), if it is in the body; FALSE to the first node that isn't an
    IF after the body, else to the successor. Both are as-of lookups by line: nodes are reduced to one row a line, the first is a lead over
    lines, the second takes the last such line seen from below. No node meets all others of its file.
    """
    n = nodes.withColumn("pos", F.row_number().over(_in_order())).withColumn("next", F.lead("id").over(_in_order()))
    ifs = n.where("t = 'IF'").select("file", "fn", "id", "line", "end_line", "next")
    by_line = n.groupBy("file", "fn", "line").agg(F.min_by("id", "pos").alias("first"), F.min_by("id", F.when(F.col("t") != "IF", F.col("pos"))).alias("plain"))
    down = Window.partitionBy("file", "fn").orderBy("line")
    after = by_line.select("file", "fn", "line", F.lead("first").over(down).alias("yes"), F.lead("line").over(down).alias("yes_line"))
    asked = ifs.where("end_line > 0").select("file", "fn", F.greatest("end_line", "line").alias("line"), F.lit(None).cast("string").alias("plain"), "id")
    both = by_line.where("plain is not null").select("file", "fn", "line", "plain", F.lit(None).cast("string").alias("id")).unionByName(asked)
    up = Window.partitionBy("file", "fn").orderBy(F.desc("line"), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    no = both.withColumn("no", F.last("plain", ignorenulls=True).over(up)).where("id is not null").select("file", "id", "no")
    found = ifs.join(after, ["file", "fn", "line"], "left").join(no, ["file", "id"], "left")
    found = found.withColumns({"yes": F.when((F.col("end_line") == 0) | (F.col("yes_line") <= F.col("end_line")), F.col("yes")), "no": F.coalesce("no", "next")})
    return _edges(found, "id", "yes", "CFG_TRUE").unionByName(_edges(found.where("yes is null or no <> yes"), "id", "no", "CFG_FALSE"))


def cfg_conditions(nodes: DataFrame, text: str = "normalized_text") -> DataFrame:
    """file, src, dst, condition: the CFG_TRUE edges with the first 80 characters of their IF's text."""
    texts = nodes.where("t = 'IF'").select("file", F.col("id").alias("src"), F.left(F.col(text), F.lit(80)).alias("condition"))
    return cfg_branches(nodes).where("edge_type = 'CFG_TRUE'").join(texts, ["file", "src"]).select("file", "src", "dst", "condition")


def cfg_loops(nodes: DataFrame) -> DataFrame:
    """LOOP: TRUE and FALSE to the successor; BREAK and CONTINUE: CFG_LOOP to the latest LOOP."""
    n = nodes.withColumn("next", F.lead("id").over(_in_order())).withColumn("loop", _latest(F.col("t") == "LOOP"))
    loops, jumps = n.where("t = 'LOOP'"), n.where("t in ('BREAK', 'CONTINUE')")
    return _edges(loops, "id", "next", "CFG_TRUE").unionByName(_edges(loops, "id", "next", "CFG_FALSE")).unionByName(_edges(jumps, "id", "loop", "CFG_LOOP"))


def cfg_exceptions(nodes: DataFrame) -> DataFrame:
    """CFG_EXCEPTION: latest TRY to CATCH, RAISE to latest TRY; CFG_FINALLY: latest TRY and latest CATCH that had a TRY, to FINALLY."""
    n = nodes.withColumn("try", _latest(F.col("t") == "TRY"))
    n = n.withColumn("catch", F.last(F.when((F.col("t") == "CATCH") & F.col("try").isNotNull(), F.col("id")), ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)))
    out = _edges(n.where("t = 'CATCH'"), "try", "id", "CFG_EXCEPTION").unionByName(_edges(n.where("t = 'RAISE'"), "id", "try", "CFG_EXCEPTION"))
    last = n.where("t = 'FINALLY'")
    return out.unionByName(_edges(last, "try", "id", "CFG_FINALLY")).unionByName(_edges(last, "catch", "id", "CFG_FINALLY"))


def cfg_warnings(nodes: DataFrame) -> DataFrame:
    """file, id, warning for constructs whose flow is only approximated."""
    text = {"YIELD": "generator suspends", "AWAIT": "coroutine suspends", "DEFER": "deferred call runs at return", "GOTO": "jump target not resolved", "WITH": "context exit not modelled"}
    table = F.create_map(*(F.lit(x) for pair in text.items() for x in pair))
    return nodes.where(F.col("t").isin(list(text))).select("file", "id", F.format_string("line %d: %s", F.col("line").cast("int"), F.element_at(table, F.col("t"))).alias("warning"))


# Constructs whose flow the edges only approximate, by language: (languages, node type, flag of the node or None, kind).
APPROXIMATED = [
    (["python"], "WITH", None, "context_exit"),
    (["javascript", "typescript", "tsx"], "AWAIT", None, "event_loop"),
    (["rust"], "TRY", None, "early_return"),
    (["go"], "BLOCK", "is_defer", "deferred"),
    (["go"], "BLOCK", "is_goroutine", "concurrent"),
    (["c", "cpp"], "BREAK", "is_goto", "jump_target"),
]


def language_warnings(nodes: DataFrame) -> DataFrame:
    """file, id, line, kind for nodes (also language and flags, an array of names) that their language's control flow only approximates."""
    def meets(languages: list[str], t: str, flag: str | None) -> Column:
        here = F.lower("language").isin(languages) & (F.col("t") == t)
        return here & F.coalesce(F.array_contains("flags", flag), F.lit(False)) if flag else here

    kinds = F.array_compact(F.array(*(F.when(meets(languages, t, flag), F.lit(kind)) for languages, t, flag, kind in APPROXIMATED)))
    return nodes.select("file", "id", "line", F.explode(kinds).alias("kind"))


def cfg(nodes: DataFrame, with_repeats: bool = False) -> DataFrame:
    """All control-flow edges with edge_id; with_repeats also gives the second CFG_NEXT of TRY, FINALLY and AWAIT."""
    parts = [cfg_next(nodes), cfg_branches(nodes), cfg_loops(nodes), cfg_exceptions(nodes)]
    if with_repeats:
        twice = nodes.withColumn("next", F.lead("id").over(_in_order())).where("t in ('TRY', 'FINALLY', 'AWAIT')")
        parts.append(_edges(twice, "id", "next", "CFG_NEXT"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_id", edge_id(F.col("src"), F.col("dst"), F.col("edge_type")))


DEFINES = ["PARAM", "ASSIGN", "AUGMENTED_ASSIGN"]


def dfg_kills(nodes: DataFrame) -> DataFrame:
    """DFG_KILLS from a name's definition to the next one, if that is an assignment."""
    w = Window.partitionBy("file", "name").orderBy(*POSITION)
    d = nodes.where(F.col("t").isin(DEFINES) & (F.coalesce("name", F.lit("")) != "")).withColumn("before", F.lag("id").over(w)).where("t <> 'PARAM'")
    return _edges(d, "before", "id", "DFG_KILLS")


def dfg_flows(nodes: DataFrame) -> DataFrame:
    """DFG_FLOW from the most recent definition to each use of a name: an as-of join as a window over (file, name)."""
    w = Window.partitionBy("file", "name").orderBy(*POSITION).rowsBetween(Window.unboundedPreceding, -1)
    definition = F.last(F.when(F.col("t").isin(DEFINES), F.col("id")), ignorenulls=True).over(w)
    named = nodes.where(F.col("t").isin([*DEFINES, "IDENTIFIER", "MEMBER_ACCESS"]) & (F.length("name") > 1) & ~F.col("name").isin(dims.BUILTINS))
    return _edges(named.withColumn("def", definition).where("t in ('IDENTIFIER', 'MEMBER_ACCESS')"), "def", "id", "DFG_FLOW")


def dfg_returns(nodes: DataFrame) -> DataFrame:
    """DFG_FLOW from a definition to the RETURN whose line uses the name to its right, by what is defined at the RETURN's place."""
    n = nodes.withColumn("pos", F.row_number().over(_in_order()))
    returns = n.where("t = 'RETURN'").select("file", "line", F.col("id").alias("ret"), F.col("col").alias("rcol"), F.col("pos").alias("rpos"))
    used = n.where("t = 'IDENTIFIER'").select("file", "line", "col", "name")
    uses = returns.join(used, ["file", "line"]).where("col > rcol").select("file", "name", "ret", "rpos").distinct()
    # as-of: definitions and uses of a name in one order, the last definition before each use
    both = n.where(F.col("t").isin(DEFINES)).select("file", "name", "pos", "id", F.lit(None).cast("string").alias("ret"), F.lit(0).alias("use"))
    both = both.unionByName(uses.select("file", "name", F.col("rpos").alias("pos"), F.lit(None).cast("string").alias("id"), "ret", F.lit(1).alias("use")))
    w = Window.partitionBy("file", "name").orderBy("pos", F.desc("use")).rowsBetween(Window.unboundedPreceding, -1)
    return _edges(both.withColumn("def", F.last("id", ignorenulls=True).over(w)).where("use = 1"), "def", "ret", "DFG_FLOW")


ARGUMENTS = ["IDENTIFIER", "LITERAL", "CALL", "MEMBER_ACCESS"]


def dfg_depends(nodes: DataFrame, bin_lines: int = 64) -> DataFrame:
    """DFG_DEPENDS from arguments to their CALL: by parent, else by line range where the parent is not in the file (or is null).

    The range join is made an equi join on (file, line bin): a call goes to each bin that it spans, an argument to its own.
    """
    calls = nodes.where("t = 'CALL'").select("file", F.col("id").alias("call"), F.col("line").alias("first"), F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("line")).alias("last"))
    args = nodes.where(F.col("t").isin(ARGUMENTS)).select("file", "id", "line", "parent_id")
    ids = nodes.select("file", F.col("id").alias("parent_id")).distinct()
    direct = args.join(calls.select("file", F.col("call").alias("parent_id")), ["file", "parent_id"]).where("id <> parent_id").select("file", "id", F.col("parent_id").alias("call"))
    orphans = args.join(ids, ["file", "parent_id"], "left_anti").withColumn("bin", F.floor(F.col("line") / bin_lines))
    spans = calls.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin_lines), F.floor(F.greatest("last", "first") / bin_lines))))
    ranged = orphans.join(spans, ["file", "bin"]).where("line between first and last and id <> call").select("file", "id", "call")
    return _edges(direct.unionByName(ranged).distinct(), "id", "call", "DFG_DEPENDS")


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of outer (file, a, b, ...) and inner (file, line, stop, ...) rows with a <= line and stop <= b, by equi joins.

    A range belongs to the level of bins, of 2**level lines, that is just long enough for it, so it touches two bins at most. A row looks for
    ranges around it in one bin of each level that its file has, from its own length on (some 20 at most). A bin of a level holds ranges
    of at least half its length: as many as are nested there or lie side by side, however long the file.
    """
    level = lambda x, y: F.length(F.bin(F.col(y) - F.col(x)))
    o = outer.withColumn("_level", level("a", "b"))
    levels = o.groupBy("file").agg(F.collect_set("_level").alias("_levels"))
    o = o.withColumn("_bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(a, _level)"), F.expr("shiftright(b, _level)")))))
    i = inner.join(levels, "file").withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= level("line", "stop")))).drop("_levels").withColumn("_bin", F.expr("shiftright(line, _level)"))
    return o.join(i, ["file", "_level", "_bin"]).where("line >= a and stop <= b").drop("_level", "_bin")


def ast_edges(nodes: DataFrame, mode: str = "parent") -> DataFrame:
    """AST_CHILD by line containment. mode parent: each node and its innermost container; child_first: each container and the first node in it.

    A container spans at least one line. Nodes of a file are in the order of falling span, then position; a container comes before what it holds.
    """
    place = F.struct((F.col("line") - F.col("end_line")).alias("less"), *POSITION)
    outer = nodes.where("end_line - line >= 1").select("file", F.col("id").alias("parent"), place.alias("outer"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    inner = nodes.select("file", "id", place.alias("inner"), "line", F.greatest("end_line", "line").alias("stop"))
    j = containing(outer, inner).where("inner > outer and id <> parent")
    if mode == "parent":
        return _edges(j.groupBy("file", "id").agg(F.max_by("parent", "outer").alias("parent")), "parent", "id", "AST_CHILD")
    return _edges(j.groupBy("file", "parent").agg(F.min_by("id", "inner").alias("id")), "parent", "id", "AST_CHILD")


def ast_siblings(nodes: DataFrame) -> DataFrame:
    """AST_NEXT_SIBLING between neighbours of one parent_id."""
    w = Window.partitionBy("file", "parent_id").orderBy(*POSITION)
    return _edges(nodes.where("parent_id is not null").withColumn("next", F.lead("id").over(w)), "id", "next", "AST_NEXT_SIBLING")


def enclosing(nodes: DataFrame, t: str = "FUNCTION") -> DataFrame:
    """Adds parent_<t>: the innermost node of that type which holds this one's lines."""
    outer = nodes.where(F.col("t") == t).select("file", F.col("id").alias("_p"), F.col("line").alias("a"), F.greatest("line", "end_line").alias("b"), F.col("end_line").alias("_end"))
    inner = nodes.select("file", "id", "line", F.greatest("line", "end_line").alias("stop"))
    j = containing(outer, inner).where("stop <= _end and id <> _p").groupBy("file", "id").agg(F.min_by("_p", F.struct(F.col("_end") - F.col("a"), F.col("_p"))).alias(f"parent_{t.lower()}"))
    return nodes.join(j, ["file", "id"], "left")


def keep_known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, each once: two semi joins."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").dropDuplicates(["src", "dst", "edge_type"])


def viewer_cap(nodes: DataFrame, edges: DataFrame, max_nodes: int = 600, max_edges: int = 1200, group: str = "file") -> tuple[DataFrame, DataFrame]:
    """First nodes by position in each group, and first edges among them; caps are the feature (what a viewer draws)."""
    first = nodes.dropDuplicates([group, "id"]).withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*POSITION, "id"))).where(F.col("rn") <= max_nodes)
    seen = first.select(group, "id")
    kept = edges.join(seen.withColumnRenamed("id", "src"), [group, "src"], "left_semi").join(seen.withColumnRenamed("id", "dst"), [group, "dst"], "left_semi").dropDuplicates([group, "src", "dst", "edge_type"])
    kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("src", "dst", "edge_type"))).where(F.col("rn") <= max_edges)
    return first.drop("rn"), kept.drop("rn")


def truncate_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 500_000, max_edges: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The circuit breaker's cut: each file's first nodes by position, and its first edges among those; the limits are the feature."""
    return viewer_cap(nodes, edges, max_nodes, max_edges)


def merge_results(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the primary's."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(secondary.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_p"))).where("_r = 1").drop("_p", "_r")


def _open_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().join(labels.where("label = 'SANITIZER'").select(F.col("id").alias("dst")), "dst", "left_anti")


def taint_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, sink, depth, path: all paths from SOURCE to SINK along edges, no SANITIZER on the way, no node twice.

    Breadth-first by equi joins on the edge's source, until no path goes on; each step is written out, so the plan of a step stays one join.
    Paths can be many where flows branch; ``taint_reach`` gives the pairs alone.
    """
    scratch, labels = Scratch(nodes.sparkSession, "taint"), nodes.select("id", "label")
    open_edges = scratch.put(_open_edges(labels, edges), "edges")
    sinks = labels.where("label = 'SINK'").select(F.col("id").alias("at"))
    front = scratch.put(labels.where("label = 'SOURCE'").select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path")), "front0")
    found: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        step = front.join(open_edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        front = scratch.put(step, f"front{depth}")
        hit = front.join(sinks, "at", "left_semi").select("source", F.col("at").alias("sink"), F.lit(depth).alias("depth"), F.array_join("path", ">").alias("path"))
        found = hit if found is None else found.unionByName(hit)
        if front.isEmpty():
            return found


def taint_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, sink, depth: sinks that a source reaches without a SANITIZER on the way, and the least number of edges. Each (source, node) is visited once."""
    scratch, labels = Scratch(nodes.sparkSession, "reach"), nodes.select("id", "label")
    open_edges = scratch.put(_open_edges(labels, edges), "edges")
    front = scratch.put(labels.where("label = 'SOURCE'").select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("depth")), "seen0")
    seen, depth = front, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(open_edges, F.col("at") == F.col("src")).select("source", F.col("dst").alias("at")).distinct()
        front = scratch.put(step.join(seen, ["source", "at"], "left_anti").withColumn("depth", F.lit(depth)), f"seen{depth}")
        seen = seen.unionByName(front)
    return seen.where("depth > 0").join(labels.where("label = 'SINK'").select(F.col("id").alias("at")), "at", "left_semi").select("source", F.col("at").alias("sink"), "depth")


def ancestors(spark_df: DataFrame, child: str, parent: str, max_depth: int = 99) -> DataFrame:
    """child, ancestor, distance: the closure of a hierarchy, by SQL recursion, whose own limit is 100 levels; a deeper one, or a cycle, is an error there."""
    spark = spark_df.sparkSession
    spark_df.select(F.col(child).alias("c"), F.col(parent).alias("p")).createOrReplaceTempView("_hierarchy")
    return spark.sql(f"""with recursive up(c, a, d) as (
        select c, p, 1 from _hierarchy where p is not null
        union all select up.c, h.p, up.d + 1 from up join _hierarchy h on h.c = up.a where h.p is not null and up.d <= {max_depth})
        select c as {child}, a as ancestor, d as distance from up""")
