"""Registered queries of the operators across functions: calls, components, reserved edges and flows whose calls and returns match."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import graph as gr, interproc as ip
from ..scratch import Scratch
from .queries import DEFS, N, register, sequence

CALLS = f"""{N}, fn as (select b.file, b.id, arg_min(a.id, (a.end_line - a.line) * 1000000000 + a.ord) as parent_function from n a join n b
 on a.file = b.file and a.t = 'FUNCTION' and b.line >= a.line and greatest(b.line, b.end_line) <= a.end_line and a.id <> b.id group by all),
 c as (select n.file, n.id as call, parent_function as caller, name from n left join fn on fn.file = n.file and fn.id = n.id where t = 'CALL'),
 g as (select call, caller, id as function from (select *, max(near) over (partition by call) as any_near from (select c.call, c.caller, f.id, c.file = f.file as near from c join n f on f.t = 'FUNCTION' and f.name = c.name)) where near or not any_near)"""


def functions_and_calls(s, d):
    """The nodes that are functions and calls, with what they are in."""
    n = sequence(s, d).where("t in ('FUNCTION', 'CALL')")
    # of equal spans the earlier node counts; ids compare as text, so they are padded for it
    padded = n.withColumn("id", F.concat(F.lit("e"), F.lpad(F.col("ord").cast("string"), 12, "0")))
    return gr.enclosing(padded).select("file", "t", "name", F.expr("concat('e', cast(substring(id, 2) as bigint))").alias("id"), F.expr("concat('e', cast(substring(parent_function, 2) as bigint))").alias("parent_function"))


@register("call_links", f"with {CALLS} select call, caller, function from g")
def call_links(s, d):
    return ip.link_calls(functions_and_calls(s, d))


@register("call_components", f"""with recursive {CALLS}, e as (select distinct caller as src, function as dst from g where caller is not null), v as (select id from n where t = 'FUNCTION'),
 r(src, dst) as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst),
 comp as (select v.id, greatest(v.id, coalesce(max(a.dst) filter (where b.src is not null), v.id)) as component, coalesce(bool_or(a.dst = v.id), false) or coalesce(max(a.dst) filter (where b.src is not null), v.id) is distinct from v.id as recursive
  from v left join r a on a.src = v.id left join r b on b.src = a.dst and b.dst = v.id group by v.id),
 ce as (select distinct x.component as up, y.component as down from e join comp x on x.id = e.src join comp y on y.id = e.dst where x.component <> y.component),
 l(component, level) as (select component, 0 from comp union select ce.up, l.level + 1 from l join ce on ce.down = l.component)
 select comp.id as function, comp.component, recursive, level from comp join (select component, max(level) as level from l group by 1) using (component)""")
def call_components(s, d):
    scratch = Scratch(s, "components")
    held = scratch.put(functions_and_calls(s, d), "held")
    named = ip.calls_by_name(held, scratch)
    return ip.call_components(named.near, held.where("t = 'FUNCTION'").select(F.col("id").alias("function")), scratch, named)


#: A user's events are a function here, named by the user; its calls go to the users 2u + 1 and 2u + 2, and a call's value to the assignment or return behind it.
VALUES = ("CALL", "IDENTIFIER", "MEMBER_ACCESS", "LITERAL")
ARGS = ("IDENTIFIER", "LITERAL", "MEMBER_ACCESS")
PROGRAM = f"""{N}, w as (select *, lead(id) over o as id1, lead(t) over o as t1, lead(id, 2) over o as id2, lead(t, 2) over o as t2, lag(id) over o as id0, lag(t) over o as t0 from n window o as (partition by file order by line, col, ord)),
 flow as (select df as src, id as dst from (select *, last_value(case when {DEFS} then id end ignore nulls) over (partition by file, name order by pos rows between unbounded preceding and 1 preceding) as df from p) where df is not null and t in ('IDENTIFIER','MEMBER_ACCESS') and length(name) > 1
  union select id0, id from w where t in ('ASSIGN', 'RETURN') and t0 in {VALUES}),
 param as (select file as function, cast(row_number() over (partition by file order by line, col, ord) as int) as position, id as param from n where t = 'PARAM'),
 ret as (select file as function, id as ret from n where t = 'RETURN'),
 arg as (select id as call, 1 as position, id1 as arg from w where t = 'CALL' and t1 in {ARGS} union all select id, 2, id2 from w where t = 'CALL' and t1 in {ARGS} and t2 in {ARGS}),
 users as (select distinct file from n), g as (select c.id as call, c.file as caller, u.file as function from n c join users u on u.file = cast(2 * cast(c.file as bigint) + 1 + c.ord % 2 as varchar) where c.t = 'CALL')"""


def program(s, d) -> tuple:
    n = sequence(s, d).drop("parent_id")
    o = Window.partitionBy("file").orderBy("line", "col", "ord")
    w = n.withColumns({"id1": F.lead("id").over(o), "t1": F.lead("t").over(o), "id2": F.lead("id", 2).over(o), "t2": F.lead("t", 2).over(o), "id0": F.lag("id").over(o), "t0": F.lag("t").over(o)})
    taken = w.where(F.col("t").isin("ASSIGN", "RETURN") & F.col("t0").isin(*VALUES)).select(F.col("id0").alias("src"), F.col("id").alias("dst"))
    one = w.where((F.col("t") == "CALL") & F.col("t1").isin(*ARGS))
    args = one.select(F.col("id").alias("call"), F.lit(1).alias("position"), F.col("id1").alias("arg")).unionByName(one.where(F.col("t2").isin(*ARGS)).select(F.col("id").alias("call"), F.lit(2).alias("position"), F.col("id2").alias("arg")))
    users = n.select(F.col("file").alias("function")).distinct()
    calls = n.where("t = 'CALL'").select(F.col("id").alias("call"), F.col("file").alias("caller"), F.expr("cast(2 * cast(file as bigint) + 1 + ord % 2 as string)").alias("function")).join(users, "function", "left_semi")
    params = n.where("t = 'PARAM'").select(F.col("file").alias("function"), F.row_number().over(o).alias("position"), F.col("id").alias("param"))
    returns = n.where("t = 'RETURN'").select(F.col("file").alias("function"), F.col("id").alias("ret"))
    return n, ip.Program(gr.dfg_flows(n).select("src", "dst").unionByName(taken).distinct(), args, params, returns, calls)


@register("reserved_edges", f"""with {PROGRAM} select param as src, function as dst, 'PARAM_OF' as edge_type from param union all select arg, call, 'ARG_OF' from arg union all select distinct ret, call, 'RETURNS_TO' from ret join g using (function)""")
def reserved_edges(s, d):
    return ip.reserved_edges(program(s, d)[1])


#: Walks with the stack of calls that they are in: a return goes to the call on top, or to any call where the walk was not called.
WALKS = """step as (select src, dst, '' as call, '' as back, '' as function from flow union all select a.arg, p.param, a.call, '', '' from arg a join g using (call) join param p on p.function = g.function and p.position = a.position
  union all select ret, call, '', call, function from ret join g using (function))"""


@register("function_summaries", f"""with recursive {PROGRAM}, {WALKS}, walk(root, node, stack) as (select param, param, []::varchar[] from param
 union select walk.root, s.dst, case when s.call <> '' then list_append(stack, s.call) when s.back <> '' then stack[:-2] else stack end from walk join step s on s.src = walk.node where s.back = '' or stack[-1] = s.back)
 select distinct p.function, p.position from walk join param p on p.param = walk.root join ret r on r.ret = walk.node and r.function = p.function where len(stack) = 0""")
def function_summaries(s, d):
    return ip.summaries(program(s, d)[1])


@register("interprocedural_flows", f"""with recursive {PROGRAM}, {WALKS}, walk(root, node, stack) as (select id, id, []::varchar[] from n where t = 'LITERAL'
 union select walk.root, s.dst, case when s.call <> '' then list_append(stack, s.call) when s.back <> '' then stack[:-2] else stack end from walk join step s on s.src = walk.node where s.back = '' or len(stack) = 0 or stack[-1] = s.back)
 select distinct root as source, node as sink from walk join n on n.id = walk.node where n.t = 'MEMBER_ACCESS'""")
def interprocedural_flows(s, d):
    n, p = program(s, d)
    return ip.flows_between(p, n.where("t = 'LITERAL'").select("id"), n.where("t = 'MEMBER_ACCESS'").select("id"))
