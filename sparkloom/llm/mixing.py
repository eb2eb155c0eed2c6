"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates r in [0, cap] whose words meet each source's target, the one of least relative entropy to the corpus (every document once)
is r = min(cap, exp(lambda_source * size / scale_source)): a tilt of the documents by the very thing that the constraint counts. Its
multiplier solves the convex dual of the source; all duals are solved together by Newton steps on distributed sums, guarded by
brackets. As documents of one source and size share a rate, the sums run over the cells (source, size, count), which one aggregation of the
documents makes and which grow with the number of distinct sizes only. Sums are of fixed-point numbers, so reruns agree.

Rounding into copies is per cell, one rule for all sizes: the running number of copies, from the longest documents on, is rounded. What a source
then misses of its target, half its longest document at most as a rule, is made up by the longest documents that fit into it and can
be taken once more or less, until none fits. A cell's copies are dealt evenly to its documents; the odd ones go to those of least id hash,
ranked in ``PARTS`` parts apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

WEIGHTS, CAP = (5, 2, 1), 3
#: Steps of the dual before balancing gives up with an error; the least relative error that ends them.
STEPS, ENOUGH = 200, 1e-6
#: Parts of a cell that are ranked apart, and the fixed-point unit of sums.
PARTS, UNIT = 64, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size, target from one row for each source: key, source, source_size.

    Weights repeat over the sources in code-point order, null last; places are ranks within ranges of sources plus the ranges' offsets,
    so no task ranks all sources. Targets share all words by weight and stop at cap times the source's words; what is over is shared
    again until none is above: each round is one distributed sum, and only sums come to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = scratch.put(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition of the shuffle
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    placed = rows.withColumn("place", place).join(counts.select("range", before.alias("before")), "range").withColumn("place", (F.col("place") + F.col("before")) % len(weights) + 1)
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), F.col("place").cast("int"))
    rows = scratch.put(placed.select("key", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("full")), "weights")
    total, shares = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(1))).first()
    level, stopped = total / shares, 0
    while True:
        over = F.col("full") < F.col("w") * F.lit(float(level))
        n, words, rest = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("full"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if n == stopped or not rest:
            break
        level, stopped = (total - words) / rest, n
    return rows.select("key", "source_size", F.least(F.col("w") * F.lit(float(level)), F.col("full").cast("double")).alias("target"))


def _fixed(x: Column) -> Column:
    return F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT


def _rate(cap: int) -> Column:
    """exp(lambda * size / scale), cap at most; a target of cap times all words takes every document cap times."""
    return F.when(F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(cap)))))


def balance(cells: DataFrame, targets: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """key, source_size, target, scale, lam: the multipliers that meet the targets, from cells (key, size, n)."""
    scale = cells.groupBy("key").agg((F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).cast("double").alias("scale"))
    start = targets.join(scale, "key").select("key", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(False).alias("done"))
    state = scratch.put(start, "state")
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * _rate(cap)
        free = F.when(F.col("lam") * x < math.log(cap), words * x).otherwise(0.0)
        sums = cells.join(state.where("not done").select("key", "source_size", "target", "scale", "lam"), "key").groupBy("key").agg(_fixed(words).alias("f"), _fixed(free).alias("slope"))
        gap = F.col("target") - F.col("f")
        low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") + gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        # a step out of the bracket: halve it, or, before there is one, go on by doubling
        halved = F.when((low > -1e9) & (high < 1e9), (low + high) / 2).when(gap > 0, F.greatest(low * 2, low + 1)).otherwise(F.least(high * 2, high - 1))
        met = F.coalesce(F.abs(gap) <= ENOUGH * F.greatest("target", F.lit(1.0)), F.lit(True)) | (F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))) | (F.col("target") <= 0)
        moved = state.join(sums, "key", "left").select("key", "source_size", "target", "scale", F.when(F.col("done") | met, F.col("lam")).when(inside, step).otherwise(halved).alias("lam"), low.alias("low"), high.alias("high"), (F.col("done") | met).alias("done"))
        state = scratch.put(moved, "state", replace=True)
        if state.where("not done").isEmpty():
            return state
    raise ArithmeticError(f"the dual of {state.where('not done').count()} sources is not solved after {STEPS} steps")


def round_cells(rated: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """key, size, n, copies from key, target, size, n, rate."""
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.sum(F.round(F.col("n") * F.col("rate") * UNIT).cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0)) / UNIT
    so_far = F.floor(F.col("upto") + 0.5)
    copies = F.least(F.greatest(so_far - F.coalesce(F.lag(so_far).over(down), F.lit(0)), F.lit(0)), F.col("n") * cap).cast("long")
    cells = rated.where("size > 0").withColumn("upto", upto).select("key", F.round("target").cast("long").alias("target"), "size", "n", copies.alias("copies"))
    cells = scratch.put(cells, "cells")
    while True:
        missed = cells.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missed")).where("missed <> 0")
        room = F.when(F.col("missed") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fit = cells.join(missed, "key").withColumn("room", room).where((F.col("room") > 0) & (F.col("size") <= F.abs("missed")))
        taken = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = F.least(F.col("room"), F.floor((F.abs("missed") - F.col("taken")) / F.col("size"))).cast("long")
        moves = fit.withColumn("taken", taken).where(F.col("taken") < F.abs("missed")).withColumn("step", step).where("step > 0").select("key", "size", (F.col("step") * F.signum("missed")).cast("long").alias("step"))
        moves = scratch.put(moves, "moves")
        if moves.isEmpty():
            return cells.select("key", "size", "n", "copies")
        cells = scratch.put(cells.join(moves, ["key", "size"], "left").select("key", "target", "size", "n", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies")), "cells", replace=True)


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> DataFrame:
    """mix_sources() with the key of the source and a hash of the text."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), source.alias("source"), source_key(F.col("source")).alias("key"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = scratch.put(rows.withColumn("hash", F.xxhash64("doc_id", "text_hash")).withColumn("part", F.pmod("hash", F.lit(PARTS)).cast("int")), "rows")
    parts = scratch.put(rows.groupBy("key", "source", "size", "part").agg(F.count(F.lit(1)).alias("m")), "parts")
    every = scratch.put(parts.groupBy("key", "source", "size").agg(F.sum("m").alias("n")), "all")
    sizes = every.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = scratch.put(source_targets(sizes, scratch, weights, cap), "targets")
    every = every.select("key", "size", "n")
    state = balance(every.where("size > 0"), targets, scratch, cap)
    rated = every.join(state.select("key", "target", "source_size", "scale", "lam"), "key").withColumn("rate", _rate(cap))
    decided = scratch.put(round_cells(rated.select("key", "target", "size", "n", "rate"), scratch, cap), "decided")
    earlier = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = parts.select("key", "size", "part", earlier.alias("earlier")).join(decided, ["key", "size"], "left").join(targets, "key", "left")
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("hash", "doc_id", "text_hash")) + F.col("earlier") - 1
    n, k = F.coalesce("n", F.lit(1)), F.coalesce("copies", F.lit(0))
    out = rows.join(dealt, ["key", "size", "part"]).withColumn("rank", rank)
    copies = F.floor(k / n) + F.when(F.col("rank") < k % n, 1).otherwise(0)
    return out.select("doc_id", "source", "key", "text_hash", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def document_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target of each row of docs (doc_id, text, source): what ``mix_sources`` aims at, without solving for rates."""
    scratch = Scratch(docs.sparkSession, "targets")
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), source.alias("source"), source_key(F.col("source")).alias("key"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = scratch.put(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = scratch.put(source_targets(sizes, scratch, weights, cap), "targets")
    return rows.join(targets.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source; other columns are ignored).

    size counts the words of the text, null: 0. A null source is a source of its own, the last. taken is size * copies, copies 0 to cap.
    Rows of no words are taken 0 times. Equal rows may get different copies, the same ones at each run. An empty table gives an
    empty result, and targets of a corpus without words are 0. A dual that can't be solved raises ArithmeticError.
    """
    return _mixed(docs, weights, cap, Scratch(docs.sparkSession, "mixing")).drop("key", "text_hash")


#: Copies of a row that one array holds at most.
AT_ONCE = 1 << 16


def take_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix_sources() takes it.

    Rows are known by doc_id, source and text. The number of copies of each is a narrow table of its own; where it is small enough for
    Spark to broadcast, no text is shuffled. Rows that repeat are collapsed first and share their copies: rows equal in all columns are
    alike, of others the least in the order of their columns' hash get the odd copies. Null doc_ids, sources and texts count as values;
    an empty table gives an empty result; columns of any name are kept.
    """
    scratch, prefix = Scratch(docs.sparkSession, "copies"), "_mix"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    on = [f"{prefix}_{c}" for c in ("id", "key", "text")]
    rows, copies, n, before = (f"{prefix}_{c}" for c in ("rows", "copies", "n", "before"))
    mixed = _mixed(docs, weights, cap, scratch).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(on[0]), F.col("key").alias(on[1]), F.col("text_hash").alias(on[2]))
    mixed = scratch.put(mixed.agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(copies)).where(F.col(copies) > 0), "mixed")
    named = docs.withColumns({on[0]: F.coalesce(F.col("doc_id").try_cast("long").cast("string"), F.lit("")), on[1]: source_key(F.col("source")), on[2]: F.xxhash64(F.col("text").cast("string"))})
    once = named.join(mixed.where(F.col(rows) == 1), on).select(*docs.columns, F.col(copies))
    again = mixed.where(F.col(rows) > 1)
    alike = named.join(again.select(*on), on, "left_semi").groupBy(*docs.columns, *on).agg(F.count(F.lit(1)).alias(n)).join(again, on)
    earlier = F.coalesce(F.sum(n).over(Window.partitionBy(*on).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = F.greatest(F.least(F.col(n), F.col(copies) % F.col(rows) - F.col(before)), F.lit(0))
    shared = alike.withColumn(before, earlier).select(*docs.columns, (F.col(n) * F.floor(F.col(copies) / F.col(rows)) + odd).cast("long").alias(copies))
    # arrays of a bounded length: a row that repeats is taken in several
    many = once.unionByName(shared).where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / AT_ONCE))))
    return many.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE), F.col(copies) - F.col(n) * AT_ONCE)))).select(*docs.columns)
