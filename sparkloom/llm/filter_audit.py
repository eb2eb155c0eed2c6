"""Filter interaction audit: what each of five filters removes, in every order, from one SQL CUBE over the failure flags.

1. One pass over the texts gives the flags A to D and a digest of the text; texts meet no shuffle. E (a copy of a smaller doc_id's text)
   joins the digests that occur more than once, one row each.
2. Rows are summed into cells (part, five flags): 32 for each part at most, with a partial aggregate, so a hot part weighs nothing.
3. ``GROUP BY CUBE (part, a, b, c, d, e)`` over the cells: a grouping set's row in which the selected flags are all false counts the
   survivors of that subset of filters, whatever the others say.
4. A step of an order is a pair of subsets, the filters before it and those with it: survivors of both are joined, and their differences
   are what the step removes. The Shapley sum of a filter goes over the pairs that differ by it, weighed by the orders that have them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
_BITS = {f: 1 << k for k, f in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1


def flags(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, a, b, c, d, digest): one row for each row of docs. Words are split at ASCII white space and compared as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    counted = read.select("doc_id", "part", "text", words.alias("w")).select(
        "doc_id", "part", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct"),
        F.char_length("text").cast("long").alias("points"), F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("upper"),
        F.col("text").rlike(SYMBOLS).alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    return scratch.put(counted.select(
        "doc_id", "part", (F.col("n") < MIN_WORDS).alias("a"), (100 * F.col("distinct") < MIN_DISTINCT * F.col("n")).alias("b"), (100 * F.col("upper") > MAX_UPPER * F.col("points")).alias("c"), "d", "digest",
    ), "flags")


def cells(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): how many rows have which failures."""
    flagged = flags(docs, scratch)
    # written first: the join then has a table of its own on this side, so Spark can split a digest that many rows share
    copies = scratch.put(flagged.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least")).where("rows > 1").select("digest", "least"), "copies")
    judged = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").try_cast("int").alias("quality"), F.col("toxic").try_cast("int").alias("toxic"))
    judged = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flagged.join(copies, "digest", "left").withColumn("e", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).join(judged, "doc_id", "left")
    found = rows.groupBy("part", "a", "b", "c", "d", "e").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return scratch.put(found, "cells")


def survivors(counted: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and all 32 subsets of the filters: the rows that fail none of the subset; 0 where there are none."""
    sets = counted.sparkSession.sql(
        "select part, grouping_id() as unselected, a or b or c or d or e as fails, sum(n) as n, sum(good) as good, sum(toxic) as toxic "
        "from {cells} group by cube (part, a, b, c, d, e) having grouping(part) = 0", cells=counted,
    )
    # flags that are not selected are null, so nothing is known to fail where no selected one does; grouping_id has E in its lowest bit, a subset A
    subset = sum((((F.col("unselected").bitwiseAND(1 << (len(FILTERS) - 1 - k))) == 0).cast("int") * (1 << k) for k in range(len(FILTERS))), F.lit(0))
    alive = sets.where("fails is not true").select("part", subset.alias("subset"), "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("subset"))
    zero = F.lit(0).cast("long")
    return grid.join(alive, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, zero).alias(c) for c in ("n", "good", "toxic")))


def _steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filters before, the step's filter) of all orders: 600 rows, whatever the input."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, before, _BITS[f]))
            before |= _BITS[f]
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty string), order of the five filters and step; counts of rows, zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Failures: A under 200 words; B fewer than half of the words distinct; C over 2 % of the code points are A-Z; D holds one of ``#$%&*|``;
    E the text equals that of a smaller doc_id anywhere in the table. A null text is empty; a null doc_id is larger than none, so its row never fails
    E, and no label holds for it. Rows that repeat a doc_id count each, and are no copies of each other. A document is good or toxic
    if any of its labels says so. An empty table gives no rows; other columns of any name are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "audit")
    alive = scratch.put(survivors(cells(docs, labels, scratch)), "survivors")
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, before int, bit int").withColumn("with", F.col("before").bitwiseOR(F.col("bit")))

    def named(tag: str) -> list[Column]:
        return [F.col("part"), F.col("subset").alias(tag), *(F.col(c).alias(f"{tag}_{c}") for c in ("n", "good", "toxic"))]

    before, after = alive.select(*named("before")), alive.select(*named("with"))
    # one row for each part and filter: what it fails alone, what only it fails, its Shapley sum
    pairs = spark.createDataFrame([(s, b) for b in _BITS.values() for s in range(_ALL + 1) if not s & b], "before int, bit int").withColumn("with", F.col("before").bitwiseOR(F.col("bit")))
    gone = pairs.join(before, "before").join(after, ["part", "with"]).withColumn("gone", F.col("before_n") - F.col("with_n"))
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), F.bit_count("before") + 1)
    whole = gone.groupBy("part", "bit").agg(
        F.sum(F.when(F.col("before") == 0, F.col("gone"))).alias("fails"), F.sum(F.when(F.col("with") == _ALL, F.col("gone"))).alias("unique_fails"), F.sum(F.col("gone") * orders).alias("shapley"),
    )
    rows = steps.join(before, "before").join(after, ["part", "with"]).join(whole, ["part", "bit"])
    removed = F.col("before_n") - F.col("with_n")
    return rows.select(
        "part", "filter_order", "step", F.col("with_n").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        (F.col("before_good") - F.col("with_good")).alias("good_lost"), (F.col("before_toxic") - F.col("with_toxic")).alias("toxic_lost"), "shapley",
    )
