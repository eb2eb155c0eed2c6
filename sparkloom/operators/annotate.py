"""The annotator: a security label for each named node, from a registry by exact name, by suffix, or by word heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..functions.text import any_of, first_match, name_variants
from ..scratch import Scratch


def annotate(nodes: DataFrame, registry: DataFrame, key: str = "node_id") -> DataFrame:
    """Adds label, confidence, cwe, pass to nodes (key unique, node_type, name, raw_text, language).

    Distinct names are annotated, not nodes, and written out first: the passes join names with the registry (Spark broadcasts it while it is small), and
    the result is joined back. Pass 1: variants of the name by equality, ordered by variant, then kind. Pass 2, for
    names that pass 1 left: all suffixes of the lower-cased name by
    equality with the lower-cased key, which makes the suffix search an equi join; ordered by kind, then place in the registry; 0.75 of the
    confidence unless equal. Pass 3: words. First match wins in each.
    """
    kinds = F.array_position(F.array(*map(F.lit, dims.KINDS)), F.col("kind"))
    from pyspark.sql import Window

    reg = registry.withColumn("kind_ord", kinds).withColumn("_n", F.monotonically_increasing_id())
    reg = reg.withColumn("key_ord", F.row_number().over(Window.partitionBy("language").orderBy("kind_ord", "_n"))).drop("_n").withColumnRenamed("language", "_lang")
    names = nodes.where(F.col("node_type").isin(dims.ANNOTATABLE) & (F.coalesce("name", F.lit("")) != "")).select("language", "name").distinct()
    names = Scratch(nodes.sparkSession, "annotate").put(names, "names")  # read by each pass, found once
    exact = names.select("language", "name", F.posexplode(name_variants(F.col("name"))).alias("v", "key"))
    hit = F.struct("label", "confidence", "cwe")
    one = exact.join(reg, (F.col("language") == F.col("_lang")) & (exact["key"] == reg["key"])).groupBy("language", "name").agg(F.min_by(hit, F.struct("v", "kind_ord", "key_ord")).alias("one"))
    longest = registry.agg(F.coalesce(F.max(F.length("key")), F.lit(1))).first()[0]  # a dimension's maximum: longer suffixes equal no key
    starts = F.sequence(F.greatest(F.lit(1), F.length("low") - longest + 1), F.length("low"))
    left = names.join(one.select("language", "name"), ["language", "name"], "left_anti")
    suffixes = left.select("language", "name", F.lower("name").alias("low")).select("language", "name", "low", F.explode(F.transform(starts, lambda i: F.substr(F.col("low"), i))).alias("s"))
    ends = reg.withColumn("s2", F.lower("key"))
    score = F.when(F.col("s") == F.col("low"), F.col("confidence")).otherwise(F.col("confidence") * 0.75)
    two = suffixes.join(ends, (F.col("language") == F.col("_lang")) & (F.col("s") == F.col("s2"))).groupBy("language", "name").agg(F.min_by(F.struct("label", score.alias("confidence"), "cwe"), F.struct("kind_ord", "key_ord")).alias("two"))
    found = names.join(one, ["language", "name"], "left").join(two, ["language", "name"], "left").withColumnRenamed("language", "_l").withColumnRenamed("name", "_m")
    low, text = F.lower("name"), F.lower(F.coalesce("raw_text", F.lit("")))
    heuristic = first_match(
        (any_of(low, dims.SENSITIVE_WORDS, "in") | any_of(text, dims.SENSITIVE_WORDS, "in"), F.struct(F.lit("SENSITIVE").alias("label"), F.lit(0.55).alias("confidence"), F.lit("CWE-798").alias("cwe"))),
        (any_of(low, dims.SANITIZER_WORDS, "start|end"), F.struct(F.lit("SANITIZER").alias("label"), F.lit(0.45).alias("confidence"), F.lit("").alias("cwe"))),
        (any_of(low, dims.SINK_WORDS, "end"), F.struct(F.lit("SINK").alias("label"), F.lit(0.40).alias("confidence"), F.lit("").alias("cwe"))),
        (any_of(low, dims.SOURCE_WORDS, "start|end"), F.struct(F.lit("SOURCE").alias("label"), F.lit(0.35).alias("confidence"), F.lit("").alias("cwe"))),
    )
    usable = F.col("node_type").isin(dims.ANNOTATABLE) & (F.coalesce("name", F.lit("")) != "")
    none = F.struct(F.lit("NONE").alias("label"), F.lit(0.0).alias("confidence"), F.lit("").alias("cwe"))
    best = F.when(usable, F.coalesce("one", "two", heuristic, none)).otherwise(none)
    step = F.when(~usable, 0).when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(heuristic.isNotNull(), 3).otherwise(0)
    joined = nodes.join(found, (F.col("language") == F.col("_l")) & (F.col("name") == F.col("_m")), "left")
    return joined.withColumns({"_b": best, "pass": step}).withColumns({"label": F.col("_b.label"), "confidence": F.round("_b.confidence", 6), "cwe": F.col("_b.cwe")}).drop("_l", "_m", "one", "two", "_b")
