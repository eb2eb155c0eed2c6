"""The input validator: gates over a text column give a sanitized text, ordered warnings and a status."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.text import SPACES_ZS, VALIDATOR_BIDI, VALIDATOR_ZERO_WIDTH, strip_chars
from ..shipping import ship

BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"


@F.pandas_udf(DoubleType())
def common_char_share(texts: pd.Series) -> pd.Series:
    """Share of a text's most frequent character; 0 for an empty text. Counted over an Arrow batch's code points, four bytes a character."""

    def share(t: str | None) -> float:
        if not t:
            return 0.0
        points = np.frombuffer(t.encode(), np.uint8) if t.isascii() else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        # counting needs no sort, but a cell for each code point up to the largest
        counts = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
        return float(counts.max() / len(t))

    return texts.map(share)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC form; no built-in has it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def validate(files: DataFrame, text: str = "text", max_bytes: int = 5 << 20, max_lines: int = 100_000, max_line: int = 4096) -> DataFrame:
    """Adds sanitized, warnings (array in gate order), status PASSED, TRUNCATED or REJECTED.

    Gates: size, malformed bytes, NUL, bidi, zero width, line count, line length, many letters beyond ASCII, compatibility normalisation
    (NFKC), separators and format characters, replacement characters, odd spaces, a dominating character, nested quantifiers, base64
    runs, several shebangs, several encoding lines. A null text counts as empty.
    """
    ship(files.sparkSession)
    t0 = F.coalesce(F.col(text), F.lit(""))
    # most texts are ASCII, and what follows of Unicode gates does not touch them: one test saves their passes
    df = files.withColumn("_t1", F.replace(t0, F.lit("\x00"), F.lit(""))).withColumn("_plain", ~F.col("_t1").rlike(r"[^\x00-\x7F]"))
    t1, plain = F.col("_t1"), F.col("_plain")

    def unless_plain(value: Column, otherwise: Column) -> Column:
        return F.when(plain, otherwise).otherwise(value)

    t2 = unless_plain(strip_chars(t1, VALIDATOR_BIDI), t1)
    t3 = unless_plain(strip_chars(strip_chars(t1, VALIDATOR_BIDI), VALIDATOR_ZERO_WIDTH), t1)
    df = df.withColumn("_t3", t3).withColumn("_rows", F.split("_t3", "\n"))
    t4 = F.array_join(F.transform(F.slice("_rows", 1, max_lines), lambda x: F.left(x, F.lit(max_line))), "\n")
    df = df.withColumns({"_t4": t4, "_lines": F.size("_rows"), "_long": F.exists("_rows", lambda x: F.length(x) > max_line)}).drop("_rows").withColumn("_nfkc", nfkc("_t4"))
    t6 = F.translate(F.regexp_replace("_nfkc", "[\u2028\u2029]", "\n"), SPACES_ZS, " " * len(SPACES_ZS))
    df = df.withColumn("sanitized", unless_plain(F.regexp_replace(t6, r"\p{Cf}", ""), F.col("_nfkc"))).withColumn("_share", common_char_share("sanitized"))
    first = F.slice(F.split("sanitized", "\n", 6), 1, 5)

    def when(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    def several(test) -> Column:
        return F.size(F.filter(first, test)) > 1

    reject, many_lines = F.octet_length(t0) > max_bytes, F.col("_lines") > max_lines
    warnings = F.array_compact(F.array(
        when("too_large", reject),
        when("null_bytes", F.contains(t0, F.lit("\x00"))),
        when("bidi", ~plain & (F.length(t1) > F.length(t2))),
        when("zero_width", ~plain & (F.length(t2) > F.length("_t3"))),
        when("line_count", many_lines),
        when("line_length", F.col("_long")),
        when("confusables", ~plain & (F.regexp_count("_t3", F.lit(r"[\p{L}&&[^\x00-\x7F]]")) > 50)),
        when("nfkc", ~plain & (F.col("_nfkc") != F.col("_t4"))),
        when("separators", ~plain & (F.col("_nfkc").rlike("[\u2028\u2029\\p{Cf}]"))),
        when("malformed", ~plain & (F.col("_nfkc").contains("\ufffd"))),
        when("odd_spaces", ~plain & (F.col("_nfkc").rlike(f"[{SPACES_ZS}]"))),
        when("dominating_char", F.col("_share") > 0.9),
        when("nested_quantifier", F.col("sanitized").rlike(r'"[^"\\]*\([^)"]*[+*][^)"]*\)\s*[+*][^"]*"')),
        when("base64", F.regexp_count("sanitized", F.lit(BASE64)) > 0),
        when("shebangs", several(lambda x: x.startswith("#!"))),
        when("encodings", several(lambda x: x.contains("coding:"))),
    ))
    status = F.when(reject, "REJECTED").when(many_lines | F.col("_long"), "TRUNCATED").otherwise("PASSED")
    return df.withColumns({"warnings": warnings, "status": status}).withColumn("sanitized", F.when(F.col("status") == "REJECTED", "").otherwise(F.col("sanitized"))).drop("_t1", "_plain", "_t3", "_t4", "_nfkc", "_lines", "_long", "_share")


def graph_limits(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int, max_depth: int) -> DataFrame:
    """file, n_nodes, n_edges, depth, tripped: files whose graph is over a limit, by partial aggregates."""
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("depth"))
    e = edges.groupBy("file").agg(F.count(F.lit(1)).alias("n_edges"))
    j = n.join(e, "file", "left").fillna(0, ["n_edges"])
    return j.withColumn("tripped", (F.col("n_nodes") > max_nodes) | (F.col("n_edges") > max_edges) | (F.col("depth") > max_depth))
