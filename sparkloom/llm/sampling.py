"""Bounded samples of labelled rows: the same rows at any partitioning, and a bound that holds for what is collected, not for labels only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that pass the hash threshold beyond those wanted, as a share; no task sorts more than these.
MARGIN = 0.2
_RANGE = 1 << 31


def least_hashed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least key hash, of rows that are distinct by key. A hash threshold from their number comes before the sort."""
    h = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    total = rows.count()
    if total > n:
        rows = rows.where(h < int(_RANGE * min(1.0, (n * (1 + MARGIN) + 64) / total)))
    return rows.orderBy(h, key).limit(n)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """doc_id, text, label of at most n labelled documents.

    One row for each doc_id: of repeated labels the greatest, of rows that repeat a doc_id the least text. Null doc_ids and labels are left
    out. The chosen labels (n narrow rows at most) are broadcast, so only their texts are shuffled.
    """
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    chosen = least_hashed(known.groupBy("doc_id").agg(F.max(label).alias(label)), "doc_id", n)
    texts = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)


