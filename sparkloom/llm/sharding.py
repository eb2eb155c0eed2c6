"""Sharding by jump consistent hashing: a stable key and the number of shards decide; appending a shard moves rows only into it.

The shard needs no ring table and no shuffle. Slots, gapless numbers from 0 inside each shard, are ranks: rows are split into
``BUCKETS`` salted parts of each shard, the parts' counts (shards * BUCKETS rows at most) give offsets, and a window ranks each part.
So no task holds a whole shard, and a key that a third of the rows carry is spread over the parts of its shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..shipping import ship
from .scratch import Scratch

#: Parts of each shard that are ranked apart.
BUCKETS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards of 64-bit keys, after Lamping and Veach; all keys that still jump are advanced together."""
    key, b = keys.astype(np.uint64, copy=True), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    j = np.zeros(len(keys), np.int64)
    while len(going):
        b[going] = j
        k = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        key[going] = k
        j = np.floor((b[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        more = j < shards
        going, j = going[more], j[more]
    return b


def _assign(shards: int):
    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(-1)).astype(np.int64).view(np.uint64)
            both = [pa.array(jump_hash(keys, n), pa.int32()) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, "shard", "grown_shard"])

    return run


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the text's UTF-8 bytes plus 1 and text_crc32 its unsigned CRC-32; a null text counts as empty. Equal keys share a shard;
    a null key counts as the 64-bit key -1. Repeated rows get slots of their own. Other columns are ignored; an empty table gives an
    empty result. Within a shard the slots follow no order of the data.
    """
    scratch = Scratch(ship(docs.sparkSession), "shards")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(key).try_cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int"
    placed = narrow.mapInArrow(_assign(shards), schema).withColumn("row", F.monotonically_increasing_id())
    placed = scratch.put(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)).cast("int")), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    ranked = placed.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "part"])  # offsets: shards * BUCKETS rows at most
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard")


def write_shards(rows: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write rows of any columns into one folder for each shard, ``shard=N``; each task adds its own file to a shard, so none gathers one."""
    ship(rows.sparkSession)
    name = "shard" if "shard" not in rows.columns else "shard_"

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).fill_null(-1)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump_hash(keys, shards), pa.int32())], [*batch.schema.names, name])

    from pyspark.sql.types import IntegerType, StructField, StructType

    rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, IntegerType())])).write.partitionBy(name).parquet(path)
