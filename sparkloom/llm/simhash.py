"""SimHash near-duplicates by pigeonring filtering: chains of consecutive segments whose cumulative differences stay within proportional budgets.

1. One pass over the texts makes 64-bit fingerprints: a bit is set if over half of the shingles' XXH64 values have it.
2. Equal fingerprints are one node with the smallest of its doc_ids, by a partial aggregate: thousands of copies weigh as one row.
3. A fingerprint is a ring of ``SEGMENTS`` = 5 segments. Two that differ in at most 4 bits have a segment from which on every chain of l
   segments differs in at most floor(l * 4 / 5) bits (pigeonring principle): the first not at all, the first two in at most 1, three in
   2, four in 3. So a key of two neighbouring segments finds them, if one side also looks up the keys that differ in one bit of the
   second: 5 rows kept and 70 looked up for each fingerprint. The join's condition checks the longer chains, then all 64 bits.
4. Only the components of links matter, so links inside a component are never listed. Stars come first: in each key's bucket the
   members meet ``HUBS`` of them. Then the exact join looks for links between different components only, from the smaller of the
   two: a fingerprint looks up a key only where a larger component than its own sits. A group of G near copies costs rows in
   proportion to G.

Candidates at scale: with N distinct fingerprints a fingerprint meets about N * 70 / 2**26 others, each checked by a few JVM bit operations inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import textkernel as tk
from ..shipping import ship
from .near_dedup import components
from .scratch import Scratch

SEED, SIZE, MOST = 42, 4, 4
#: (lowest bit, width) of the ring's segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Members of each bucket that its stars surround.
HUBS = 3


def fingerprints(column: pa.Array, size: int = SIZE) -> Iterator[int]:
    """Unsigned fingerprints of texts: lower-cased A-Z, words of anything but ASCII white space, shingles joined by a space, repeats included."""
    data, offsets = tk.text_buffer(column)
    digest = xxhash.xxh64_intdigest
    for i, j in tk.chunks(offsets):
        part, off = tk.TO_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tk.word_spans(part, off)
        lengths = ends - starts
        to = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
        joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = part[~tk.IS_SPACE[part]]
        raw, until = joined.tobytes(), to + lengths
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if a == b:
                yield 0
                continue
            s, e = to[a : max(b - size, a) + 1].tolist(), until[min(a + size, b) - 1 : b].tolist()
            h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(s, e, strict=True)), np.uint64, len(s))
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            yield int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            values = np.fromiter(fingerprints(batch.column(1), size), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return run


def _bits(x: Column | str, k: int) -> Column:
    low, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(x, low).bitwiseAND((1 << width) - 1)


def _key(x: Column | str, k: int, flip: int = 0) -> Column:
    """The chain that starts at segment k, its first two segments; flip changes bits of the second."""
    second = _bits(x, k + 1).bitwiseXOR(flip) if flip else _bits(x, k + 1)
    return F.lit(k << 26).bitwiseOR(F.shiftleft(_bits(x, k), 13)).bitwiseOR(second)


def _kept(nodes: DataFrame) -> DataFrame:
    """Five rows for each fingerprint, one for each chain."""
    return nodes.withColumn("key", F.explode(F.array(*(_key("fp", k) for k in range(len(SEGMENTS))))))


def _looked_up(nodes: DataFrame) -> DataFrame:
    """A row for each chain and each second segment that differs in one bit at most."""
    keys = [_key("fp", k, flip) for k in range(len(SEGMENTS)) for flip in (0, *(1 << b for b in range(SEGMENTS[(k + 1) % len(SEGMENTS)][1])))]
    return nodes.withColumn("key", F.explode(F.array(*keys)))


def _chain_holds(x: str, y: str, key: str, most: int) -> Column:
    """The chains of three and four segments from the key's start keep their budgets, and all bits the limit."""
    differ = F.col(x).bitwiseXOR(F.col(y))
    start = F.shiftright(key, 26)
    out = F.lit(True)
    for chain in (3, 4):
        masks = []
        for k in range(len(SEGMENTS)):
            mask = 0
            for at in range(k, k + chain):
                low, width = SEGMENTS[at % len(SEGMENTS)]
                mask |= ((1 << width) - 1) << low
            masks.append(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        out = out & (F.bit_count(differ.bitwiseAND(F.element_at(F.array(*masks), (start + 1).cast("int")))) <= chain * most // len(SEGMENTS))
    return out & (F.bit_count(differ) <= most)


def links_of(nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the fingerprints (fp, distinct) that have links: 64-bit words linked if they differ in at most ``most`` (4 or fewer) bits."""
    if not 0 <= most <= MOST:
        raise ValueError(f"the ring of {len(SEGMENTS)} segments finds links of at most {MOST} differing bits")
    # Spark takes an exploded table to be about as large as the one before, and would broadcast 5 or 70 times what it may: keys are joined by merging
    kept = _kept(nodes)
    hubs = kept.groupBy("key").agg(*(F.max(F.struct(F.xxhash64(F.col("fp"), F.lit(k)), "fp"))["fp"].alias(f"hub{k}") for k in range(HUBS)), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    near = F.filter(F.array_distinct(F.array(*(f"hub{k}" for k in range(HUBS)))), lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= most))
    found = components(kept.join(hubs.hint("merge"), "key").select(F.col("fp").alias("a"), F.explode(near).alias("b")), scratch)
    # fingerprints with their component, larger components with a larger rank
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    known = found.join(sizes, "component").select(F.col("node").alias("fp"), F.struct("members", "component").alias("rank"))
    alone = F.struct(F.lit(1).cast("long").alias("members"), F.col("fp").alias("component"))
    now = scratch.put(nodes.join(known, "fp", "left").select("fp", F.coalesce("rank", alone).alias("rank")), "ranked")
    kept = _kept(now).select("key", F.col("fp").alias("other"), F.col("rank").alias("other_rank"))
    top = kept.groupBy("key").agg(F.max("other_rank").alias("top"))
    asked = _looked_up(now).join(top.hint("merge"), "key").where(F.col("rank") < F.col("top")).drop("top")
    pairs = asked.join(kept.hint("merge"), "key").where(F.col("rank") < F.col("other_rank")).where(_chain_holds("fp", "other", "key", most))
    # one link from a fingerprint into each component will do
    new = scratch.put(pairs.groupBy("fp", "other_rank").agg(F.min("other").alias("other")).select(F.col("fp").alias("a"), F.col("other").alias("b")), "links")
    if not new.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new), scratch)
    return found


def simhash_duplicates(docs: DataFrame, most: int = MOST, size: int = SIZE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id, kept.

    docs has doc_id and text; other columns, of any name, are ignored. Documents are linked if their fingerprints differ in at most
    ``most`` bits; component_id is the smallest doc_id reachable, kept says that it is the row's own. A text of fewer words than ``size`` has
    one shingle of all its words; a null or blank text has fingerprint zero, and is linked like any other. Rows that repeat a doc_id are
    one node, linked by any of their texts. A null doc_id can't be named: its row has the component of its fingerprint, null if no
    other row names it, and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(ship(docs.sparkSession), "simhash")
    rows = scratch.put(docs.mapInArrow(_fingerprints(size), "doc_id long, fp long"), "fingerprints")
    nodes = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = links_of(nodes.select("fp"), most, scratch)
    # a doc_id of several texts links their fingerprints
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    twins = scratch.put(rows.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct(), "twins")
    if not twins.isEmpty():
        found = scratch.put(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(twins), scratch), "found")
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = scratch.put(named.join(least, "component").select("fp", "component_id"), "components")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = rows.join(final, "fp")
    return out.select("doc_id", text.alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
