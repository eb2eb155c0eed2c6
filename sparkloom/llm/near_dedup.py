"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges, exact confirmation.

1. One pass over the texts hashes the distinct word shingles of each document (``shingle_sets``). The sorted 64-bit hashes are cut into
   ``ROWS * BANDS`` bins by their high bits: the least hash of each bin is the one-permutation MinHash. Empty bins borrow from the
   bin that a fixed probe sequence reaches first (optimal densification), and ``ROWS`` bins make a band key.
2. Documents with equal sets are one class, found by a 128-bit digest of the set with a partial aggregate; only the smallest doc_id of a
   class goes on, so thousands of copies weigh as one row.
3. A bucket (band key) with n members gives n - 1 candidate edges to one member, the one that sits in the fullest buckets: a star around
   the likeliest hub, never all pairs.
4. Candidates are confirmed on full sets, shipped only for the documents that a bitmap of the candidates lets through.
5. Confirmed links give components by large-star/small-star rounds. A bucket that still spans several components gets a new star around
   another member; members of buckets that then still are split are joined exactly, across components only, on the rarest shingles of
   their sets (prefix filtering). So no link between different texts is lost for the star's sake.

A pair at exactly the least similarity shares no band with a probability of (1 - 0.85**5)**28 = 7e-8; at 0.80 it is 1.5e-5.

Skew: joins on bucket or class keys have one narrow side and are left to skew-join splitting; no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from ..shipping import ship
from .scratch import Scratch

ROWS, BANDS = 5, 28
BINS = ROWS * BANDS
#: Bits of the bitmap that says which documents' sets a confirmation needs: 16 for each candidate, from 128 kB to 32 MB. It only saves work: a
#: document that it lets through in vain meets no pair.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_U = np.uint64
_EDGES = np.array([-(-(b << 64) // BINS) for b in range(BINS)], dtype=object).astype(np.uint64)
_PROBES = 4096


def _probe_table() -> np.ndarray:
    j, b = np.meshgrid(np.arange(_PROBES, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (tk.mix(tk.mix(b + _U(1)) + j * tk.BASE) % _U(BINS)).astype(np.int16)


_PROBE = _probe_table()


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: lower-cased A-Z, words of anything but ASCII white space; fewer words make one shingle."""
    data, offsets = tk.text_buffer(column)
    for i, j in tk.chunks(offsets):
        part, off = tk.TO_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tk.word_spans(part, off)
        words = tk.span_hashes(part, starts, ends)
        shingles, before = tk.windows(words, first, size)
        for k in range(j - i):
            n = first[k + 1] - first[k]
            if n >= size:
                s = np.sort(shingles[before[k] : before[k + 1]])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif n:
                h = np.array([n], np.uint64)
                for w in words[first[k] : first[k + 1]]:
                    h = tk.mix(h ^ w) * tk.BASE
                yield tk.mix(h)
            else:
                yield np.zeros(0, np.uint64)


def one_permutation(s: np.ndarray) -> np.ndarray:
    """BINS MinHash values of a sorted set: the least hash of each bin, empty bins filled by optimal densification."""
    at = np.searchsorted(s, _EDGES)
    full = np.diff(np.append(at, len(s))) > 0
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for probe in _PROBE:
        if not len(empty):
            break
        to = probe[empty]
        hit = full[to]
        source[empty[hit]] = to[hit]
        empty = empty[~hit]
    if len(empty):
        source[empty] = np.flatnonzero(full)[0]
    return s[at[source]]


def band_keys(s: np.ndarray) -> np.ndarray:
    values = one_permutation(s).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * tk.BASE
    for k in range(ROWS):
        h = tk.mix(h ^ values[:, k]) * tk.BASE
    return tk.mix(h).view(np.int64)


def _digest(s: bytes) -> bytes:
    """The name of a class: of a set's sorted hashes."""
    return hashlib.blake2b(s, digest_size=16).digest()


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            n, digest, keys, lengths = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                digest.append(_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    keys.append(band_keys(s))
                lengths.append(BANDS if len(s) else 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands], ["doc_id", "n_shingles", "digest", "bands"])

    return run


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    return (tk.mix(np.asarray(ids).astype(np.int64).view(np.uint64)) % _U(bits)).astype(np.int64)


def _needed_sets(size: int, bitmap, digests: bool = False):
    def run(batches):
        need = np.frombuffer(bitmap.value, np.uint8)
        bits = len(need) * 8
        for batch in batches:
            ids = batch.column(0)
            at = _places(ids.fill_null(0), bits)
            keep = ((need[at >> 3] >> (at & 7)) & 1).astype(bool) & np.asarray(ids.is_valid())
            if keep.any():
                part = batch.filter(pa.array(keep))
                sets = [s.tobytes() for s in shingle_sets(part.column(1), size)]
                columns = [part.column(0), pa.array(sets, pa.binary())]
                if digests:
                    columns.append(pa.array([_digest(s) for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "s", "digest"][: len(columns)])

    return run


def _marks(bits: int):
    def run(batches):
        for batch in batches:
            at = _places(batch.column(0), bits)
            word, bit = at >> 5, np.left_shift(1, at & 31)
            names, inverse = np.unique(word, return_inverse=True)
            set_ = np.zeros(len(names), np.int64)
            np.bitwise_or.at(set_, inverse, bit)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(set_)], ["word", "bits"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int(np.count_nonzero(y[at] == x))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return run


def _bitmap(ids: DataFrame, most: int):
    """A broadcast bitmap that holds the hashes of the ids, ``most`` at most; a row for each 32 of its bits at most comes to the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * most).bit_length()))
    bits = np.zeros(size // 32, np.uint32)
    for row in ids.mapInArrow(_marks(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bits[row["word"]] = row["bits"]
    return ids.sparkSession.sparkContext.broadcast(bits.tobytes())


def _as_tokens(batches):
    for batch in batches:
        values = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *values])))], ["digest", "tokens"])


def _prefix_candidates(docs: DataFrame, members: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of doc_ids of members (digest, rep, n, component), classes of different components that can be linked, without a loss: prefix filtering.

    With each set's shingles in order of rising frequency among the members, two linked sets share one of their first
    n - ceil(n * percent / 100) + 1. Passages that many share stand last, so what they have in common makes no candidates. A pair is
    given once, for the first shingle that its prefixes share. Sets are known by their class, as a doc_id may have several texts.
    """
    sets = docs.select("doc_id", "text").mapInArrow(_needed_sets(size, _bitmap(members.select("rep"), members.count()), True), "id long, s binary, digest binary")
    mine = sets.join(members.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").select("digest", "s").groupBy("digest").agg(F.first("s").alias("s")).mapInArrow(_as_tokens, "digest binary, tokens array<bigint>")
    tokens = scratch.put(mine.select("digest", F.explode("tokens").alias("t")), "tokens")
    common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("f", "t"))
    ranked = tokens.join(common, "t").withColumn("place", place).join(members, "digest")
    least = F.ceil(F.col("n") * percent / 100)
    named = ["digest", "rep", "n", "component"]
    prefix = ranked.where((F.col("place") <= F.col("n") - least + 1) & (F.col("f") > 1)).groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("f", "t", "place"))).alias("p"))
    prefix = scratch.put(prefix.select(*named, F.explode("p").alias("x"), F.transform("p", lambda x: x["t"]).alias("p")).select(*named, "p", "x.t", "x.place"), "prefixes")
    one, two = prefix, prefix.select(F.col("t"), *(F.col(c).alias(f"{c}2") for c in (*named, "p", "place")))
    first = F.element_at(F.array_intersect("p", "p2"), 1) == F.col("t")
    # no shingle before the first shared one is shared, so this many can be at most; and a link needs that many at least
    most, needed = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")), F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    pairs = one.join(two, "t").where("digest < digest2 and component <> component2").where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).where(most >= needed).where(first)
    return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets reach the similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bitmap = _bitmap(ends, 2 * pairs.count())
    sets = scratch.put(docs.select("doc_id", "text").mapInArrow(_needed_sets(size, bitmap), "id long, s binary"), "sets")
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    links = scratch.put(both.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long"), "links")
    scratch.drop("sets")
    bitmap.unpersist()
    return links.distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each end of the edges (a, b) reaches, by alternating large and small stars."""
    now = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    # done when no center hangs on another: all edges are stars then, around their smallest node
    while not now.select(F.col("v").alias("u")).join(now, "u", "left_semi").isEmpty():
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = scratch.put(small.where("u <> v").distinct(), "stars", replace=True)
    # a node with two centers is one more reason to go on
    if not now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        more = now.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return components(now.toDF("a", "b").union(more), scratch)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns, of any name, are ignored. Texts are linked if 100 * shared >= percent * united distinct
    shingles. A null or blank text has no shingles and is linked with nothing; a text of fewer words than ``size`` has one shingle of all
    its words. Rows that repeat a doc_id are one node: they share its component, and are linked by any of their texts. A null doc_id
    can't be named as a component: such a row has a null component_id and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(ship(docs.sparkSession), "near")
    sig = scratch.put(docs.mapInArrow(_signatures(size), "doc_id long, n_shingles long, digest binary, bands array<bigint>"), "signatures")
    named = sig.where("doc_id is not null and digest is not null")
    classes = scratch.put(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    member = named.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    # a doc_id of several texts links their classes
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    twins = member.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = scratch.put(rows.join(counts, "key"), "shared")
    weight = shared.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = shared.join(weight, "rep")
    # one row for each bucket, written: a join with it is planned by its size, and rows of a bucket are dealt by their key only where it is large
    hubs = scratch.put(weighed.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("c")), "hubs")
    buckets = scratch.put(shared.join(hubs, "key").select("key", "rep", "n", "members", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n")), "buckets")

    def near_in_size(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    pairs = scratch.put(buckets.where(F.col("rep") != F.col("center")).where(near_in_size("n", "center_n")).select(*ordered("rep", "center")).distinct(), "pairs")
    links, checked = confirm(docs, pairs, percent, size, scratch).union(scratch.put(twins, "twins")), pairs
    found = components(links, scratch)
    for stars in (True, False):
        labelled = buckets.where("members > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
        split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep")).alias("c")).where("x <> y")
        split = scratch.put(split.select("key", "c"), "split")
        open_ = labelled.join(split.select("key", "c"), "key")
        if stars:
            more = open_.where("component <> c.component").where(near_in_size("n", "c.n")).select(*ordered("rep", "c.rep")).distinct()
        else:
            left = open_.select("rep", "component").distinct().join(classes.select("digest", "rep", "n"), "rep")
            more = _prefix_candidates(docs, scratch.put(left.select("digest", "rep", "n", "component"), "open"), percent, size, scratch)
        more = scratch.put(more.join(checked, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            new = confirm(docs, more, percent, size, scratch)
            checked = checked.union(more)
            if not new.isEmpty():
                found = components(found.toDF("a", "b").union(new), scratch)
    final = member.groupBy("doc_id").agg(F.min("rep").alias("node")).join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = sig.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; of rows that repeat a kept doc_id one, of the least text, then the least JSON of all columns.

    Texts meet a narrow table only, the doc_ids that go or repeat: where Spark can broadcast it, no text is shuffled. Rows without a doc_id
    stay. An empty table gives an empty result; columns of any name are kept.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    by_id = near_duplicates(docs, percent, size).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    marked = scratch.put(by_id.where("not kept or n > 1"), "marked")
    name = "_near_id"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.col("doc_id").try_cast("long"))
    ids = marked.select(F.col("doc_id").alias(name), "kept")
    single = rows.join(ids.select(name), name, "left_anti").select(*docs.columns)
    repeated = rows.join(ids.where("kept").select(name), name).groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")), F.to_json(F.struct(*docs.columns)))).alias("row"))
    return single.unionByName(repeated.select("row.*"))
