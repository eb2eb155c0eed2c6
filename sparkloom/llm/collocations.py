"""Phrase collocations: word-id suffix arrays per shard, n-gram counts from their LCP intervals, merged by phrase, then scored.

1. A worker gathers texts into shards of about ``SHARD`` bytes. A shard's words become ids in byte order (an exact dictionary), and two rounds
   of prefix doubling sort its suffixes by their first four words; pieces and languages end a suffix. Neighbours' common prefixes (LCP)
   cut the array into intervals: each is one phrase of 1 to 4 words with its number of occurrences.
2. Phrases leave the worker in blocks, one for each language and shuffle partition (by the phrase's hash): ended by newlines, which no word
   holds, in the array's order, so that neighbours share their first words, and compressed. Blocks are shuffled once and summed by
   phrase within their group: every key is a whole phrase, which a shard names once, so no key is hot. A worker merges a group, a
   language's share of a partition, at once: spark.sql.shuffle.partitions sizes it, at 10 MB of text each to some 60 MB of phrases.
3. What occurs often enough is a narrow table. Cuts, parts and containing phrases are equi joins and aggregates by (language, phrase).
4. The first phrases of a language are ranked in salted parts first; the last ranking sees ``SALTS`` times as many rows at most.

A worker holds a shard; a text that is longer is cut between pieces, and blocks of ``BLOCK`` words (with three words of what follows) bound
the arrays where a single piece is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from ..shipping import ship
from .scratch import Scratch

LONGEST = 4
SHARD, BLOCK, SALTS = 4 << 20, 1 << 20, 32
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _shards(batches) -> Iterator[tuple[list[np.ndarray], list[str]]]:
    """Lower-cased bytes and languages of texts, about SHARD bytes at a time; longer texts are cut behind a break."""
    texts, langs, held = [], [], 0
    for batch in batches:
        data, offsets = tk.text_buffer(batch.column(0))
        for k, lang in enumerate(batch.column(1).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            while len(text):
                part = text
                if len(text) > SHARD:
                    breaks = np.flatnonzero(_BREAK[text[:SHARD]])
                    cut = int(breaks[-1]) if len(breaks) else SHARD + int(np.argmax(_BREAK[text[SHARD:]])) if _BREAK[text[SHARD:]].any() else len(text) - 1
                    part = text[: cut + 1]
                text = text[len(part) :]
                texts.append(tk.TO_LOWER[part])
                langs.append(lang)
                held += len(part)
                if held >= SHARD:
                    yield texts, langs
                    texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def _words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words with a space behind each, starts, ends, piece of each word). Pieces of two texts differ."""
    data = np.concatenate(texts)
    gap = _GAP[data]
    first = np.cumsum([0, *map(len, texts)])
    # a text's first byte starts a word whatever stands before it
    edge = np.zeros(len(data), bool)
    edge[first[:-1]] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge))
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:] | edge[1:]
    ends = np.flatnonzero(~gap & after) + 1
    pieces = (np.cumsum(_BREAK[data]) + np.cumsum(edge))[starts]
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[~gap]
    return joined, to, to + lengths, pieces


def _take(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the spans one behind the other, offsets)."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(offsets[-1], np.uint8)
    i = 0
    while i < len(starts):  # about 1 MB of bytes at a time, as each needs an index
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + tk.CHUNK, "right")) - 1)
        out[offsets[i] : offsets[j]] = joined[np.arange(offsets[j] - offsets[i]) + np.repeat(starts[i:j] - offsets[i:j] + offsets[i], lengths[i:j])]
        i = j
    return out, offsets


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank from 1 of each key)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return order, out


def _follow(ranks: np.ndarray, pieces: np.ndarray, by: int) -> np.ndarray:
    """The rank of the suffix that starts so many words later in the same piece; 0 where the piece has ended."""
    out = np.zeros(len(ranks), np.int64)
    if len(ranks) > by:
        out[:-by] = np.where(pieces[by:] == pieces[:-by], ranks[by:], 0)
    return out


def interval_counts(ids: np.ndarray, pieces: np.ndarray, begin: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first position, count) of the phrases of n words that start among the first ``begin`` words; n from 1 to LONGEST.

    ids are the words' ids (language and word), from 0. Two rounds of prefix doubling give the suffixes' order by four words.
    """
    _, r1 = _ranks(ids)
    _, r2 = _ranks(r1 * (len(ids) + 1) + _follow(r1, pieces, 1))
    order, _ = _ranks(r2 * (len(ids) + 1) + _follow(r2, pieces, 2))
    order = order[order < begin]
    follow = [r1, *(_follow(r1, pieces, k) for k in range(1, LONGEST))]
    lcp, same = np.zeros(len(order), np.int8), np.ones(max(len(order) - 1, 0), bool)
    left = np.zeros(len(order), np.int8)
    for word in follow:
        here = word[order]
        left += here > 0
        same &= (here[1:] == here[:-1]) & (here[1:] > 0)
        lcp[1:] += same
    for n in range(1, LONGEST + 1):
        heads = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(heads, len(order)))
        whole = left[heads] >= n
        yield n, order[heads[whole]], counts[whole]


def _shard_phrases(texts: list[np.ndarray], langs: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, joined, starts, ends, language number, count, hash) of the phrases of a shard, in byte order within each n."""
    joined, starts, ends, pieces = _words(texts)
    names = sorted(set(langs))
    number = np.array([names.index(x) for x in langs])
    sizes = np.array([int((~_GAP[t] & np.concatenate([[True], _GAP[t[:-1]]])).sum()) for t in texts])
    lang = np.repeat(number, sizes)
    for b in range(0, len(starts), BLOCK):
        block = slice(b, min(b + BLOCK + LONGEST - 1, len(starts)))
        s, e, piece, of = starts[block], ends[block], pieces[block], lang[block]
        data, offsets = _take(joined, s, e)
        words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        sorted_ = pc.array_sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(sorted_), np.int64)
        rank[sorted_] = np.arange(len(sorted_))
        index = words.indices.to_numpy()
        _, at, dictionary = words.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[: len(sorted_) + 1]
        hashes = tk.span_hashes(np.frombuffer(dictionary, np.uint8), at[:-1], at[1:])[index]
        keys = [tk.mix(hashes)]
        for k in range(1, LONGEST):
            key, m = keys[-1].copy(), max(len(hashes) - k, 0)
            key[:m] = tk.mix(keys[-1][:m] * tk.BASE + hashes[k:])
            keys.append(key)
        for n, first, counts in interval_counts(of * len(sorted_) + rank[index], piece, min(BLOCK, len(starts) - b)):
            yield n, joined, s[first], e[first + n - 1], of[first], counts, keys[n - 1][first]


_BLOCKS = "p int, lang string, phrases array<binary>, counts array<binary>"


def _blocks(parts: int):
    """Arrow batches (p, lang, phrases, counts) of the shards' phrases, compressed; the empty phrase counts a language's words."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for texts, langs in _shards(batches):
            names = sorted(set(langs))
            # for each n: phrases as bytes ending in newlines, their offsets, counts and first rows of each (part, language)
            levels, keys, total = [], set(), np.zeros(len(names), np.int64)
            for n, joined, s, e, of, counts, hashes in _shard_phrases(texts, langs):
                if n == 1:
                    total += np.bincount(of, counts, len(names)).astype(np.int64)
                key = ((hashes >> _U(20)) % _U(parts)).astype(np.int64) * len(names) + of
                order = np.argsort(key, kind="stable")
                data, offsets = _take(joined, s[order], e[order] + 1)
                data[offsets[1:] - 1] = 0x0A  # the space behind each phrase
                key = key[order]
                levels.append((key, data.data, offsets, counts[order].astype(np.uint32)))
                keys.update(np.unique(key).tolist())
            p, lang, phrases, numbers = [], [], [], []
            for k in sorted(keys | set(range(len(names)))):  # part 0 has the totals
                raw, counts = {}, {}
                for level, (key, data, offsets, f) in enumerate(levels):
                    i, j = np.searchsorted(key, [k, k + 1])
                    if i < j:
                        raw.setdefault(level % LONGEST, []).append(data[offsets[i] : offsets[j]])
                        counts.setdefault(level % LONGEST, []).append(f[i:j])
                if k < len(names) and total[k]:
                    raw.setdefault(0, []).append(b"\n")
                    counts.setdefault(0, []).append(total[k : k + 1].astype(np.uint32))
                if raw:
                    p.append(k // len(names))
                    lang.append(k % len(names))
                    phrases.append([pack(b"".join(raw.get(n, []))) for n in range(LONGEST)])
                    numbers.append([pack(b"".join(x.tobytes() for x in counts.get(n, []))) for n in range(LONGEST)])
            if phrases:
                kind = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(names, pa.string()).take(pa.array(lang)), pa.array(phrases, kind), pa.array(numbers, kind)], ["p", "lang", "phrases", "counts"])
            pa.default_memory_pool().release_unused()

    return run


def open_blocks(phrases: list[bytes], counts: list[bytes]) -> pa.Table:
    """(phrase, f_sum) of blocks, each phrase once, with the newline behind it."""
    unpack = zstandard.ZstdDecompressor().decompress
    data = np.frombuffer(b"".join(map(unpack, phrases)), np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    f = np.frombuffer(b"".join(map(unpack, counts)), np.uint32).astype(np.int64)
    return pa.table({"phrase": lines, "f": f}).group_by("phrase").aggregate([("f", "sum")])


def _merged(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for n in range(LONGEST):  # a phrase meets phrases of its own length only
            phrases, counts = (pc.list_element(table[c], n).to_pylist() for c in ("phrases", "counts"))
            summed = open_blocks(phrases, counts)
            often = summed.filter(pc.or_(pc.greater_equal(summed["f_sum"], least), pc.equal(summed["phrase"], "\n")))
            phrase = pc.utf8_slice_codeunits(often["phrase"], 0, -1).cast(pa.string())
            out.append(pa.table({"lang": pa.array([key[1].as_py()] * len(phrase), pa.string()), "phrase": phrase, "f": often["f_sum"]}))
            del summed, often
            pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, f) of phrases of 1 to LONGEST words with f >= least, and the empty phrase with each language's number of words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    blocks = named.mapInArrow(_blocks(parts), _BLOCKS)
    return scratch.put(blocks.groupBy("p", "lang").applyInArrow(_merged(least), "lang string, phrase string, f long"), "phrases")


def _joined(words: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, n_words.

    docs has text and lang; other columns, of any name, are ignored. A null text is empty, a null lang is ``und``. Texts are lower-cased
    (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and tabs. A candidate is a phrase of 2 to 4 words
    that occurs ``a >= least`` times in its language. Cut behind k words its parts occur l and r times, which scores floor(2000000 * a / (l + r)); the
    lowest-scoring cut counts, of equal scores the first. A candidate goes if a longer candidate that contains it has 100 * a >= cover *
    its own. Order: score and a falling, then the phrase's bytes. A language without candidates, and an empty table, give no rows.
    Repeated rows count each time.
    """
    scratch = Scratch(ship(docs.sparkSession), "phrases")
    all_ = phrase_counts(docs, least, scratch)
    known, totals = all_.where("phrase <> ''"), all_.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    cand = known.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.size(words).alias("n_words")).where("n_words > 1")
    k = F.col("k")
    cuts = cand.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "n_words", "k", _joined(F.col("w"), 1, k).alias("head"), _joined(F.col("w"), k + 1, F.col("n_words") - k).alias("tail"))
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n_words").alias("n_words"))
    inner = cand.where("n_words > 2").select("lang", "a", "n_words", "w", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("i"))
    covers = inner.groupBy("lang", _joined(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = best.join(covers, ["lang", "phrase"], "left").where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(cover)}"))
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.col("n_words").cast("long").alias("n_words"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_words")
