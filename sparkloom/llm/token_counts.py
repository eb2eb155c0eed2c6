"""Edit-aware token counts: a segment tree of pre-tokens for each document; an edit re-encodes what it touches and updates subtree sums.

A byte-level BPE tokenizer encodes pre-tokens, matches of its pattern, apart. Pre-tokens are matched from left to right, and a match depends on
nothing before it. So an edit leaves matches alone that end ``CONTEXT`` characters before it (what a match can look ahead, white space runs
aside), and matching is in step again at the first old border, after the edit, that a new match starts at. Only the pre-tokens
between are encoded; the leaves that hold them are replaced and the sums of characters and tokens above them are updated.

The edits counted here are redactions, found by patterns in the whole text: mail addresses, IPv4 addresses, and quoted values of secrets.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship

#: The pattern of the vocabulary files used (GPT-2's); fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: (pattern, replacement) of redactions, by rising priority of place in the text; matches do not overlap.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "<ip>"),
    (r"""(?<=\b(?:token|secret|password|passwd|api_key|apikey|key) ?[=:] ?["'])[^"'\n]{4,}(?=["'])""", "<secret>"),
]
LEAF, CONTEXT, KNOWN = 64, 4, 400_000


class Counter:
    """Token counts of pre-tokens by a tiktoken encoding, with a bounded memory of pre-tokens."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if new:
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(set(pieces))
            encode = self.encoding.encode_ordinary
            for p in new:
                known[p] = len(encode(p))
        return [known[p] for p in pieces]


class TokenTree:
    """A document as a segment tree: leaves of some LEAF pre-tokens, above them sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.encoded = 0
        pieces = counter.pattern.findall(text)
        counts = counter.counts(pieces)
        self.leaves = [(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] or [([], [])]
        self.n_pieces = len(pieces)
        self._build()

    def _build(self) -> None:
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for k, (pieces, counts) in enumerate(self.leaves):
            self.chars[size + k], self.tokens[size + k] = sum(map(len, pieces)), sum(counts)
        for k in range(size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, char: int) -> tuple[int, int]:
        """(leaf that holds the character, its first character); the last leaf for the end of the text."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if char >= before + self.chars[k] and (self.chars[k + 1] or char > before + self.chars[k]):
                before += self.chars[k]
                k += 1
        k -= self.size
        if k >= len(self.leaves):
            k = len(self.leaves) - 1
            before = self.chars[1] - self.chars[self.size + k]
        return k, before

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace characters [start, stop) of the document as it is now."""
        stop = min(stop, self.chars[1])
        start = min(start, stop)
        first, at = self._leaf(max(0, start - CONTEXT))
        pieces, counts = list(self.leaves[first][0]), list(self.leaves[first][1])
        # context: back to a match that ends before it, and over white space runs
        ends = [*accumulate(map(len, pieces), initial=at)]
        k = max(0, min(bisect_right(ends, max(0, start - CONTEXT)) - 1, len(pieces)))
        while True:
            while k > 0 and (pieces[k - 1].isspace() or ends[k] > start - CONTEXT):
                k -= 1
            if k > 0 or first == 0:
                break
            first -= 1
            more, n = self.leaves[first]
            pieces, counts, k = [*more, *pieces], [*n, *counts], len(more)
            at -= sum(map(len, more))
            ends = [*accumulate(map(len, pieces), initial=at)]
        last = self._leaf(stop)[0]
        for leaf in range(self._after(first, pieces, at), last + 1):
            pieces += self.leaves[leaf][0]
            counts += self.leaves[leaf][1]
        last = max(last, self._after(first, pieces, at) - 1)
        delta = len(replacement) - (stop - start)
        while True:
            ends = [*accumulate(map(len, pieces), initial=at)]
            text = "".join(pieces)
            text = text[: start - at] + replacement + text[stop - at :]
            edge = last + 1 >= len(self.leaves)
            found, old, position = [], set(e for e in ends if e >= stop), ends[k]
            resumed = None
            for m in self.counter.pattern.finditer(text, ends[k] - at):
                old_place = m.start() + at - delta
                if old_place >= stop and m.start() + at >= start + len(replacement) and old_place in old and found:
                    resumed = old_place
                    break
                found.append(m.group())
            if resumed is not None and resumed < ends[-1] or edge:
                break
            last += 1
            pieces += self.leaves[last][0]
            counts += self.leaves[last][1]
        tail = ends.index(resumed) if resumed is not None else len(pieces)
        self.encoded += len(found)
        new = pieces[:k] + found + pieces[tail:]
        new_counts = counts[:k] + self.counter.counts(found) + counts[tail:]
        self.n_pieces += len(new) - len(pieces)
        self._replace(first, last, new, new_counts)

    def _after(self, first: int, pieces: list[str], at: int) -> int:
        """The leaf after those whose pieces are gathered, from leaf ``first`` on."""
        n, leaf = len(pieces), first
        while n > 0 and leaf < len(self.leaves):
            n -= len(self.leaves[leaf][0])
            leaf += 1
        return leaf

    def _replace(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        width = last - first + 1
        step = -(-len(pieces) // width) if pieces else 0
        if step > 4 * LEAF:  # a long insertion: new leaves and sums
            self.leaves[first : last + 1] = [(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)]
            self._build()
            return
        for j in range(width):
            part = slice(j * step, (j + 1) * step)
            self.leaves[first + j] = (pieces[part], counts[part])
            k = self.size + first + j
            self.chars[k], self.tokens[k] = sum(map(len, pieces[part])), sum(counts[part])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for k in range(low, high + 1):
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            low, high = low // 2, high // 2

    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)


def redactions(text: str, rules) -> list[tuple[int, int, str]]:
    """Edits (start, stop, replacement) in the text's characters, by place; of overlapping ones the first, then the longest."""
    found = sorted(((m.start(), -m.end(), r) for p, r in rules for m in p.finditer(text)))
    out, end = [], 0
    for a, b, r in found:
        if a >= end:
            out.append((a, -b, r))
            end = -b
    return out


#: A worker's counters by the digest of their vocabulary file.
_counters: dict[bytes, Counter] = {}


def _count(shared, rules):
    def run(batches):
        key = hashlib.blake2b(shared.value).digest()
        if key not in _counters:
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        compiled = [(regex.compile(p), r) for p, r in rules]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for text in part.column(1).to_pylist():
                    tree = TokenTree(text or "", counter)
                    before, pieces, moved = tree.total, tree.n_pieces, 0
                    edits = redactions(text, compiled) if text else []
                    for a, b, r in edits:
                        tree.edit(a + moved, b + moved, r)
                        moved += len(r) - (b - a)
                    rows.append((before, pieces, len(edits), tree.encoded, tree.total))
                columns = [pa.array(np.array([r[k] for r in rows], np.int64)) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_edited"])

    return run


def token_counts(docs: DataFrame, ranks_path: str | Path, rules=None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_reencoded (pre-tokens), n_tokens_edited for each row of docs.

    n_tokens counts the text as it is, n_tokens_edited after the redactions, which are applied to the tree one by one. ranks_path is a
    vocabulary file (base64 token and rank on each line), read on the driver and broadcast (about 1 MB). A null text counts as empty.
    Null doc_ids stay null, repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(Path(ranks_path).read_bytes())
    schema = "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_reencoded long, n_tokens_edited long"
    return docs.select(F.col("doc_id").try_cast("long"), F.col("text").cast("string")).mapInArrow(_count(shared, REDACTIONS if rules is None else rules), schema)
