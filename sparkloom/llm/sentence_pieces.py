"""SentencePiece encoding and decoding with shared-prefix forward passes over a trie of the distinct marked words.

A text's spaces become U+2581 marks and its words, each with its mark, are collected. The new distinct words of a chunk are sorted, which is
a depth-first walk of their trie: what the forward pass knows about the prefix that a word shares with the one before it
(automaton state, best token and its start at each position) stays on the stack and only the rest of the word is computed. Word
encodings are kept in a bounded dictionary; a text's ids are then gathered with numpy, and decoding is a gather of piece bytes.

The forward recursion follows the model's kind, so that ids equal the SentencePiece library's:

* unigram: Viterbi, score[i] = max over pieces that end at i of score[start] + log-probability; an unknown character scores 10 below the least.
* BPE: score maximisation over ids does not give a BPE model's segmentation: over the public BPE model's scores plain Viterbi gives other ids than
  the library for each of 1,000 texts tried, and 14 % more of them. Here the prefix of length i has exactly one last token:
  the piece that ends at i, starts at j, and would not have merged with the last token of the prefix of length j. That token is found among the
  pieces that end at i, longest first, by undoing the two tokens' merges in rank order. Same trie, same stack, no search.

Pieces that mix marks and letters only ever start with the mark, so words are independent; runs of marks are encoded apart. Characters that no
piece covers become byte pieces, so decoding is exact, but for texts that hold U+2581 themselves (they come back as spaces).
"""

from __future__ import annotations

import pickle
import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from . import textkernel as tk

MARK = "▁"
#: Word encodings and pair decisions that a worker keeps at most, and MB of text that it encodes at once.
WORDS, PAIRS, AT_ONCE = 300_000, 300_000, 1
_ITEM = re.compile(f"{MARK}?[^{MARK}\n]+|\n|{MARK}+(?={MARK}[^{MARK}\n])|{MARK}+")


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: varints, fixed32 floats and byte strings."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            i += n
            yield key >> 3, b[i - n : i]
        else:
            n = 4 if key & 7 == 5 else 8
            i += n
            yield key >> 3, struct.unpack("<f", b[i - 4 : i])[0] if n == 4 else b[i - 8 : i]


class Model:
    """A parsed model file: pieces, scores, kinds, and an automaton whose states list the pieces that end there, longest first."""

    NORMAL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 2, 6, 1, 2

    def __init__(self, data: bytes, kind: int | None = None):
        message = list(_fields(data))
        pieces = [dict(_fields(v)) for f, v in message if f == 1]
        self.text = [p[1].decode() for p in pieces]
        self.score = [float(p.get(2, 0.0)) for p in pieces]
        self.type = [p.get(3, self.NORMAL) for p in pieces]
        trainer, normal = (dict(_fields(next(v for f, v in message if f == k))) for k in (2, 3))
        self.kind = kind or trainer.get(3, self.UNIGRAM)
        if normal.get(2) or normal.get(4, 1) or self.kind not in (self.UNIGRAM, self.BPE):
            raise ValueError("only models with identity normalisation, kept white space and kind unigram or BPE are supported")
        self.prefix = MARK if normal.get(3, 1) else ""
        self.id = {t: k for k, (t, y) in enumerate(zip(self.text, self.type, strict=True)) if y == self.NORMAL}
        if any(MARK in t.lstrip(MARK) or t.startswith(MARK * 2) and t.strip(MARK) for t in self.id):
            raise ValueError("a piece has a mark after a letter")
        self.byte = {int(t[3:5], 16): k for k, (t, y) in enumerate(zip(self.text, self.type, strict=True)) if y == self.BYTE}
        self.unknown = next(k for k, y in enumerate(self.type) if y == self.UNKNOWN)
        self.unknown_score = min((self.score[k] for k in self.id.values()), default=0.0) - 10.0
        order = sorted(self.id.values(), key=lambda k: (-self.score[k], k))
        self.rank = [len(pieces)] * len(pieces)
        for r, k in enumerate(order):
            self.rank[k] = r
        self.run: int | None = None
        self.parts: list[tuple[int, int] | None] = [None] * len(pieces)
        if self.kind == self.BPE:
            for k in self.id.values():
                self.parts[k] = self._last_merge(k)
        self._automaton()

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the neighbours whose joined piece scores best, the leftmost of equals, until none is a piece."""
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                piece = self.id.get(symbols[k] + symbols[k + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def merge_run(self, n: int) -> list[str]:
        """BPE of n marks. The longest run piece L repeats and the rest follows; that this is what merging does is checked once."""
        if self.run is None:
            self.run = longest = max((len(t) for t in self.id if not t.strip(MARK)), default=1)
            for k in range(longest, 4 * longest + 1):
                if self.merge([MARK] * k) != [MARK * longest] * (k // longest) + self.merge([MARK] * (k % longest)):
                    self.run = 0
                    break
        if not self.run:
            return self.merge([MARK] * n)
        return [MARK * self.run] * (n // self.run) + self.merge([MARK] * (n % self.run))

    def _last_merge(self, k: int) -> tuple[int, int] | None:
        symbols = list(self.text[k])
        while len(symbols) > 2:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.id.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return (self.id[symbols[0]], self.id[symbols[1]]) if len(symbols) == 2 and symbols[0] in self.id and symbols[1] in self.id else None

    def _automaton(self) -> None:
        """Aho-Corasick: children by character, failure links, and at each state the (piece, length) that end there."""
        self.next: list[dict[str, int]] = [{}]
        self.fail, own = [0], [None]
        for text, k in self.id.items():
            if len(text) > 1 and self.kind == self.BPE and self.parts[k] is None:
                continue  # no merges lead to it
            at = 0
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    own.append(None)
                at = self.next[at][c]
            own[at] = (k, len(text))
        self.ends: list[tuple] = [()] * len(self.next)
        queue = deque((0, c, s) for c, s in self.next[0].items())
        while queue:
            above, c, s = queue.popleft()
            f = self.fail[above]
            while above and f and c not in self.next[f]:
                f = self.fail[f]
            self.fail[s] = self.next[f].get(c, 0) if above else 0
            self.ends[s] = ((own[s],) if own[s] else ()) + self.ends[self.fail[s]]
            queue.extend((s, d, t) for d, t in self.next[s].items())


class Encoder:
    """Encodes words of a model; keeps pair decisions and at most WORDS word encodings (they start anew when full)."""

    def __init__(self, model: Model):
        self.m = model
        self.pairs: dict[int, bool] = {}
        self.reset()
        pieces = [(t.replace(MARK, " ").encode() if y == model.NORMAL else b"") for t, y in zip(model.text, model.type, strict=True)]
        for b, k in model.byte.items():
            pieces[k] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.codes, self.stops = array("i"), array("q", [0])

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a before token b as they are: no merge across their border comes before a merge that made them."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        m, x, y = self.m, a, b
        limit, answer = len(m.text) * 2 + 2, True
        while True:
            joined = m.id.get(m.text[x] + m.text[y])
            # ranks are doubled: a merge on the right side loses to an equal one on the left
            if joined is not None and 2 * m.rank[joined] < limit:
                answer = False
                break
            rx, ry = (2 * m.rank[t] if m.parts[t] else -1 for t in (x, y))
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, m.parts[x][1]
            else:
                limit, y = ry + 1, m.parts[y][0]
        self.pairs[key] = answer
        return answer

    def _learn(self, words: list[str]) -> None:
        """Depth-first over the trie of sorted words; stacks of state, last piece, its start (and score, for unigram) at each prefix."""
        m, apart = self.m, self.apart
        nexts, fail, ends, bpe = m.next, m.fail, m.ends, m.kind == m.BPE
        state, last, start, score, above = [0], [-1], [0], [0.0], ""
        for word in words:
            n = min(len(word), len(above))
            shared = 0
            while shared < n and word[shared] == above[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :], start[shared + 1 :], score[shared + 1 :]
            s = state[-1]
            for i in range(shared, len(word)):
                c = word[i]
                while s and c not in nexts[s]:
                    s = fail[s]
                s = nexts[s].get(c, 0)
                state.append(s)
                if bpe:
                    for k, length in ends[s]:
                        before = last[i + 1 - length]
                        if before < 0 or apart(before, k):
                            last.append(k)
                            start.append(i + 1 - length)
                            break
                    else:
                        last.append(-1)
                        start.append(i)
                else:
                    best, by, at = score[i] + m.unknown_score, -1, i
                    for k, length in ends[s]:
                        x = score[i + 1 - length] + m.score[k]
                        if x > best or by < 0 and length == 1:
                            best, by, at = x, k, i + 1 - length
                    last.append(by)
                    start.append(at)
                    score.append(best)
            above = word
            out, i = [], len(word)
            while i:
                if last[i] < 0:
                    out.extend(m.byte.get(b, m.unknown) for b in reversed(word[start[i] : i].encode()))
                else:
                    out.append(last[i])
                i = start[i]
            out.reverse()
            self.number[word] = len(self.stops) - 1
            self.codes.extend(out)
            self.stops.append(len(self.codes))

    def _items(self, text: str) -> list[str]:
        items = _ITEM.findall((self.m.prefix + text).replace(" ", MARK)) if text else []
        if MARK * 2 in (self.m.prefix + text[:1]).replace(" ", MARK) or "  " in text or MARK in text:
            # a word whose mark stays alone gives it to the run before it
            out: list[str] = []
            for item in items:
                if out and out[-1].strip(MARK) == "" and out[-1] and item[0] == MARK and len(item) > 1 and (self.m.kind == self.m.UNIGRAM or self._alone(item)):
                    if self.m.kind == self.m.UNIGRAM:
                        out[-1] += item
                    else:
                        out[-1] += MARK
                        out.append(item[1:])
                else:
                    out.append(item)
            return out
        return items

    def _alone(self, word: str) -> bool:
        if word not in self.number:
            self._add([word])
        k = self.number[word]
        return self.m.text[self.codes[self.stops[k]]] == MARK

    def _add(self, words: list[str]) -> None:
        runs = [w for w in words if w.strip(MARK) == ""] if self.m.kind == self.m.BPE else []
        for w in runs:
            codes = [self.m.id[t] for t in self.m.merge_run(len(w))]
            self.number[w] = len(self.stops) - 1
            self.codes.extend(codes)
            self.stops.append(len(self.codes))
        self._learn(sorted(set(words).difference(runs)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets)."""
        if len(self.stops) > WORDS:
            self.reset()
        items = [self._items(t) for t in texts]
        new = set(chain.from_iterable(items)).difference(self.number)
        if new:
            self._add(list(new))
        sizes = [len(row) for row in items]
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(items)), np.int64, sum(sizes))
        stops = np.array(self.stops)
        lengths = (stops[1:] - stops[:-1])[flat]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(stops[flat] - total[:-1], lengths) + np.arange(total[-1])
        ids = np.array(self.codes)[at]
        return ids, total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each row of ids; the space of the prefix mark is dropped."""
        lengths = (self.piece_at[1:] - self.piece_at[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.piece_at[ids] - total[:-1], lengths) + np.arange(total[-1])
        data = self.piece_bytes[at].tobytes()
        cut = total[offsets]
        skip = len(self.m.prefix)
        return [data[a:b][skip:] if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]


def load(path: str | Path, kind: int | None = None) -> Model:
    return Model(Path(path).read_bytes(), kind)


def _encoder(shared) -> Encoder:
    """A task's own encoder of the broadcast, pickled model: nothing of it stays in the worker when the task ends."""
    return Encoder(pickle.loads(shared.value))


def _encode(shared, verify: bool):
    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(1))
            for i, j in tk.chunks(offsets, AT_ONCE * tk.CHUNK):
                raw = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                ids, at = encoder.encode([r.decode("utf-8", "replace") for r in raw])
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                names = ["doc_id", "n_tokens", "ids"]
                if verify:
                    columns.append(pa.array([a == b for a, b in zip(encoder.decode(ids, at), raw, strict=True)], pa.bool_()))
                    names.append("exact")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _share(df: DataFrame, model: Model):
    return ship(df.sparkSession, 2000).sparkContext.broadcast(pickle.dumps(model))


def encode_pieces(docs: DataFrame, model: Model, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and (with verify) exact, whether decoding the ids gives the text back, for each row of docs.

    A null text counts as empty and has no ids. Null doc_ids stay null, repeated rows stay, other columns are ignored, an empty table
    gives an empty result. Texts are encoded whole.
    """
    schema = "doc_id long, n_tokens long, ids array<int>" + ", exact boolean" * verify
    return docs.select(F.col("doc_id").try_cast("long"), F.col("text").cast("string")).mapInArrow(_encode(_share(docs, model), verify), schema)


def _decode(shared):
    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = [np.asarray(x.values if x.values is not None else [], np.int64) for x in batch.column(1).slice(i, 128)]
                at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                texts = [t.decode("utf-8", "replace") for t in encoder.decode(np.concatenate(rows), at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model: Model) -> DataFrame:
    """The inverse of encode_pieces: doc_id and text from doc_id and ids (null ids: an empty text)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_share(encoded, model)), "doc_id long, text string")
