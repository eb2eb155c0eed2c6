"""Quality rules: statistics of whole texts, a base rule on them, and an isolation forest whose threshold labelled rows calibrate.

All labelled documents that pass the base rule count, by aggregates over their statistics (one row each): every other good one shapes the
forest, the rest and the bad ones set the threshold.

1. A tree splits a box of rule statistics at random features and values, ``SPLITS`` times from the root to a leaf. Boxes have the extremes that
   ``SUBSAMPLE`` rows have: the training rows are dealt into groups of about that many, and a box is the mean of its groups' extremes.
2. The training rows are counted in all leaves of all trees. A leaf's path length is the mean over all subsamples of ``SUBSAMPLE`` rows, which
   follows from the counts, so none is drawn; the mean path over the trees gives the usual anomaly score.
3. The threshold is the one that rejects most rows labelled bad while it rejects at most ``LEAVE`` of the good rows that the forest has not
   seen. That score is found by counts in ever finer cells.

Only extremes, counts of leaves and counts of cells, bounded by the parameters, come to the driver; the trees (0.5 MB) go to the workers.
Long documents and long words do not count as anomalies by themselves: the forest sees ratios only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from . import textkernel as tk
from .scratch import Scratch

TREES, SUBSAMPLE, SPLITS, SEED = 128, 256, 8, 11
LEAVES = 1 << SPLITS
#: The share of held-out good rows that the threshold may reject.
LEAVE = 0.0005
#: Cells that a range of scores is cut into.
CELLS = 4096
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Good documents that a forest needs.
LEAST_GOOD = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule statistics that the forest splits, in the order of ``ratios``.
RATIOS = ["word_length", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share", "punctuation_per_word", "digits_per_word"]


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def statistics(column: pa.Array) -> np.ndarray:
    """Rows of BASE counts, then lines with a word, upper-case letters A-Z, letters' bytes, digits and other printable ASCII bytes."""
    data, offsets = tk.text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(BASE) + 5), np.int64)
    for i, j in tk.chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        row = out[i:j]
        starts, ends, first = tk.word_spans(part, off)
        row[:, 0] = np.diff(first)
        row[:, 1] = _per_document(tk.code_points(part) & ~tk.IS_SPACE[part], off)
        for k, kind in ((2, _SYMBOL), (6, _UPPER), (7, _LETTER), (8, _DIGIT)):
            row[:, k] = _per_document(kind[part], off)
        row[:, 9] = _per_document((part > 32) & (part < 127) & ~_LETTER[part] & ~_DIGIT[part], off)
        # lines that aren't empty: they start at a document's start or after \n, and end at the next \n or their document's end
        newline = np.flatnonzero(part == 10)
        line_starts, line_ends = np.union1d(off[:-1], newline + 1), np.union1d(newline, off[1:])
        line_starts = line_starts[line_starts < len(part)]
        line_starts = line_starts[part[line_starts] != 10]
        stop = line_ends[np.searchsorted(line_ends, line_starts, "right")]
        owner = np.searchsorted(off, line_starts, "right") - 1
        wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, line_starts)
        line_starts, stop, owner = line_starts[wordy], stop[wordy], owner[wordy]
        row[:, 5] = np.bincount(owner, minlength=j - i)
        h = tk.span_hashes(part, line_starts, stop) if len(line_starts) else np.zeros(0, np.uint64)
        if len(h):
            h = tk.mix(h ^ tk.mix(owner.astype(np.uint64)))
            order = np.argsort(h)
            h = h[order]
            row[:, 3] = np.bincount(owner[order[1:][h[1:] == h[:-1]]], minlength=j - i)
        # words in three-word windows that occur twice or more in their document
        words = tk.span_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        grams, before = tk.windows(words, first, 3)
        if len(grams):
            doc = np.repeat(np.arange(j - i), np.diff(before))
            g = tk.mix(grams ^ tk.mix(doc.astype(np.uint64)))  # alike in one document only
            order = np.argsort(g)
            g = g[order]
            same = g[1:] == g[:-1]
            twice = np.zeros(len(g), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = order[twice]
            at = hit - before[doc[hit]] + first[doc[hit]]
            marked = np.zeros(len(words), bool)
            for k in range(3):
                marked[at + k] = True
            row[:, 4] = _per_document(marked, first)
    return out


def ratios(s: np.ndarray) -> np.ndarray:
    words = np.maximum(s[:, 0], 1).astype(float)
    return np.stack([s[:, 1] / words, s[:, 2] / words, s[:, 3] / np.maximum(s[:, 5], 1), s[:, 4] / words, s[:, 6] / np.maximum(s[:, 7], 1), s[:, 9] / words, s[:, 8] / words], 1)


def _usual_path(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    """Complete random trees as arrays: the children of node k are 2k + 1 and 2k + 2; path lengths of the leaves, once counted."""

    def __init__(self, boxes: np.ndarray, trees: int = TREES, seed: int = SEED):
        """boxes: (box, low or high, feature)."""
        rng = np.random.Generator(np.random.PCG64(seed))
        inner, features = LEAVES - 1, boxes.shape[2]
        self.feature, self.cut = rng.integers(features, size=(trees, inner)), np.zeros((trees, inner))
        for t in range(trees):
            low, high = boxes[t % len(boxes)]
            # random boxes reach beyond the data, so that a split can set apart rows that lie outside what was seen
            span = np.maximum(high - low, 1e-3)
            box = {0: (low - 0.25 * span, high + rng.uniform(0.25, 2.0, features) * span)}
            for k in range(inner):
                (low, high), f = box.pop(k), self.feature[t, k]
                self.cut[t, k] = cut = rng.uniform(low[f], high[f])
                edge = np.arange(features) == f
                box[2 * k + 1], box[2 * k + 2] = (low, np.where(edge, cut, high)), (np.where(edge, cut, low), high)

    def leaves(self, rows: np.ndarray):
        """The leaf of each row, tree by tree."""
        flat, start = np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1]
        for feature, cut in zip(self.feature, self.cut, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(SPLITS):
                at = 2 * at + 1 + (flat[start + feature[at]] >= cut[at])
            yield at - (LEAVES - 1)

    def counted(self, counts: np.ndarray) -> None:
        """counts: training rows in each leaf (tree, leaf). A row's way goes on while its node holds rows of the subsample, as in an isolation tree."""
        total = counts[0].sum()
        self.size = int(min(SUBSAMPLE, total))
        usual = np.array([_usual_path(n) for n in range(self.size + 1)])
        self.path = np.interp(counts * (self.size / total), np.arange(self.size + 1), usual)
        for depth in range(SPLITS):
            share = counts.reshape(len(counts), 1 << depth, -1).sum(2) / total
            self.path += np.repeat(1 - (1 - share) ** self.size, LEAVES >> depth, axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        for path, leaf in zip(self.path, self.leaves(rows), strict=True):
            total += path[leaf]
        return np.exp2(-(total / len(self.path)) / _usual_path(self.size))


_COUNTS = [*BASE, "lines", "upper", "letters", "digits", "punctuation"]


def _count(batches):
    for batch in batches:
        s = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in s.T), *batch.columns[2:]], ["doc_id", *_COUNTS, *batch.schema.names[2:]])


def _ratios(batches):
    for batch in batches:
        x = ratios(np.stack([np.asarray(batch.column(k)) for k in range(2, batch.num_columns)], 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in x.T)], ["doc_id", "role", *RATIOS])


def _leaf_counts(model):
    def run(batches):
        forest = model.value
        counts = np.zeros((TREES, LEAVES), np.int64)
        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns], 1)
            for k, leaf in enumerate(forest.leaves(rows)):
                counts[k] += np.bincount(leaf, minlength=LEAVES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["leaf", "n"])

    return run


def _scores(model):
    def run(batches):
        for batch in batches:
            rows = np.stack([np.asarray(c) for c in batch.columns[1:]], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(rows))], ["role", "score"])

    return run


def _boxes(train: DataFrame, n: int) -> np.ndarray:
    """(box, low or high, ratio): mean extremes of groups of about SUBSAMPLE rows, TREES boxes at most; means in fixed point, so reruns agree."""
    groups = max(1, n // SUBSAMPLE)
    group = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(groups))
    ends = train.groupBy(group.alias("g")).agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in RATIOS))
    names = [c for c in ends.columns if c != "g"]
    fixed = [(F.sum(F.round(F.col(c) * (1 << 20)).cast("decimal(38,0)")).cast("double") / F.count(F.lit(1)) / (1 << 20)).alias(c) for c in names]
    rows = ends.groupBy((F.col("g") % TREES).alias("box")).agg(*fixed).orderBy("box").collect()
    return np.array([[r[c] for c in names] for r in rows]).reshape(len(rows), 2, len(RATIOS))


def kth_largest(scores: DataFrame, k: int) -> float:
    """The score that k others precede in falling order; no sort, CELLS counts a pass at most come to the driver."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        cell = F.least(F.floor((F.col("score") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        cells = scores.where(F.col("score").between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
        for r in sorted(cells, key=lambda r: -r["cell"]):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and the counts of each row's whole text."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
    return scratch.put(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count, schema), "counted")


def fit(counts: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled rows of counts (doc_id, statistics); (None, 1.0) if fewer than LEAST_GOOD of them are good.

    Each doc_id is one row: of repeated labels the greatest, of rows that repeat a doc_id the least statistics. Roles: 0 bad, 1 training, 2 held out.
    """
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    usable = counts.join(known.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality in (0, 1)"), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*_COUNTS)).alias("s")).select("doc_id", "quality", "s.*")
    usable = usable.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEATED_PERCENT * F.col("n_words")))
    role = F.when(F.col("quality") == 0, 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2))).cast("int")
    rows = scratch.put(usable.select("doc_id", role.alias("role"), *_COUNTS).mapInArrow(_ratios, "doc_id long, role int, " + ", ".join(f"{c} double" for c in RATIOS)), "labelled")
    n = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    if n.get(1, 0) < 2 or n[1] + n.get(2, 0) < LEAST_GOOD:
        return None, 1.0
    train, context = rows.where("role = 1"), rows.sparkSession.sparkContext
    forest = Forest(_boxes(train, n[1]))
    leaves = train.select(*RATIOS).mapInArrow(_leaf_counts(context.broadcast(forest)), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    inside = np.zeros(TREES * LEAVES)
    inside[np.asarray(leaves["leaf"])] = np.asarray(leaves["n"])
    forest.counted(inside.reshape(TREES, LEAVES))
    if not n.get(0) or not n.get(2):  # nothing to catch, or nothing to spare: no row is rejected
        return forest, 1.0
    scores = scratch.put(rows.where("role <> 1").select("role", *RATIOS).mapInArrow(_scores(context.broadcast(forest)), "role int, score double"), "scores")
    limit = kth_largest(scores.where("role = 2"), int(LEAVE * n[2]))
    above = scores.where((F.col("role") == 0) & (F.col("score") > limit)).agg(F.min("score")).first()[0]
    # midway to the least anomalous row it catches: unseen good rows get that margin
    return forest, limit if above is None else (limit + above) / 2


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEATED_PERCENT * s[:, 0])


def _judged(forest: Forest | None, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails, and the anomaly where it doesn't, of each row of statistics."""
    failed, score = base_failed(s), np.zeros(len(s))
    if forest is not None and not failed.all():
        score[~failed] = forest.score(ratios(s[~failed]))
    return failed, score


def _judge(model, threshold: float):
    def run(batches):
        for batch in batches:
            failed, score = _judged(model.value, np.stack([np.asarray(c) for c in batch.columns[1:]], 1))
            columns = [*batch.columns[: 1 + len(BASE)], pa.array(failed), pa.array(~failed & (score <= threshold)), pa.array(np.where(failed, None, score), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly for each row of docs.

    labels has doc_id and quality (1 good, 0 bad). A null text has no words and fails the base rule; anomaly, the forest's score, is
    null where it fails. Without enough labels only the base rule decides. Null doc_ids stay null, repeated rows are judged alike,
    other columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(ship(docs.sparkSession), "quality")
    counts = counted(docs, scratch)
    forest, threshold = fit(counts, labels, scratch)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return counts.mapInArrow(_judge(model, threshold), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality_verdicts() keeps; no shuffle of texts."""
    scratch = Scratch(ship(docs.sparkSession), "quality")
    forest, threshold = fit(counted(docs, scratch), labels, scratch)
    model, at = docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            failed, score = _judged(model.value, statistics(batch.column(at)))
            yield batch.filter(pa.array(~failed & (score <= threshold)))

    return docs.mapInArrow(run, docs.schema)
