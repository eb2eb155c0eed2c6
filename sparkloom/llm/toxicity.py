"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - threshold_k): all grades share the weights w, the thresholds are ordered. x holds the distinct hashed
terms of a text, words and their first 4, 5 and 6 bytes (stems), over ``FEATURES`` slots; no text is cut and every term seen in a labelled
row counts, for or against. A term's value is its log-odds between graded and clean rows times their size (terms alike in both
weigh little before the penalty), over the root of the text's number of known terms.

The grades are the labels' own values 0, 1, ...: a table of severities gives as many ordered thresholds; where labels say toxic or not,
there are two grades, one threshold, and the expected severity is the probability. The model is fitted on the driver to at most ``SAMPLE``
labelled rows (least key hash), of which every fourth is held out: the limit from which a text is toxic is where fewest held-out
rows are misjudged. The model is one array of ``FEATURES`` numbers; scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from . import textkernel as tk
from .sampling import labelled_texts

FEATURES, SAMPLE = 1 << 18, 8192
STEMS = (4, 5, 6)
#: Of the likelihood's penalty (per row), and rows added to either side of a term's odds.
PENALTY, SMOOTH = 1e-3, 0.5

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64


def term_slots(column: pa.Array):
    """(first row, row after the last, row index, slot) of the terms of each chunk of texts: lower-cased runs of letters and digits, and their stems."""
    data, offsets = tk.text_buffer(column)
    for i, j in tk.chunks(offsets):
        part, off = tk.TO_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        inside = _INSIDE[part]
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        before[off[1:-1][off[1:-1] < len(part)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        cut = off[1:-1]
        after[cut[cut > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(off, starts, "right") - 1
        rows, slots = [row], [tk.span_hashes(part, starts, ends)]
        for n in STEMS:
            long = ends - starts > n
            rows.append(row[long])
            slots.append(tk.mix(tk.span_hashes(part, starts[long], starts[long] + n) + _U(n)))
        yield i, j, np.concatenate(rows), (np.concatenate(slots) % _U(FEATURES)).astype(np.int64)


def _distinct(rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * FEATURES + slots)
    return both // FEATURES, both % FEATURES


def _terms(batches):
    for batch in batches:
        lists, lengths = [], np.zeros(batch.num_rows, np.int64)
        for i, j, rows, slots in term_slots(batch.column(1)):
            r, s = _distinct(rows, slots)
            lists.append(s)
            lengths[i:j] = np.bincount(r, minlength=j - i)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        values = pa.array((np.concatenate(lists) if lists else np.zeros(0, np.int64)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values), *batch.columns[2:]], ["doc_id", "terms", *batch.schema.names[2:]])


@dataclass
class Ordinal:
    """Values of terms times their weights (0: unknown) and which terms are known, ordered thresholds, and the w . x from which a text is toxic."""

    weights: np.ndarray
    known: np.ndarray
    thresholds: np.ndarray
    limit: float

    def scores(self, n: int, rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of known terms, w . x) of n texts from their distinct terms."""
        hits = np.bincount(rows[self.known[slots]], minlength=n)
        return hits, np.bincount(rows, self.weights[slots], n) / np.sqrt(np.maximum(hits, 1))

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 80, memory: int = 8, least: float = 1e-6) -> np.ndarray:
    """L-BFGS with a halving line search, until a step gains less than so large a share of the value."""
    value, g = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y in reversed(moves):
            back.append((s @ q) / (y @ s))
            q -= back[-1] * y
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / (np.linalg.norm(g) + 1e-12)
        for (s, y), a in zip(moves, reversed(back), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0
        while True:
            new_value, new_g = f(x - step * q)
            if new_value <= value - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        if new_value >= value:
            break
        s, y = -step * q, new_g - g
        if s @ y > 1e-14:
            moves = [*moves, (s, y)][-memory:]
        x, gain, value, g = x + s, value - new_value, new_value, new_g
        if gain < least * abs(value):
            break
    return x


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, n_columns: int, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised mean negative log-likelihood; (rows, columns, values) is the sparse matrix, grades are 0 .. K."""
    n, k = len(grade), int(grade.max())
    at = np.arange(n)

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:n_columns], x[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_columns + 1 :]))])

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = split(x)
        z = np.bincount(rows, w[columns] * values, n)
        low = np.concatenate([[-np.inf], theta])[grade]  # the grade's range of the latent value
        high = np.concatenate([theta, [np.inf]])[grade]
        a, b = 1 / (1 + np.exp(-np.clip(low - z, -60, 60))), 1 / (1 + np.exp(-np.clip(high - z, -60, 60)))
        a[grade == 0], b[grade == k] = 0.0, 1.0
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        dz = (db - da) / n
        d_theta = np.bincount(grade[grade < k], -db[grade < k] / n, k) + np.bincount(grade[grade > 0] - 1, da[grade > 0] / n, k)
        tail = np.cumsum(d_theta[::-1])[::-1]  # a gap moves all thresholds after it
        g = np.concatenate([np.bincount(columns, dz[rows] * values, n_columns) + penalty * w, tail[:1], tail[1:] * np.exp(x[n_columns + 1 :])])
        return float(-np.log(p[at]).mean() + penalty / 2 * (w @ w)), g

    return split(minimise(f, np.concatenate([np.zeros(n_columns), [1.0], np.zeros(k - 1)])))


def best_cut(z: np.ndarray, bad: np.ndarray) -> float:
    """Where fewest rows are misjudged, toxic from there on; of equally good places the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    v, b = z[order], bad[order].astype(np.int64)
    wrong = np.concatenate([[0], np.cumsum(b)]) + np.concatenate([np.cumsum((1 - b)[::-1])[::-1], [0]])
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    gap = np.diff(edges)
    least = wrong[gap > 0].min()  # no cut parts equal scores
    k = int(np.argmax(np.where((wrong == least) & (gap > 0), gap, -1.0)))
    return float((edges[k] + edges[k + 1]) / 2)


def train(indptr: np.ndarray, terms: np.ndarray, grade: np.ndarray, held_out: np.ndarray) -> Ordinal:
    """From rows' distinct slots and grades; rows held out only set the limit."""
    n, rows = len(grade), np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(indptr))
    mine = ~held_out[rows]
    r, s, g = rows[mine], terms[mine], grade[~held_out]
    n_bad, n_clean = int((g > 0).sum()), int((g == 0).sum())
    if not n_bad or not n_clean:
        return Ordinal(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, bool), np.array([50.0]), np.inf)
    all_, bad = np.bincount(s, minlength=FEATURES), np.bincount(s[grade[r] > 0], minlength=FEATURES)
    odds = np.log((bad + SMOOTH) / (n_bad + 2 * SMOOTH)) - np.log((all_ - bad + SMOOTH) / (n_clean + 2 * SMOOTH))
    known, value = all_ > 0, (odds * np.abs(odds)).astype(np.float32)
    number = np.cumsum(known) - 1
    amount = np.bincount(rows[known[terms]], minlength=n)
    scale = (1 / np.sqrt(np.maximum(amount, 1))).astype(np.float32)
    place = (np.cumsum(~held_out) - 1).astype(np.int32)
    w, thresholds = fit_ordinal(place[r], number[s].astype(np.int32), value[s] * scale[r], g, int(known.sum()))
    weights = np.zeros(FEATURES, np.float32)
    weights[known] = w * value[known]
    model = Ordinal(weights, known, thresholds, np.inf)
    judged = held_out if held_out.any() else np.ones(n, bool)
    model.limit = best_cut(model.scores(n, rows, terms)[1][judged], grade[judged] > 0)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Learn from the bounded sample of labelled rows; without toxic or without clean labels the model finds nothing toxic."""
    ship(docs.sparkSession)
    rows = labelled_texts(docs, labels, "toxic", sample).where("toxic >= 0").mapInArrow(_terms, "doc_id long, terms array<int>, toxic int")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    grade = np.asarray(found["toxic"]).astype(np.int64)
    lists = found["terms"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    if not len(grade):
        return train(np.zeros(1, np.int64), np.zeros(0, np.int64), grade, np.zeros(0, bool))
    _, grade = np.unique(grade, return_inverse=True) if grade.min() == 0 else (None, grade)  # grades without rows have no threshold
    return train(np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values), grade, (np.arange(len(grade)) % 4 == 3) & (len(grade) >= 40))


def _severity(model: Ordinal, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of known terms, w . x) of each text."""
    hits, z = np.zeros(len(column), np.int64), np.zeros(len(column))
    for i, j, rows, slots in term_slots(column):
        hits[i:j], z[i:j] = model.scores(j - i, *_distinct(rows, slots))
    return hits, z


def _toxic(model: Ordinal, hits: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (z >= model.limit) & (hits > 0)


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            hits, z = _severity(model, batch.column(1))
            above = model.above(z)
            bounds = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            grade = np.argmax(bounds[:, :-1] - bounds[:, 1:], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hits), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(_toxic(model, hits, z))],
                ["doc_id", "n_terms", "p_toxic", "severity", "grade", "toxic"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_terms, p_toxic, severity (expected grade), grade (likeliest), toxic, for each row of docs.

    labels has doc_id and toxic (0: clean, 1 and more: grades; 0 and 1 alone are two grades). A null or empty text has no terms and is not
    toxic. Null doc_ids stay null, repeated rows are scored alike, other columns are ignored, an empty table gives an empty result;
    without toxic or without clean labels nothing is toxic. Texts are scored whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    schema = "doc_id long, n_terms long, p_toxic double, severity double, grade int, toxic boolean"
    return docs.select(F.col("doc_id").try_cast("long"), F.col("text").cast("string")).mapInArrow(_score(model), schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that toxicity() does not call toxic; no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_toxic(model.value, *_severity(model.value, batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)
