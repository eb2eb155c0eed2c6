"""URL filters: host rules, and gradient-boosted trees on lexical features for the urls that no rule decides.

Rules are (host, path prefix, verdict); they are tried per host suffix and path, longest first, as column expressions. Labelled urls are a
table of (url, verdict), or else the urls that rules decide. Trees are boosted on the driver from at most ``SAMPLE`` distinct ones (least url
hash, the same at any partitioning), on length, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix, of its first
label and of the path's first part. Lexical features are computed where the urls are; only numbers and hashes come to the driver.

A suffix's block rate is the target's own mean, so a training row sees the rate of hosts of other folds only, shrunk to one half. One fold
of hosts is held out first, for ``held_out``, the accuracy on hosts never seen; the model that judges is fitted to all folds. It is
tens of KB, is broadcast, and judging is one narrow pass that reads no page.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship
from .sampling import least_hashed

Rule = tuple[str, str, str]
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SAMPLE, TREES, DEPTH, BINS, RATE = 20000, 60, 3, 32, 0.2
#: Folds of hosts: block rates that a training row sees come from the other folds, and one fold is held out. Prior rows of a rate.
FOLDS, PRIOR_ROWS = 5, 20
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "params", "hyphens", "underscores", "longest_token", "suffix_block_rate", "host_start_block_rate", "path_start_block_rate"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ? or # or the end, A-Z lower-cased; path: from there up to ? or # or the end. Else empty."""
    at = F.locate("://", url)
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = F.coalesce(at > 0, F.lit(False))
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule like ``net/es/``, verdict) of the longest rule that fits the host or a parent domain of it and the path's start; else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

    def fits(r: Rule) -> Column:
        return ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])

    def choose(value) -> Column:
        return reduce(lambda c, r: c.when(fits(r), F.lit(value(r))), ordered[1:], F.when(fits(ordered[0]), F.lit(value(ordered[0])))) if ordered else F.lit(None).cast("string")

    return choose(lambda r: r[0] + r[1]), choose(lambda r: r[2])


def keys(host: str, path: str) -> list[int]:
    """Hashes of the host's last two labels, of its first label and of the path's first part."""
    parts = (".".join(host.rsplit(".", 2)[-2:]), host.partition(".")[0], path.removeprefix("/").partition("/")[0])
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), signed=True) for x in parts]


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features but for the block rates."""
    n = max(len(url), 1)
    counts = np.bincount(np.frombuffer(url.encode(), np.uint8), minlength=1)
    p = counts[counts > 0] / max(counts.sum(), 1)
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), len([x for x in path.split("/") if x]), host.count(".") + 1, sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, len([x for x in query.split("&") if x]), url.count("-"), url.count("_"), max(map(len, re.split(r"[^A-Za-z0-9]+", url))),
    ]


@dataclass
class Rates:
    """Block rates by each of the keys' hashes; one without labels has the rate 0.5."""

    tables: list[dict[int, float]]

    @classmethod
    def of(cls, k: np.ndarray, y: np.ndarray) -> "Rates":
        share = min(max(float(y.mean()), 1e-9), 1 - 1e-9) if len(y) else 0.5
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both verdicts weigh alike
        tables = []
        for column in k.T:
            names, at = np.unique(column, return_inverse=True)
            bad, every = np.bincount(at, weight * y, len(names)), np.bincount(at, weight, len(names))
            tables.append(dict(zip(names.tolist(), ((bad + 0.5 * PRIOR_ROWS) / (every + PRIOR_ROWS)).tolist(), strict=True)))
        return cls(tables)

    def columns(self, k: np.ndarray) -> np.ndarray:
        return np.array([[t.get(int(x), 0.5) for x in column] for t, column in zip(self.tables, k.T, strict=True)]).T.reshape(-1, len(self.tables))


@dataclass
class Boosted:
    """Additive trees on binned features: base log-odds, bin edges, and (feature, bin, value) nodes in heap order for each tree."""

    base: float
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rates: Rates | None = None
    held_out: float | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += RATE * _walk(tree, b)
        return out


def _walk(tree, b: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    at = np.zeros(len(b), np.int64)
    for _ in range(DEPTH):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]), at)
    return value[at]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Newton-boosted trees for the log-odds of y = 1, on at most BINS quantile bins of each feature; no randomness."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))  # both verdicts weigh alike
    model = Boosted(0.0, edges, [])
    b, z = model.binned(x), np.full(len(x), model.base)
    size = 2 ** (DEPTH + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        at = np.zeros(len(x), np.int64)
        for node in range(size):
            mine = np.flatnonzero(at == node)
            G, H = g[mine].sum(), h[mine].sum()
            value[node] = -G / (H + 1.0)
            if node >= 2**DEPTH - 1 or len(mine) < 20:
                continue
            best = (1e-6, -1, 0)
            for k in range(x.shape[1]):
                gs, hs = (np.cumsum(np.bincount(b[mine, k], v[mine], len(edges[k]) + 1))[:-1] for v in (g, h))
                if len(gs):
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    i = int(np.argmax(gain))
                    best = max(best, (float(gain[i]), k, i), key=lambda t: t[0])
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[mine] = 2 * node + 1 + (b[mine, best[1]] > best[2])
        model.trees.append((feature, cut, value))
        z += RATE * _walk(model.trees[-1], b)
    return model


def _lexical_rows(batches):
    for batch in batches:
        rows = [(lexical(u, h, p), keys(h, p), zlib.crc32(h.encode()) % FOLDS) for u, h, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32()), batch.column(3)], ["x", "keys", "fold", "y"])


def _with_rates(x: np.ndarray, k: np.ndarray, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features of training rows: the block rates of each fold come from the others."""
    out = np.zeros(k.shape)
    for f in range(FOLDS):
        out[fold == f] = Rates.of(k[fold != f], y[fold != f]).columns(k[fold == f])
    return np.concatenate([x, out], 1)


def train(x: np.ndarray, k: np.ndarray, fold: np.ndarray, y: np.ndarray) -> Boosted | None:
    """The model of all rows, with its accuracy (mean of both verdicts) on a fold of hosts that a first model has not seen; None without both verdicts."""
    if not len(y) or y.min() == y.max():
        return None
    mine, held_out = fold != 0, None
    if len(set(y[mine])) == len(set(y[~mine])) == 2:
        first = boost(_with_rates(x[mine], k[mine], fold[mine], y[mine]), y[mine])
        right = (first.log_odds(np.concatenate([x[~mine], Rates.of(k[mine], y[mine]).columns(k[~mine])], 1)) > 0) == y[~mine]
        held_out = float(np.mean([right[y[~mine] == v].mean() for v in (0, 1)]))
    model = boost(_with_rates(x, k, fold, y), y)
    model.rates, model.held_out = Rates.of(k, y), held_out
    return model


def fit(urls: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    """From url, host, path, verdict of labelled rows, ``sample`` distinct urls at most (of a url's verdicts the least); None if they don't have both verdicts."""
    ship(urls.sparkSession)
    labelled = urls.where("verdict is not null and url is not null").groupBy("url").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.min("verdict").alias("verdict"))
    chosen = least_hashed(labelled, "url", sample).select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))
    found = chosen.mapInArrow(_lexical_rows, "x array<double>, keys array<bigint>, fold int, y int").toArrow()
    x, k = np.array(found["x"].to_pylist(), float).reshape(found.num_rows, len(FEATURES) - 3), np.array(found["keys"].to_pylist(), np.int64).reshape(found.num_rows, 3)
    fold, y = np.asarray(found["fold"]), np.asarray(found["y"]).astype(float)
    order = np.lexsort([*x.T, *k.T, y])  # sums of the fit don't depend on how rows arrive
    return train(x[order], k[order], fold[order], y[order])


def _judge(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            url, host, path = (batch.column(k).to_pylist() for k in (1, 2, 3))
            score = np.full(batch.num_rows, -1.0)
            if model is not None and batch.num_rows:
                x = np.array([lexical(u or "", h, p) for u, h, p in zip(url, host, path, strict=True)])
                score = model.log_odds(np.concatenate([x, model.rates.columns(np.array([keys(h, p) for h, p in zip(host, path, strict=True)]))], 1))
            learnt = np.where(score > 0, "block", "allow")
            verdict = [v or str(m) for v, m in zip(batch.column(5).to_pylist(), learnt, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "block_log_odds"])

    return run


def _parts(urls: DataFrame, *columns: str) -> DataFrame:
    host, path = host_path(F.col("url"))
    return urls.select(*columns, F.col("url").cast("string").alias("url")).select(*columns, "url", host.alias("host"), path.alias("path"))


def url_rules(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, and verdict where a rule fits (else null), of each row of pages; column expressions only."""
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parts = _parts(pages.select(F.col("page_id").try_cast("long").alias("page_id"), "url"), "page_id")
    return parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def url_verdicts(pages: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_log_odds for each row of pages (page_id, url; other columns are ignored).

    labelled: a table of url and verdict (allow or block) to learn from; without it the urls that rules decide. A null url, or one without
    ``://``, has an empty host and path, fits no rule and is left to the model, like every url without a rule; where labelled urls of both
    verdicts are missing, the model allows. Repeated rows are judged alike; an empty table gives an empty result. Urls are read whole.
    """
    ruled = url_rules(pages, rules)
    model = fit(ruled if labelled is None else _parts(labelled, "verdict"), sample)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return ruled.mapInArrow(_judge(shared), "page_id long, host string, path string, rule string, verdict string, block_log_odds double")
