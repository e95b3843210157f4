"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers from its whole bytes. Training learns one lookup table
per feature by cyclic boosting: round after round, every feature in turn gets a small
tree over its bins that fits the current gradients. The most useful pairs of features
then get two-dimensional tables the same way. A score is the logistic of a sum of
table entries, so scoring is a bin search and an addition per feature.

Training rows are a bounded sample of the labelled rows, chosen by a hash of the id
(``TRAIN_ROWS`` expected rows); equal rows are merged with a weight before they leave
the executors. Everything else works on all rows.

Defined results: a null text scores like an empty one; without labels of both classes
every score is the share of class 1 (0.5 without labels) and ``keep_good`` rejects
nothing; documents with several labels
count once for each; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = [
    "log_words", "word_length", "lower", "upper", "digits", "plain_punctuation", "symbols", "exclamation", "pipes",
    "other_bytes", "spaces", "line_ends", "distinct_words", "symbol_words", "repeated_lines", "log_longest_word",
]
#: Expected training rows, and the largest share of a hash range they are chosen by.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 120, 40, 0.15, 4.0

_CLASS = np.zeros(256, np.int64)  # 0: symbols and control characters
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?()-", b"!", b"|", b" \t\r\x0b\x0c", b"\n"), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASS[128:] = 9


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) / n
    symbols, lower, upper, digits, plain, exclamation, pipes, spaces, ends, other = by_class.tolist()
    words = raw.split()
    m = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    odd = sum(1 for w in words if _CLASS[w[-1]] in (0, 5, 6))
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / m, lower, upper, digits, plain, symbols, exclamation, pipes,
        other, spaces, ends, len(set(words)) / m, odd / m, 1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(max(map(len, words), default=0))),
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    @property
    def trained(self) -> bool:
        return bool(self.pairs)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += entries[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), entries in zip(self.pairs, self.pair_tables, strict=True):
            out += entries[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad**2 / (hess + SHRINK)


def _cut(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting a run of bins in two, and the first bin of the second part."""
    if len(grad) < 2:
        return 0.0, 0
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gains = _gain(g, h) + _gain(grad.sum() - g, hess.sum() - h) - _gain(grad.sum(), hess.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of at most three leaves."""
    cuts = {0, len(grad)}
    for _ in range(2):
        bounds = sorted(cuts)
        best = max(((*_cut(grad[a:b], hess[a:b]), a) for a, b in zip(bounds, bounds[1:], strict=False)), default=(0, 0, 0))
        if best[0] <= 0:
            break
        cuts.add(best[2] + best[1])
    bounds, out = sorted(cuts), np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + SHRINK)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts the first feature once and the second once
    on either side, and its gain."""
    best, out = -1.0, np.zeros_like(grad)
    for at in range(1, grad.shape[0]):
        sides, total, parts = [(0, at), (at, grad.shape[0])], 0.0, []
        for a, b in sides:
            gain, cut = _cut(grad[a:b].sum(axis=0), hess[a:b].sum(axis=0))
            parts.append((a, b, cut if gain > 0 else grad.shape[1]))
            for c, d in ((0, parts[-1][2]), (parts[-1][2], grad.shape[1])):
                total += _gain(grad[a:b, c:d].sum(), hess[a:b, c:d].sum())
        if total > best:
            best, out = total, np.zeros_like(grad)
            for a, b, cut in parts:
                for c, d in ((0, cut), (cut, grad.shape[1])):
                    out[a:b, c:d] = grad[a:b, c:d].sum() / (hess[a:b, c:d].sum() + SHRINK)
    return out, best - float(_gain(grad.sum(), hess.sum()))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Boosted tables for labels ``y`` (0 or 1) of weighted rows ``x``."""
    x = x.reshape(-1, len(FEATURES))
    total, positive = float(weight.sum()), float((weight * y).sum())
    share = positive / total if total else 0.5
    plain = not total or not 0 < share < 1
    bound = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(bound / (1 - bound)))
    edges = [np.zeros(0) if plain else _edges(x[:, f], BINS) for f in range(len(FEATURES))]
    pair_edges = [np.zeros(0) if plain else _edges(x[:, f], PAIR_BINS) for f in range(len(FEATURES))]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [], pair_edges, [])
    if plain:
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    margin = np.full(len(x), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, entries in enumerate(model.tables):
            grad, hess = gradients()
            step = RATE * _tree(np.bincount(bins[f], grad, len(entries)), np.bincount(bins[f], hess, len(entries)))
            entries += step
            margin += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    wide = [len(e) + 1 for e in pair_edges]

    def cells(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = coarse[f] * wide[g] + coarse[g]
        grad, hess = (np.bincount(flat, v, wide[f] * wide[g]).reshape(wide[f], wide[g]) for v in gradients())
        return flat, grad, hess

    every = [(f, g) for f in range(len(wide)) for g in range(f)]
    ranked = sorted(every, key=lambda p: -_pair_tree(*cells(*p)[1:])[1])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((wide[f], wide[g])) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), entries in zip(model.pairs, model.pair_tables, strict=True):
            flat, grad, hess = cells(f, g)
            step = RATE * _pair_tree(grad, hess)[0]
            entries += step
            margin += step.reshape(-1)[flat]
    return model


def held_out(identity: str = "doc_id") -> Column:
    """Rows that no model learns labels from; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(identity).cast("string")) % 4 == 2, F.lit(False))


def _vectors() -> Callable:
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return vectors


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, identity: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    usable = labels.select(F.col(identity).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    usable = usable.where(~held_out("id"))
    share = min(1.0, train_rows / max(usable.count(), 1))
    slots = 1 << 30
    sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(slots)) < int(share * slots))
    # About train_rows pairs of numbers, by the choice of the share above.
    chosen = docs.select(F.col(identity).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), "id")
    rows = chosen.select("y", _vectors()("t").alias("x")).groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    # In an order of their own, so that a rerun adds in the same order.
    ordered = sorted(zip(map(tuple, rows["x"]), rows["y"], rows["n"], strict=True))
    x = np.array([r[0] for r in ordered], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in ordered], float), np.array([r[2] for r in ordered], float))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, null as empty, added as ``name``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x), dtype=float)

    return docs.withColumn(name, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: id, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, identity=identity, text=text)
    rows = scored(docs.select(F.col(identity), F.col(text).alias("__text")), model, "__text")
    return rows.select(identity, held_out(identity).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score is below the threshold."""
    model = train(docs, labels, identity=identity, text=text)
    if not model.trained:
        return docs
    return scored(docs, model, text, "__score").where(F.col("__score") >= threshold).select(*docs.columns)
