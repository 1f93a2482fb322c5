"""Quality by a generalised additive model with pairwise interactions.

A text becomes FEATURES. Each feature's range is cut into bins at quantiles of
the fitted rows, and the model is a lookup table of log odds for each feature
and for PAIRS pairs of features. The tables are learned by boosting in turn:
round after round, each feature gets one shallow tree over its bins, fitted to
what all tables together still get wrong; then pairs, chosen by how much a tree
over both would gain, are boosted the same way. Scoring is a bin search and an
addition for each table, for all rows of a block at once.

At most FIT_EACH labelled documents of either label are used for the fit. The
texts are read where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._labels import held_out, training

FIT_EACH = 4000
FEATURES = ("bytes", "words", "word_length", "upper", "digits", "symbols", "pipes", "non_ascii", "lines", "stops", "distinct", "repeated", "top_share", "symbol_ends")
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 24, 8, 6, 120, 60, 0.15, 1.0

_UPPER, _DIGIT, _SYMBOL, _PIPE, _WIDE, _LINE, _STOP = range(7)
_KIND = np.full(256, 255, np.uint8)
for _group, _chars in ((_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_SYMBOL, b"!#$%&*+/<=>@[\\]^_`{}~"), (_PIPE, b"|"), (_LINE, b"\n"), (_STOP, b".,;:?")):
    _KIND[list(_chars)] = _group
_KIND[128:] = _WIDE


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    start, end, first = T.words(data, offsets)
    words = np.diff(first).astype(float)
    some, any_ = np.maximum(size, 1), np.maximum(words, 1)
    kind = _KIND[data]

    def share(group: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == group, dtype=np.int32)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    for column, group in ((3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, _PIPE), (7, _WIDE)):
        out[:, column] = share(group) / some
    out[:, 8], out[:, 9] = share(_LINE) / any_, share(_STOP) / any_
    text = np.repeat(np.arange(n), np.diff(first))
    h = T.span_hash(T.lower(data), start, end)
    out[:, 2] = np.bincount(text, end - start, n) / any_
    out[:, 13] = np.bincount(text, (kind[end - 1] == _SYMBOL) | (kind[end - 1] == _PIPE), n) / any_
    same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out[:, 11] = np.bincount(text[1:][same], minlength=n) / any_
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    out[:, 10] = np.bincount(text[at], minlength=n) / any_
    most = np.zeros(n)
    np.maximum.at(most, text[at], np.diff(np.append(at, len(h))))
    out[:, 12] = most / any_
    return out


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return -g.sum() / (h.sum() + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins; place 0 if none gains."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a tree of this depth over bins with gradients g and curvatures h."""
    _, at = _cut(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree that cuts one way and then each part the other way."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            parts = [(a[:at].sum(0), b[:at].sum(0)), (a[at:].sum(0), b[at:].sum(0))]
            gain = sum(_cut(*p)[0] + p[0].sum() ** 2 / (p[1].sum() + RIDGE) for p in parts)
            if gain > best:
                best = gain
                values = np.concatenate([np.tile(tree(*parts[0], 1), (at, 1)), np.tile(tree(*parts[1], 1), (len(a) - at, 1))])
                out = values.T if turned else values
    return best, out


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        fine, wide = self.bins(x, self.edges), self.bins(x, self.coarse)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[fine[:, j]]
        for (i, j), table in self.pairs.items():
            out += table[wide[:, i], wide[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables by boosting in turn; x has a row of FEATURES for each label in y."""
    cut = lambda bins: [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model(cut(BINS), cut(PAIR_BINS), float(np.log(share / (1 - share))), [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine, wide = model.bins(x, model.edges), model.bins(x, model.coarse)
    odds = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * tree(np.bincount(fine[:, j], g, len(table)), np.bincount(fine[:, j], h, len(table)))
            table += step
            odds += step[fine[:, j]]

    def sums(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(wide[:, i] * shape[1] + wide[:, j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((pair_tree(sums(i, j, g), sums(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = RATE * pair_tree(sums(i, j, g), sums(i, j, h))[1]
            table += step
            odds += step[wide[:, i], wide[:, j]]
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        for i, j, part, at in T.blocks(data, offsets):
            yield pa.RecordBatch.from_pydict({"x": pa.array(features(part, at).tolist(), pa.list_(pa.float64())), "y": batch.column("label").slice(i, j - i)})


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, each: int = FIT_EACH) -> Model | None:
    """A model of labels.quality from at most each documents of either label that aren't held out; None without any."""
    rows = training(docs, labels, "quality", modulus, rest, each).mapInArrow(_described, "x array<double>, y int").collect()
    if not rows:
        return None
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    order = np.lexsort((*x.T, y))  # sums in a fixed order
    return fit(x[order], y[order])


def scored_batches(model: Model | None):
    """Batches with a column text, with quality_score added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            found = [model.score(features(part, at)) if model else np.full(len(at) - 1, 0.5) for _, _, part, at in T.blocks(data, offsets)]
            yield T.with_columns(batch, {"quality_score": pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())})

    return run


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with quality_score from 0 to 1; only the text counts.

    Defined cases: null and empty texts score alike, by a row of zeros; equal
    texts get equal scores; without a model every score is 0.5; an input
    column quality_score is replaced, others pass.
    """
    docs = docs.drop("quality_score")
    return docs.mapInArrow(scored_batches(model), T.schema_of(docs.schema, "quality_score double"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
