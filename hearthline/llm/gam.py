"""A generalised additive quality classifier with pairwise interactions.

Each feature of a text is cut into bins. Training goes round and round over the features; at each, a shallow tree of a
few leaves is fitted to the logistic loss's gradient and, times a small rate, added to that feature's table of one
number a bin. After the main effects, the pairs of features whose grid explains most of what is left get tables of
their own in the same way. A score is the sigmoid of the sum of the numbers that a text's bins point at.

Bounds: at most TRAIN_ROWS labelled rows, those first by a hash of the id, are learned from; only their features reach
the driver. Scoring reads whole texts.

Defined results: null texts are empty, and an empty text is scored like any other; labels of null id or value are left
out, an id with several labels counts once for each, and of several documents of an id the least text is learned from; with no labels at all every score is PRIOR; repeated rows are
scored alike; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

TRAIN_ROWS, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE, RIDGE, PRIOR = 20_000, 32, 8, 150, 60, 6, 3, 0.1, 1.0, 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "distinct", "marks", "beyond_ascii", "line_words", "twins", "top_word", "controls")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL, MARK, UPPER, DIGIT = _mask("#*$%&|<>"), _mask(".,;:!?"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n, seen = max(1, len(words)), np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    grams = len(words) - 4
    counts = Counter(words)
    return [
        float(np.log1p(len(words))),
        (len(text) - int(seen[[32, 9, 10, 11, 12, 13]].sum())) / n,
        float(seen[SYMBOL].sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) / grams if grams > 0 else 0.0,
        float(seen[UPPER].sum()) / size,
        float(seen[DIGIT].sum()) / size,
        len(counts) / n,
        float(seen[MARK].sum()) / n,
        float(seen[128:].sum()) / size,
        len(words) / max(1, len(lines)),
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        float(seen[:9].sum() + seen[14:32].sum()) / size,
    ]


@dataclass
class Gam:
    """edges: of each feature's bins; tables: one number a bin; pairs: (feature, feature, edges, edges, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, ea, eb, t in self.pairs:
            z += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins, halfway between neighbouring values so that each side of a gap has room."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[:-1] + values[1:]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain of a cut of the bins in two, and the first bin of the right part; bins lie on the last axis."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = g.cumsum()[:-1], h.cumsum()[:-1]
    gains = _gain(lg, lh) + _gain(g.sum() - lg, h.sum() - lh) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most LEAVES leaves."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        gain, at, k = max((*_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of a tree that cuts one feature, then the other on each side; and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, gg.shape[0]):
            gain, leaves = 0.0, np.zeros_like(gg)
            for part in (slice(0, at), slice(at, None)):
                pg, ph = gg[part].sum(axis=0), hh[part].sum(axis=0)
                _, k = _cut(pg, ph)
                for side in (slice(0, k), slice(k, None)):
                    sg, sh = pg[side].sum(), ph[side].sum()
                    gain += float(_gain(sg, sh))
                    leaves[part, side] = sg / (sh + RIDGE)
            if gain > best:
                best, out = gain, leaves.T if turned else leaves
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam(float(np.log(PRIOR / (1 - PRIOR))), [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(float(np.log(share / (1 - share))))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slope()
            n = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            z += step[b]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    spots = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = spots[a] * shape[1] + spots[b]
        g, h = slope()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -pair_tree(*grid(*p)[1:])[1])[:PAIRS]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            at, g, h = grid(*p)
            step = RATE * pair_tree(g, h)[0]
            tables[p] += step
            z += step.reshape(-1)[at]
    model.pairs = [(a, b, coarse[a], coarse[b], t) for (a, b), t in tables.items()]
    return model


def feature_lists(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Gam:
    """A model from at most `rows` labels (distinct pairs of id and label), by the hash of their ids; that many short rows are broadcast.

    Where an id has several documents the one with the least text counts, so that at most `rows` feature rows reach the driver.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("double").alias("__y"))
    chosen = cut(chosen.distinct().orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen.select("__id").distinct()), "__id", "left_semi")
    own = own.groupBy("__id").agg(F.min("__t").alias("__t")).select("__id", F.pandas_udf(feature_lists, "array<double>")("__t").alias("x"))
    got = own.join(F.broadcast(chosen), "__id").select("x", "__y").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort([*x.T, got["__y"].to_numpy()])  # the sums don't depend on how rows came
    return fit(x[order], got["__y"].to_numpy(dtype=float)[order])


def classify(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """docs without the text, with score. The model is a few thousand numbers."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(NAMES))))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    own = docs.drop("score")
    return own.withColumn("score", F.pandas_udf(score, "double")(text_col)).drop(text_col)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = classify(docs.withColumn("held_out", held_out), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
