"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (character classes, words, lines, repetition) are cut into ``BINS`` quantile bins; trees
of fixed depth grow level by level from gradient histograms. All trees are flattened into arrays (feature, cut,
leaf value in heap order), which numpy walks for many documents and all trees at once. Training takes at most
``SAMPLE`` labelled documents, of which only the statistics reach the driver; scoring is one pass without a shuffle.

Defined cases: null and empty texts have zero statistics and get the score of those; texts of any length are read
whole; repeated rows get equal scores; without labels, or with one class only, the score is the smoothed share of
label 1. All columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import blocks, filled, labelled_sample, sigmoid

SAMPLE = 30_000
BINS = 64
DEPTH = 4
TREES = 80
FEATURES = (
    "chars", "words", "word_length", "lower", "upper", "digit", "space", "mark", "symbol", "distinct_words",
    "short_words", "lines", "distinct_lines", "line_length", "pieces_with_mark", "longest_word",
)
KINDS = 6  # lower or other letter, upper, digit, space, punctuation, symbol


def character_kinds() -> np.ndarray:
    """Kind of each character below 65,536; those above count as the last one."""
    kinds = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            kinds[code] = 1 if c.isupper() else 0
        elif c.isdigit():
            kinds[code] = 2
        elif c.isspace():
            kinds[code] = 3
        else:
            kinds[code] = 4 if c in ".,;:!?'\"()-–—…«»¿¡" else 5
    return kinds


_KINDS: list[np.ndarray] = []


def statistics(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    if not _KINDS:
        _KINDS.append(character_kinds())
    out = np.zeros((len(texts), len(FEATURES)))
    for start, end in blocks(texts):
        part = texts[start:end]
        sizes = np.array([len(t) for t in part])
        codes = np.minimum(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
        row = np.repeat(np.arange(len(part)) * KINDS, sizes)
        shares = np.bincount(row + _KINDS[0][codes], minlength=len(part) * KINDS).reshape(-1, KINDS)
        shares = shares / np.maximum(sizes, 1)[:, None]
        for k, text in enumerate(part):
            pieces, lines = text.split(), text.split("\n")
            if not pieces:
                out[start + k, 0] = sizes[k]
                out[start + k, 3:9] = shares[k]
                continue
            lengths = list(map(len, pieces))
            n = len(pieces)
            out[start + k] = (
                sizes[k], n, sum(lengths) / n, *shares[k], len(set(pieces)) / n, sum(x < 4 for x in lengths) / n,
                len(lines), len(set(lines)) / len(lines), sizes[k] / len(lines),
                sum(not p.isalnum() for p in pieces) / n, max(lengths),
            )
    return out


@dataclass
class Trees:
    feature: np.ndarray  # trees × inner nodes, in heap order
    cut: np.ndarray
    value: np.ndarray  # trees × leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))
            for start in range(0, len(x), 4096):
                part = x[start : start + 4096]
                node = np.zeros((len(part), len(tree)), np.int64)
                for _ in range(DEPTH):
                    right = part[np.arange(len(part))[:, None], self.feature[tree, node]] > self.cut[tree, node]
                    node = 2 * node + 1 + right
                out[start : start + 4096] += self.value[tree, node - (2**DEPTH - 1)].sum(1)
        return sigmoid(out)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees on the logistic loss; every leaf holds a Hessian sum of at least ``least``."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = sigmoid(raw)
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # number inside its level
        for level in range(DEPTH):
            width = 2**level
            best = np.zeros(width)
            chosen, at = np.zeros(width, np.int64), np.full(width, BINS)
            for f in range(x.shape[1]):
                key = node * BINS + bins[:, f]
                left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better], chosen[better], at[better] = top[better], f, k[better]
            first = width - 1
            feature[t, first : first + width] = chosen
            cut[t, first : first + width] = [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(chosen, at, strict=True)]
            node = 2 * node + (bins[np.arange(len(y)), chosen[node]] > at[node])
        sum_g, sum_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value[t] = -rate * sum_g / (sum_h + ridge)
        raw += value[t][node]
    return Trees(feature, cut, value, base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Trees:
    """Learn from at most ``bound`` labelled documents (see ``labelled_sample``)."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = statistics(filled(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "x": list(rows), "label": batch["label"]})

    rows = labelled_sample(docs, labels, label, bound).mapInPandas(measured, "doc_id string, x array<double>, label int")
    got = rows.orderBy("doc_id", "x").limit(bound).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, (got["label"].to_numpy() > 0).astype(float))


def score(text: Column, model) -> Column:
    """Score of a text column by a broadcast model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.scores(statistics(filled(texts))))

    return run(text)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with the score ``into``; the model learns from ``learn_from`` (``docs`` itself if not given)."""
    model = fit(docs if learn_from is None else learn_from, labels)
    return docs.withColumn(into, score(F.col(text), docs.sparkSession.sparkContext.broadcast(model)))
