"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-case words and their beginnings of 3 to 6 letters, each hashed to 26 bits; a text
is the set of its terms. The most telling hashed terms of a bounded labelled sample get a weight and a factor vector
each, so that pairs of terms (an insult beside a group's name) count beyond the sum of their weights. Training
is AdaGrad on the logistic loss in numpy on the driver; ``SAMPLE`` documents at most and ``SLOTS`` terms bound its
memory. Scoring is one pass without a shuffle.

Defined cases: null and empty texts get the score of a text without terms; texts of any length are read whole;
repeated rows get equal scores; without labels, or with one class only, the score is the smoothed share of label 1.
All columns of the input stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import WORD, filled, labelled_sample, sigmoid

SAMPLE = 8_000
SLOTS = 4_096
FACTORS = 8
BITS = 26
BEGINNINGS = (3, 4, 5, 6)
REMEMBERED = 300_000


def hashed_terms(piece: str) -> set[int]:
    """Hashed terms of a run of characters without white space."""
    out = set()
    for word in WORD.findall(piece):
        out.add(zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - BITS))
        for n in BEGINNINGS:
            if len(word) > n:
                out.add(zlib.crc32(f"{word[:n]}-".encode("utf-8", "surrogatepass")) >> (32 - BITS))
    return out


@dataclass
class FactorizationMachine:
    slots: np.ndarray  # hashed terms, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    remembered: dict = field(default_factory=dict)

    def __post_init__(self):
        self.place = {int(term): i for i, term in enumerate(self.slots)}

    def active(self, text: str) -> list[int]:
        """Positions of the text's terms that the model knows."""
        if not len(self.slots):
            return []
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        known, place, found = self.remembered, self.place, set(text.lower().split())
        for piece in found.difference(known):
            known[piece] = tuple(place[t] for t in hashed_terms(piece) if t in place)
        return sorted({slot for piece in found for slot in known[piece]})

    def raw(self, active: list[int]) -> float:
        if not active:
            return self.bias
        chosen = self.factors[active]
        together = chosen.sum(0)
        return self.bias + self.weights[active].sum() + 0.5 * float(together @ together - (chosen * chosen).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(np.array([self.raw(self.active(t)) for t in texts], float))


def telling_terms(rows: list[np.ndarray], labels: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The hashed terms that tell the classes apart by the likelihood-ratio test, sorted.

    The bar is 2 ln(number of terms), which chance alone hardly passes among so many terms, so rare words of
    single documents stay out (they would add up in long texts); if no term passes, the best 16 are kept.
    """
    terms, where = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    total = np.bincount(where, minlength=len(terms)).astype(float)
    positive = np.bincount(where, weights=labels[row], minlength=len(terms))
    n, n1 = len(labels), labels.sum()
    gain = np.zeros(len(terms))
    for seen, expected in (
        (positive, total * n1 / n), (total - positive, total * (n - n1) / n),
        (n1 - positive, (n - total) * n1 / n), (n - n1 - total + positive, (n - total) * (n - n1) / n),
    ):
        gain += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    best = np.lexsort((terms, -gain))[:slots]
    passing = int((gain[best] > 2 * np.log(max(len(terms), 2))).sum())
    return np.sort(terms[best[: passing or 16]])


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fit to documents given as distinct hashed terms."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(rows) == 0 or labels.min() == labels.max():
        return FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    slots = telling_terms(rows, labels)
    found = []
    for r in rows:
        at = np.minimum(np.searchsorted(slots, r), len(slots) - 1)
        found.append(np.unique(at[slots[at] == r]))
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), random.normal(0, 0.01, (len(slots), FACTORS))
    gw, gv, gb = np.full(len(slots), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        for i in random.permutation(len(found)):
            s = found[i]
            chosen = v[s]
            together = chosen.sum(0)
            raw = bias + w[s].sum() + 0.5 * (together @ together - (chosen * chosen).sum())
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[i]
            gb += error * error
            bias -= rate * error / np.sqrt(gb)
            if len(s):
                dw = error + decay * w[s]
                gw[s] += dw * dw
                w[s] -= rate * dw / np.sqrt(gw[s])
                dv = error * (together - chosen) + decay * chosen
                gv[s] += dv * dv
                v[s] -= 0.3 * rate * dv / np.sqrt(gv[s])
    return FactorizationMachine(slots, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> FactorizationMachine:
    """Learn from at most ``bound`` labelled documents (see ``labelled_sample``); terms are hashed on the executors."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for text in filled(batch["text"]):
                terms = set().union(*map(hashed_terms, set(text.lower().split())))
                packed.append(np.array(sorted(terms), "<u4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "terms": packed, "label": batch["label"]})

    rows = labelled_sample(docs, labels, label, bound).mapInPandas(hashed, "doc_id string, terms binary, label int")
    got = rows.orderBy("doc_id", "terms").limit(bound).collect()
    return train([np.frombuffer(r["terms"], "<u4").astype(np.int64) for r in got], np.array([r["label"] > 0 for r in got], float))


def score(text: Column, model) -> Column:
    """Score of a text column by a broadcast model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.scores(filled(texts)))

    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the score ``into``; the model learns from ``learn_from`` (``docs`` itself if not given)."""
    model = fit(docs if learn_from is None else learn_from, labels)
    return docs.withColumn(into, score(F.col(text), docs.sparkSession.sparkContext.broadcast(model)))
