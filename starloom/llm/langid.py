"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the bag of its words and their letter n-grams (2 to 4 letters, word ends marked), hashed into
``BUCKETS``; the average of their embeddings goes through a linear softmax. Training is stochastic gradient
descent in numpy over a bounded sample; a tenth of it is kept back to fit the temperature of the softmax and the
score below which a prediction is rejected. Averaging is linear, so scoring adds each bucket's logits.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; texts of any length
are read whole; of languages with equal scores the first by name wins; rows that repeat get the same answer each (in the sample
an id counts once per text); without a sample every text is ``und``; an empty table has no rows. All columns of the input stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import bounded_sample, filled, fold_of, mix

SAMPLE = 3_000
BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4)
LETTERS = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000
UNKNOWN = "und"


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of words (runs of letters): buckets, and the place of the word that each belongs to."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(marked)), lengths)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in marked), np.int64, len(marked))
    buckets, owners = [whole & (BUCKETS - 1)], [np.arange(len(marked))]
    for n in GRAMS:
        inside = np.flatnonzero(np.arange(len(codes)) + n <= ends)
        value = np.full(len(inside), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + codes[inside + k]
        buckets.append((mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, ascending, and how often each occurs."""
    counts = Counter(w for w in LETTERS.findall(text.lower()))
    buckets, owners = buckets_of(list(counts))
    often = np.fromiter(counts.values(), np.int64, len(counts))[owners]
    total = np.bincount(buckets, often, BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


@dataclass
class LanguageModel:
    names: list[str]
    logits: np.ndarray  # of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 14, len(self.names) + 1))  # logits of each known run, and its number of subwords

    def _learn(self, new: list[str]) -> None:
        """Remember the sums of runs of characters; the room for them doubles."""
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        while len(self.sums) < len(self.known):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        found = [LETTERS.findall(piece) for piece in new]
        buckets, owners = buckets_of([w for f in found for w in f])
        owners = np.repeat(np.arange(len(new)), np.fromiter(map(len, found), np.int64, len(new)))[owners]
        for k in range(len(self.names)):
            self.sums[first : first + len(new), k] = np.bincount(owners, self.logits[buckets, k], len(new))
        self.sums[first : first + len(new), -1] = np.bincount(owners, minlength=len(new))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the score is too low to be trusted."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores, scores < self.threshold
        if len(self.known) > REMEMBERED:
            self._forget()
        found = [t.lower().split() for t in texts]
        pieces = [p for f in found for p in f]
        self._learn(list(set(pieces).difference(self.known)))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        some = np.flatnonzero([len(f) for f in found])
        starts = np.cumsum([0, *map(len, found)])[some]
        total = np.add.reduceat(self.sums[at], starts, 0) if len(some) else np.zeros((0, len(self.names) + 1))
        some, total = some[total[:, -1] > 0], total[total[:, -1] > 0]
        shares = softmax((total[:, :-1] / total[:, -1:] + self.bias) / self.temperature)
        for i, k, share in zip(some.tolist(), shares.argmax(1).tolist(), shares.max(1), strict=True):
            names[i], scores[i] = self.names[k], share
        return names, scores, scores < self.threshold


def train(bags: list[tuple[np.ndarray, np.ndarray]], languages: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> LanguageModel:
    """Fit to documents given as (bucket, count) bags."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    labels = np.array([names.index(x) for x in languages])
    random = np.random.default_rng(seed)
    order = random.permutation(len(bags))
    kept_back, learn = order[: len(order) // 10], order[len(order) // 10 :]
    embedding = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in random.permutation(learn):
            at, count = bags[i]
            if not len(at):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ embedding[at]
            error = softmax(mean @ weights + bias)
            error[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # The gradient of the average is spread over its subwords; scaled by their number it moves each as a whole.
            embedding[at] -= (step * np.sqrt(len(at)) * share[:, None] * back).astype(np.float32)
            done += 1
    model = LanguageModel(names, (embedding @ weights).astype(np.float32), bias, 1.0, 0.0)
    checked = [(i, (bags[i][1] @ model.logits[bags[i][0]]) / bags[i][1].sum() + bias) for i in kept_back if len(bags[i][0])]
    if checked:
        logits, truth = np.array([x for _, x in checked]), labels[[i for i, _ in checked]]
        grid = np.geomspace(0.02, 5, 60)
        losses = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        shares = softmax(logits / model.temperature)
        model.threshold = rejection_threshold(shares.max(1), shares.argmax(1) == truth)
    return model


def rejection_threshold(scores: np.ndarray, right: np.ndarray, wanted: float = 0.99) -> float:
    """The lowest score from which on at least ``wanted`` of the predictions are right, at most 0.5 if all are right."""
    order = np.argsort(-scores, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= wanted)
    return min(float(scores[order][good[-1]]), 0.5 if right.all() else 1.0) if len(good) else 1.0


def fit(docs: DataFrame, bound: int = SAMPLE, text: str = "text") -> LanguageModel:
    """Learn from at most ``bound`` documents outside fold 1 of 3 with a language, chosen by the hash of doc_id."""
    known = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    ids = bounded_sample(known.select("doc_id").distinct(), "doc_id", bound)
    rows = known.select("doc_id", F.col(text).alias("text"), "lang").join(F.broadcast(ids), "doc_id")

    def bagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [b"".join(x.astype("<u4").tobytes() for x in bag_of(t)) for t in filled(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "bag": packed, "lang": batch["lang"]})

    got = rows.mapInPandas(bagged, "doc_id string, bag binary, lang string").orderBy("doc_id", "bag").limit(bound).collect()
    bags = []
    for r in got:
        both = np.frombuffer(r["bag"], "<u4").astype(np.int64).reshape(2, -1)
        bags.append((both[0], both[1]))
    return train(bags, [r["lang"] for r in got])


def predict(text: Column, model) -> Column:
    """Struct of lang_pred, score and rejected by a broadcast model."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            filled_texts = filled(texts)
            out = []
            for start in range(0, len(filled_texts), 256):
                names, scores, low = model.value.predict(filled_texts[start : start + 256])
                out.append(pd.DataFrame({"lang_pred": names, "score": scores, "rejected": low | (np.array(names) == UNKNOWN)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float), "rejected": pd.Series(dtype=bool)})

    return run(text)


def identify_language(docs: DataFrame, learn_from: DataFrame | None = None, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred, score and rejected; learns from ``learn_from`` (or ``docs``)."""
    model = fit(docs if learn_from is None else learn_from)
    return docs.withColumn(into, predict(F.col(text), docs.sparkSession.sparkContext.broadcast(model)))
