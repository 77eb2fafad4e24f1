"""Text helpers and table access shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(texts: Iterable[str | None]) -> list[str]:
    """Texts with null as the empty text."""
    return [text if isinstance(text, str) else "" for text in texts]


def words(text: str) -> list[str]:
    """Lower-case words (letters, digits, underscores) of a whole text."""
    return WORD.findall(text.lower())


class Memory:
    """Number lists by text (or its bytes); emptied when it holds too many."""

    def __init__(self, limit: int):
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str | bytes, int] = {}
        self.ids = self.starts = self.lengths = np.zeros(0, np.int64)

    def missing(self, texts: list, distinct: bool = False) -> list:
        """The unknown texts, each once; ``distinct``: no text comes twice."""
        if len(self.known) > self.limit:
            self._empty()
        return list(filterfalse(self.known.__contains__, texts) if distinct else set(texts).difference(self.known))

    def add(self, texts: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(texts, range(first, first + len(texts)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts one after the other, and how many each has."""
        at = np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))
        lengths = self.lengths[at]
        return self.ids[ragged(self.starts[at], lengths)], lengths


class WordHashes:
    """64-bit hashes of the words of texts; those of runs without white space are remembered, within a limit."""

    def __init__(self, limit: int = 300_000):
        self.memory = Memory(limit)

    def __call__(self, found: list[str]) -> np.ndarray:
        """Hashes of given words."""
        digests = b"".join([xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass")) for w in found])
        return np.frombuffer(digests, ">u8").astype(np.uint64)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The hashes of each text's ``words``, in order."""
        for start, end in blocks(texts):
            lowered = pa.array([t.lower().encode("utf-8", "surrogatepass") for t in texts[start:end]], pa.binary())
            split = pc.ascii_split_whitespace(lowered.cast(pa.string(), safe=False))  # other white space is no word either
            coded = split.values.dictionary_encode()
            pieces = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            new = self.memory.missing(pieces, distinct=True)
            parts = [[p] if p.isalnum() else WORD.findall(p) for p in (p.decode("utf-8", "surrogatepass") for p in new)]
            hashes = self([w for part in parts for w in part]).view(np.int64)
            self.memory.add(new, hashes, np.array([len(p) for p in parts], np.int64))
            known, lengths = self.memory.gather(pieces)
            at = coded.indices.to_numpy()
            counts = lengths[at]
            found = known[ragged((np.cumsum(lengths) - lengths)[at], counts)].view(np.uint64)
            ends = np.r_[0, np.cumsum(counts)][split.offsets.to_numpy()]
            for k in range(end - start):
                yield found[ends[k] : ends[k + 1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(width, n)
    base = np.uint64(0x9E3779B97F4A7C15)
    out = hashes[: n - take + 1].copy()
    for k in range(1, take):
        out = out * base + hashes[k : n - take + 1 + k]
    return mix(out + np.uint64(take))


def blocks(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters together, at least one text each."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] … starts[i] + lengths[i] - 1 of all runs, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids belong to no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by the hash of ``key``: the same rows for the same table, in any order."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, text: str = "text") -> DataFrame:
    """(text, label) of at most ``bound`` labelled documents outside fold 0 of 5, chosen by the hash of doc_id.

    Rows without an id, label or fold are left out; of repeated labels of one document the largest counts.
    The sampled ids are broadcast: ``bound`` is their proven size.
    """
    known = labels.where(F.col(label).isNotNull() & (fold_of(F.col("doc_id"), 5) != 0))
    ids = bounded_sample(known.groupBy("doc_id").agg(F.max(label).alias("_label")), "doc_id", bound)
    joined = docs.select(F.col("doc_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "doc_id")
    return joined.select("doc_id", F.col("_text").alias("text"), F.col("_label").cast("int").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
