"""Benchmark decontamination by the q-gram lemma.

Characters are folded (lower case; everything but letters and digits is one space; runs of spaces are one). A
benchmark item of m characters and its copy with at most e edits share at least m - q + 1 - q·e q-grams, and these
lie on diagonals that differ by at most e. So shared q-grams are counted in overlapping bands of diagonals for each
document and item, bands that reach the bound are kept, and an alignment inside the band decides.

The benchmark goes to the executors in blocks of at most ``BLOCK`` characters, so a broadcast has a proven size
whatever the benchmark's; documents are scanned once per block and never shuffled.

Defined cases: null and empty texts hold nothing; texts of any length are read whole (long ones in overlapping
pieces); items with fewer than q folded characters or null text can't be found; repeated rows and items are each
reported; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.align import best_match
from starloom.llm.common import blocks, filled, ragged

Q = 10
EDITS = 0.08  # edits per character of an item
BLOCK = 2_000_000
PIECE = 1 << 19
SPACE, BETWEEN = 32, 1
MULTIPLIER = 0x9E3779B97F4A7C15
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Folded code of every character below 65,536; others stand for themselves."""
    table = np.full(1 << 16, SPACE, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalnum():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded codes of all texts (each ended by BETWEEN), the place of each in its text, and where each text begins."""
    if not _FOLD:
        _FOLD.append(fold_table())
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("\x01".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(codes < 1 << 16, _FOLD[0][np.minimum(codes, 0xFFFF)], codes)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    out[begins + sizes] = BETWEEN
    space = out == SPACE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    kept = np.flatnonzero(keep)
    starts = np.searchsorted(kept, begins)
    place = kept - np.repeat(begins, np.diff(np.r_[starts, len(kept)]))
    return out[kept], place, starts


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    out, span, factor, total, width = codes.astype(np.uint64), 1, MULTIPLIER, None, 0
    bits = Q
    while bits:
        if bits & 1:
            if total is None:
                total, width = out, span
            else:
                n = len(codes) - width - span + 1
                total = total[:n] * np.uint64(factor) + out[width : width + n]
                width += span
        bits >>= 1
        if bits:
            n = max(len(codes) - 2 * span + 1, 0)
            out = out[:n] * np.uint64(factor) + out[span : span + n]
            span, factor = 2 * span, factor * factor % (1 << 64)
    return total * np.uint64(0xD6E8FEB86659FD93)


class Benchmark:
    """Q-gram index of some items, in arrays."""

    def __init__(self, ids: list[str], texts: list[str]):
        codes, _, starts = folded(texts)
        parts = [p[p != BETWEEN] for p in np.split(codes, starts[1:])] if len(texts) else []
        parts = [p[int(len(p) > 0 and p[0] == SPACE) : len(p) - int(len(p) > 1 and p[-1] == SPACE)] for p in parts]
        known = [(i, p) for i, p in zip(ids, parts, strict=True) if len(p) >= Q]
        self.ids, self.codes = [i for i, _ in known], [p.tolist() for _, p in known]
        sizes = np.array([len(p) for _, p in known], np.int64)
        # As many edits as the rate allows and the lemma can bound: one shared q-gram must be left.
        self.edits = np.minimum((EDITS * sizes).astype(np.int64), (sizes - Q) // Q)
        self.least = sizes - Q + 1 - Q * self.edits
        self.longest = int(sizes.max(initial=0))
        found = [grams(p) for _, p in known]
        value = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(known)), [len(g) for g in found])
        position = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.value, first, self.count = np.unique(value[order], return_index=True, return_counts=True)
        self.first, self.item, self.position = first, item[order], position[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.value >> np.uint64(42)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams that some item has, and their numbers in the index."""
        if len(codes) < Q or not len(self.value):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashed = grams(codes)
        maybe = np.flatnonzero(self.seen[(hashed >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.value, hashed[maybe]), len(self.value) - 1)
        right = self.value[at] == hashed[maybe]
        return maybe[right], at[right]

    def regions(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item, start, end, distance) of confirmed regions, in places of ``codes`` inside each text."""
        place, gram = self.shared(codes)
        # A region of the shortest bound needs that many shared q-grams within reach of the longest item.
        reach = self.longest + int(self.edits.max(initial=0))
        near = np.searchsorted(place, place + reach, "right") - np.searchsorted(place, place - reach)
        wanted = near >= self.least.min(initial=1)
        place, gram = place[wanted], gram[wanted]
        if not len(place):
            return
        each = ragged(self.first[gram], self.count[gram])
        item, position = self.item[each], self.position[each]
        text = np.searchsorted(starts, place, "right") - 1
        diagonal = np.repeat(place - starts[text], self.count[gram]) - position + self.longest
        text = np.repeat(text, self.count[gram])
        width = self.edits[item] + 1
        key = (text * len(self.ids) + item) << 32 | diagonal // width
        band, counts = np.unique(key, return_counts=True)
        follows = np.r_[band[1:] == band[:-1] + 1, False]
        both = counts + np.where(follows, np.r_[counts[1:], 0], 0)
        owner = band >> 32
        which = owner % len(self.ids)
        chosen = np.flatnonzero(both >= self.least[which])
        ends = np.r_[starts[1:], len(codes)]
        done: dict[tuple[int, int], int] = {}
        for k in chosen.tolist():
            t, i = int(owner[k]) // len(self.ids), int(which[k])
            e, m = int(self.edits[i]), len(self.codes[i])
            low = (int(band[k]) & 0xFFFFFFFF) * (e + 1) - self.longest
            begin, stop = max(low - e, 0), min(low + 2 * (e + 1) + m + e, int(ends[t] - starts[t]))
            if begin < done.get((t, i), -1):  # inside the region found in the band before
                begin = done[t, i]
            if stop - begin < m - e:
                continue
            region = codes[starts[t] + begin : starts[t] + stop].tolist()
            distance, end = best_match(self.codes[i], region)
            if distance <= e:
                _, back = best_match(self.codes[i][::-1], region[:end][::-1])
                done[t, i] = begin + end
                yield t, i, begin + end - back, begin + end, distance


def pieces_of(texts: list[str], overlap: int) -> tuple[list[int], list[int], list[str]]:
    """Text numbers, offsets and pieces; long texts in pieces that overlap by ``overlap`` characters."""
    rows, offsets, parts = [], [], []
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - overlap, 1), PIECE):
            rows.append(i)
            offsets.append(start)
            parts.append(text[start : start + PIECE + overlap])
    return rows, offsets, parts


def find_in(texts: list[str], benchmark: Benchmark) -> list[list[dict]]:
    """Regions of each text: item, start and end (code points, end exclusive), distance in folded characters."""
    found: list[dict] = [{} for _ in texts]
    rows, offsets, parts = pieces_of(texts, 8 * max(benchmark.longest, 64))
    for start, end in blocks(parts, PIECE):
        codes, place, starts = folded(parts[start:end])
        for t, i, a, b, distance in benchmark.regions(codes, starts):
            own = place[starts[t] + a : starts[t] + b]
            key = (i, int(own[0]) + offsets[start + t], int(own[-1]) + 1 + offsets[start + t])
            found[rows[start + t]].setdefault(key, {"item": benchmark.ids[i], "start": key[1], "end": key[2], "distance": distance})
    return [sorted(f.values(), key=lambda x: (x["start"], x["item"])) for f in found]


def leaks(text: Column, benchmark) -> Column:
    """Array of regions of a text column that copy an item of a broadcast benchmark."""

    @F.pandas_udf("array<struct<item:string,start:int,end:int,distance:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(find_in(filled(texts), benchmark.value), dtype=object)

    return run(text)


def benchmark_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """Indexes of at most about BLOCK characters each; an empty benchmark gives none."""
    items = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK)
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).orderBy("id", "text").collect()
        yield Benchmark([r["id"] for r in rows], [r["text"] for r in rows])


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with ``into``: array of (item, start, end, distance); all other columns stay."""
    context = docs.sparkSession.sparkContext
    kind = "array<struct<item:string,start:int,end:int,distance:int>>"
    found = [leaks(F.col(text), context.broadcast(b)) for b in benchmark_blocks(items)]
    return docs.withColumn(into, F.concat(*found) if found else F.array().cast(kind))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` that hold no benchmark item."""
    return with_leaks(docs, items, text, into="_leaks").where(F.size("_leaks") == 0).drop("_leaks")
