"""Byte-level BPE: batched numpy merge rounds, and decoding by gathering token bytes.

The symbols of many different words lie in one flat array. In every round each word's lowest-rank pair is
found (a binary search over the sorted pair keys gives ranks) and merged wherever it occurs in that word,
left to right. Only pairs beside a merge are looked up again. Words met before come from a bounded memory.
Nothing is trained: the vocabulary is a public tokenizer file, read on the driver and broadcast (its size is
that of the file, about 1.5 MB).

Defined cases: null and empty texts have no tokens and decode to the empty text; texts of any length are
encoded whole, in segments that end where no token can span; the text of a special token becomes that token.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starloom.llm.common import Memory, blocks, filled, ragged

# Fixed value: the pattern that splits text into words before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT = 1 << 20
PART = 1 << 21
REMEMBERED = {"words": 200_000, "chunks": 400_000}
EVEN = re.compile(r"(?<=\S) (?=\S)")
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Plain data of a byte-level BPE tokenizer file: token bytes by id, merges in rank order, special tokens."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    letters, vocab = byte_letters(), stored["model"]["vocab"]
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    texts = [b""] * size
    for token, i in vocab.items():
        texts[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        texts[i] = token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
    return {"texts": texts, "merges": merges, "bytes": first, "special": special, "key": hashlib.sha256(b"\0".join(texts)).hexdigest()}


def uneven(text: str) -> bool:
    """Whether a space stands at an end of the text or beside other white space."""
    return text[0] == " " or text[-1] == " " or any(w in text and (w + " " in text or " " + w in text) for w in WHITE)


def chunks_of(text: str) -> list[str]:
    """The text cut before each single space between two other characters, where no word can span.

    Chunks after the first are given without that space; the first one gets a mark (a space) instead.
    """
    if not text:
        return []
    cut = EVEN.split(text) if uneven(text) else text.split(" ")
    cut[0] = " " + cut[0]
    return cut


class Encoder:
    """Encodes and decodes with one vocabulary; remembers the ids of words."""

    def __init__(self, vocabulary: dict):
        merges = vocabulary["merges"]
        keys = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merges[order, 2]
        self.first = vocabulary["bytes"]
        self.special = vocabulary["special"]
        lengths = np.array([len(t) for t in vocabulary["texts"]], np.int64)
        self.byte_length, self.byte_start = lengths, np.cumsum(lengths) - lengths
        self.byte_text = np.frombuffer(b"".join(vocabulary["texts"]), np.uint8)
        self.split = regex.compile(SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words, self.chunks = Memory(REMEMBERED["words"]), Memory(REMEMBERED["chunks"])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK if it is no merge) and the merged id."""
        key = left << 32 | right
        if not len(self.keys):
            return np.full(len(key), NO_RANK, np.int32), key
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.merged[at]

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        size = np.array([len(w) for w in raw], np.int64)
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        counts = size.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._pairs(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(word)])
            ended = np.repeat(lowest == NO_RANK, spans)
            if ended.any():
                done.append((word[ended], symbol[ended]))
                going = ~ended
                symbol, word, rank, merged = symbol[going], word[going], rank[going], merged[going]
                keep = lowest != NO_RANK
                lowest, spans = lowest[keep], spans[keep]
                if not len(symbol):
                    break
            best = np.flatnonzero(rank == np.repeat(lowest, spans))
            # Pairs of one repeated symbol overlap: take every second of a run, from the left.
            fresh = np.r_[True, np.diff(best) != 1]
            run = np.flatnonzero(fresh)
            offset = np.arange(len(best)) - np.repeat(run, np.diff(np.r_[run, len(best)]))
            best = best[offset % 2 == 0]
            symbol[best] = merged[best]
            kept = np.ones(len(symbol), bool)
            kept[best + 1] = False
            moved = np.cumsum(kept) - 1
            symbol, word, rank, merged = symbol[kept], word[kept], rank[kept], merged[kept]
            at = moved[best]
            touched = np.r_[at, np.maximum(at - 1, 0)]
            rank[touched], merged[touched] = self._pairs_at(symbol, word, touched)
        if not done:
            return symbol, counts
        word, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(raw))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(symbol, word, np.arange(len(symbol)))

    def _pairs_at(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, merged = self._rank(symbol[at], symbol[after])
        return np.where((word[at] == word[after]) & (after != at), rank, NO_RANK), merged

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of all chunks; a chunk is split into words, and only new words are merged."""
        new = self.chunks.missing(chunks)
        if not new:
            return
        pieces = [self.split.findall(c[1:] if c[0] == " " else " " + c) for c in new]
        counts = np.array([len(p) for p in pieces], np.int64)
        found = [w for p in pieces for w in p]
        fresh = self.words.missing(found)
        self.words.add(fresh, *self.encode_words([w.encode() for w in fresh]))
        ids, lengths = self.words.gather(found)
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]]
        self.chunks.add(new, ids, np.diff(ends))

    def _units(self, texts: list[str]) -> Iterator[tuple[int, str, int]]:
        """(text number, segment, special id or -1) in order; every text has at least one unit."""
        for i, text in enumerate(texts):
            parts = self.marks.split(text) if self.marks and any(m in text for m in self.special) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    yield i, part, self.special[part]
                    continue
                start = 0
                while len(part) - start > SEGMENT and (cut := EVEN.search(part, start + SEGMENT)):
                    yield i, part[start : cut.start()], -1
                    start = cut.start()
                yield i, part[start:], -1

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids of its next unit) in order, whole texts."""
        units = list(self._units(texts))
        for start, end in blocks([u[1] for u in units]):
            found, counts = [], []
            for _, part, special in units[start:end]:
                pieces = chunks_of(part) if special < 0 else []
                found += pieces
                counts.append(len(pieces))
            self._learn(found)
            tokens, length = self.chunks.gather(found)
            tokens = tokens.astype(np.uint32)
            ends = np.r_[0, np.cumsum(length)][np.cumsum(counts)]
            begin = 0
            for (i, _, special), stop in zip(units[start:end], ends, strict=True):
                yield i, tokens[begin:stop] if special < 0 else np.array([special], np.uint32)
                begin = stop

    def token_bytes(self, ids: np.ndarray) -> bytes:
        return self.byte_text[ragged(self.byte_start[ids], self.byte_length[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.token_bytes(ids).decode("utf-8", "replace")


class Shared:
    """A broadcast vocabulary and the worker's encoder for it."""

    def __init__(self, spark: SparkSession, path: str):
        vocabulary = read_vocabulary(path)
        self.key, self.sent = vocabulary["key"], spark.sparkContext.broadcast(vocabulary)

    def encoder(self) -> Encoder:
        found = _ENCODERS.get(self.key)
        if found is None:
            _ENCODERS.clear()
            found = _ENCODERS[self.key] = Encoder(self.sent.value)
        return found


_ENCODERS: dict[str, Encoder] = {}


def coded(column: pa.Array, encoder: Encoder) -> Iterator[pa.Array]:
    """Structs of n_tokens, ids and decoded of a text column, about ``PART`` bytes of text at a time, so a task never holds a batch's whole result."""
    group = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64) // PART
    starts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        texts = filled(column.slice(start, end - start).to_pylist())
        ids: list[list[bytes]] = [[] for _ in texts]
        decoded: list[list[str]] = [[] for _ in texts]
        for i, unit in encoder.encode(texts):
            ids[i].append(unit.astype("<u4").tobytes())
            decoded[i].append(encoder.decode(unit))
        packed = [b"".join(x) for x in ids]
        columns = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(["".join(x) for x in decoded], pa.string())]
        yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids", "decoded"])


def encode_and_decode(text: Column, vocabulary: Shared) -> Column:
    """Struct of n_tokens, ids (unsigned 32-bit integers, little-endian, packed) and the decoded text."""

    @F.arrow_udf("n_tokens long, ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield from coded(column, vocabulary.encoder())

    return run(text)


def encode_texts(docs: DataFrame, path: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """``docs`` with a struct column ``into``: n_tokens, packed ids and the decoded text of ``text``.

    All columns of ``docs`` stay; a column named ``into`` is replaced.
    """
    return docs.withColumn(into, encode_and_decode(F.col(text), Shared(docs.sparkSession, path)))


def unpack_ids(ids: bytes | None) -> np.ndarray:
    """Ids of a packed value as numbers."""
    return np.frombuffer(ids or b"", "<u4")
