"""Token counts by offset-mapped attribution.

A whole document is encoded once; the byte lengths of its tokens give their character spans, and a sorted interval
join (binary search of span ends in section bounds) assigns each token to a section: a line of the text, or any span
that the caller gives. A token that crosses a bound goes by ``rule``: ``most`` (the section with most of its
characters, the earlier one on a tie), ``first`` or ``last`` (the section of its first or last character). The
counts of a document's sections and of its unassigned tokens add up to the tokens of the document.

Defined cases: a null or empty text is one empty line without tokens; texts of any length are encoded whole;
sections must be sorted and must not overlap; tokens outside all sections, and those of documents without sections,
are unassigned; a token that holds part of a character counts as holding it; rows that repeat are counted each; an empty table has
no rows. All columns of the input stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.bpe import Encoder, Shared
from starloom.llm.common import filled

RULES = ("most", "first", "last")
FIELDS = {"start": "int", "end": "int", "n_tokens": "long", "n_crossing": "long"}  # of a section
FLAT = ["total", "unassigned", *FIELDS]
FOUND = "struct<total:long,unassigned:long," + ",".join(f"{name}:array<{kind}>" for name, kind in FIELDS.items()) + ">"


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a text, each with its line break; they cover the text."""
    breaks, at = [], text.find("\n")
    while at >= 0:
        breaks.append(at + 1)
        at = text.find("\n", at + 1)
    starts = np.array([0, *breaks], np.int64)
    return starts, np.r_[starts[1:], len(text)]


def token_spans(encoder: Encoder, ids: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token of a text given as UTF-8 bytes."""
    ends = np.cumsum(encoder.byte_length[ids])
    characters = np.cumsum((raw & 0xC0) != 0x80)
    return characters[ends - encoder.byte_length[ids]] - 1, characters[ends - 1]


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it lies across a bound of that section."""
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    left = np.searchsorted(ends, first, "right")  # the first section that ends after the token's first character
    right = np.searchsorted(starts, end - 1, "right") - 1  # the last section that starts at its last character or before
    if rule == "first":
        at = np.where((left < len(starts)) & (starts[np.minimum(left, len(starts) - 1)] <= first), left, -1)
    elif rule == "last":
        at = np.where((right >= 0) & (ends[np.maximum(right, 0)] >= end), right, -1)
    else:
        at = np.where(left <= right, left, -1)
        for k in np.flatnonzero(right > left):
            s = slice(left[k], right[k] + 1)
            at[k] = left[k] + int(np.argmax(np.minimum(ends[s], end[k]) - np.maximum(starts[s], first[k])))
    chosen = np.maximum(at, 0)
    return at, (at >= 0) & ((starts[chosen] > first) | (ends[chosen] < end))


def count(encoder: Encoder, texts: list[str], sections: list | None, rule: str) -> Iterator[tuple]:
    """For each text its tokens, the unassigned ones, and one array for each of ``FIELDS``."""
    units: list[list[np.ndarray]] = [[] for _ in texts]
    for i, ids in encoder.encode(texts):
        units[i].append(ids)
    for i, text in enumerate(texts):
        ids = np.concatenate(units[i]).astype(np.int64)
        if sections is None:
            starts, ends = line_bounds(text)
        else:
            own = sections[i] if sections[i] is not None else []
            starts, ends = (np.array([s[k] for s in own], np.int64) for k in ("start", "end"))
        n = np.zeros(len(starts), np.int64)
        crossing = n
        at = np.zeros(0, np.int64)
        if len(ids):
            first, end = token_spans(encoder, ids, np.frombuffer(text.encode(), np.uint8))
            at, across = attribute(first, end, starts, ends, rule)
            n = np.bincount(at[at >= 0], minlength=len(starts))
            crossing = np.bincount(at[across], minlength=len(starts))
        yield len(ids), len(ids) - int(n.sum()), starts, ends, n, crossing


def with_token_counts(docs: DataFrame, path: str, text: str = "text", sections: str | None = None, rule: str = "most", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``into``: n_tokens, unassigned and per section its span, n_tokens and n_crossing.

    ``sections`` names an array column of structs with start and end (code points); without it sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = Shared(docs.sparkSession, path)

    def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        encoder = vocabulary.encoder()
        for texts, *given in batches:
            own, out = filled(texts), []
            for start in range(0, len(own), 256):
                part = given[0].iloc[start : start + 256].tolist() if given else None
                out += count(encoder, own[start : start + 256], part, rule)
            yield pd.DataFrame(out, columns=FLAT)

    @F.pandas_udf(FOUND)
    def by_line(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from answer((one,) for one in batches)

    @F.pandas_udf(FOUND)
    def by_section(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from answer(batches)

    # not deterministic for the planner: else a filter on the sections (explode adds one) would count all texts a second time
    counter = (by_line if sections is None else by_section).asNondeterministic()
    made: Column = counter(F.col(text)) if sections is None else counter(F.col(text), F.col(sections))
    flat = f"flat_{uuid.uuid4().hex}"  # a name that no column has
    zipped = F.arrays_zip(*[F.col(f"{flat}.{name}").alias(name) for name in FIELDS])
    each = F.transform(zipped, lambda s: F.struct(*[s[name].alias(name) for name in FIELDS]))
    counted = F.struct(F.col(f"{flat}.total").alias("n_tokens"), F.col(f"{flat}.unassigned").alias("unassigned"), each.alias("sections"))
    columns = [c for c in docs.columns if c != into]
    return docs.withColumn(flat, made).select(*[F.col(f"`{c}`") for c in columns], counted.alias(into))
