"""BPE and token counts against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import bpe, token_counts


@pytest.fixture(scope="module")
def judge(vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda texts: tokenizer.encode_batch(texts, add_special_tokens=False)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(bpe.read_vocabulary(vocabulary))


def ids_of(encoder, texts):
    out = [[] for _ in texts]
    for i, unit in encoder.encode(texts):
        out[i] += unit.tolist()
    return out


def test_encodes_every_character_as_the_library_does(encoder, judge):
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 37 == 0)]
    assert ids_of(encoder, texts) == [x.ids for x in judge(texts)]


def test_encodes_white_space_special_tokens_and_long_texts(encoder, judge, make, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 100)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "\t ", " \n", "I'll", "we're", "<|endoftext|>", "aaaa", "12 345", "é", "😀", "..", "don 't", "\u0085", " "]
    texts = ["".join(rng.choice([*parts, make(rng, 2)]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [" ", "", make(rng, 3000), "ab" * 3000, "<|endoftext|>" * 3]
    got = ids_of(encoder, texts)
    assert got == [x.ids for x in judge(texts)]
    assert [encoder.decode(np.array(ids, np.int64)) for ids in got] == texts


def test_forgetting_words_changes_nothing(vocabulary, judge, make, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", {"words": 5, "chunks": 5})
    encoder, rng = bpe.Encoder(bpe.read_vocabulary(vocabulary)), random.Random(3)
    texts = [make(rng, 40) for _ in range(30)]
    for text in texts:
        assert ids_of(encoder, [text]) == [judge([text])[0].ids]


def test_frames_keep_columns_and_odd_rows(odd, odd_rows, empty, judge, vocabulary):
    coded = bpe.encode_texts(odd, vocabulary)
    assert coded.columns == [*odd.columns, "bpe"]
    rows = coded.select("doc_id", "text", "bpe.*").collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        want = judge([row["text"] or ""])[0].ids
        assert bpe.unpack_ids(row["ids"]).tolist() == want and row["n_tokens"] == len(want) and row["decoded"] == (row["text"] or "")
    assert bpe.encode_texts(empty, vocabulary).count() == 0


def brute(encoding, sections, rule):
    counts, crossing, unassigned = [0] * len(sections), [0] * len(sections), 0
    for first, end in encoding.offsets:
        shares = [max(0, min(end, b) - max(first, a)) for a, b in sections]
        if rule == "first":
            at = next((k for k, (a, b) in enumerate(sections) if a <= first < b), None)
        elif rule == "last":
            at = next((k for k, (a, b) in enumerate(sections) if a <= end - 1 < b), None)
        else:
            at = shares.index(max(shares)) if shares and max(shares) else None
        if at is None:
            unassigned += 1
        else:
            counts[at] += 1
            crossing[at] += shares[at] < end - first
    return counts, crossing, unassigned


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_agrees_with_offsets(encoder, vocabulary, make, rule):
    plain = Tokenizer.from_str(open(vocabulary, encoding="utf-8").read().replace('"trim_offsets":true', '"trim_offsets":false').replace('"trim_offsets": true', '"trim_offsets": false'))
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice([make(rng, 3), "\n", "\n\n", " \n ", "é日😀", ". "]) for _ in range(rng.randint(0, 12)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.choice([0, 2, 4, 6]))))
        sections = list(zip(cuts[::2], cuts[1::2], strict=False))
        sections = [s for s in sections if s[0] < s[1]]
        _, unassigned, _, _, n, crossing = next(token_counts.count(encoder, [text], [[{"start": a, "end": b} for a, b in sections]], rule))
        want = brute(plain.encode(text, add_special_tokens=False), sections, rule)
        assert (n.tolist(), crossing.tolist(), unassigned) == want


def test_line_counts_add_up_on_odd_rows(odd, odd_rows, empty, vocabulary):
    counted = token_counts.with_token_counts(odd, vocabulary)
    assert counted.columns == [*odd.columns, "tokens"]
    for row in counted.select("text", "tokens.*").collect():
        assert sum(s["n_tokens"] for s in row["sections"]) == row["n_tokens"] and row["unassigned"] == 0
        lines = (row["text"] or "").split("\n")
        assert [s["end"] - s["start"] for s in row["sections"]] == [len(x) + 1 for x in lines[:-1]] + [len(lines[-1])]
    assert token_counts.with_token_counts(empty, vocabulary).count() == 0


def test_given_sections_and_wrong_rule(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one two three", [(0, 7)]), (2, "x", None), (3, None, [])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = {r["doc_id"]: r["tokens"] for r in token_counts.with_token_counts(docs, vocabulary, sections="parts").collect()}
    assert rows[1]["sections"][0]["n_tokens"] == 2 and rows[1]["unassigned"] == 1
    assert (rows[2]["n_tokens"], rows[2]["unassigned"]) == (1, 1) and rows[3]["n_tokens"] == 0
    with pytest.raises(ValueError):
        token_counts.with_token_counts(docs, vocabulary, rule="half")


def test_a_filter_on_the_sections_counts_no_text_twice(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one two\nthree")], "doc_id long, text string")
    counted = token_counts.with_token_counts(docs, vocabulary)
    lines = counted.select("doc_id", F.explode("tokens.sections").alias("s")).where("s.n_tokens > 0")
    assert lines._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert lines.count() == 2


def test_encoded_in_parts(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 300)
    encoder = bpe.Encoder(bpe.read_vocabulary(vocabulary))
    texts = [None, "", "one two three", "é ü " * 90, None, *[f"word {k} of many" for k in range(200)], "", "x" * 1000, None]
    parts = list(bpe.coded(pa.array(["left out", *texts]).slice(1), encoder))
    assert len(parts) > 8 and max(map(len, parts)) < 30
    rows = [r for part in parts for r in part.to_pylist()]
    assert [r["decoded"] for r in rows] == [t or "" for t in texts]
    assert [r["n_tokens"] for r in rows] == [len(bpe.unpack_ids(r["ids"])) for r in rows]
    assert sum(map(len, bpe.coded(pa.array([], pa.string()), encoder))) == 0
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = bpe.encode_texts(frame, vocabulary).select("doc_id", "bpe.ids").collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == {k: r["ids"] for k, r in enumerate(rows)}
