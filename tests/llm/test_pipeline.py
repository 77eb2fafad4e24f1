"""The pipeline against a plain version of its stages on a small corpus."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from starloom.llm import bpe
from starloom.llm.common import words

OWN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(k, make(rng, 40)) for k in range(5)]
    rows, toxic = [], {}
    for k in range(400):
        text = make(rng, 60)
        toxic[k] = int(k % 5 == 0)
        if toxic[k]:
            text += f" vermin{k % 3} {make(rng, 20)}"
        elif k % 9 == 1:
            text += f"\n{items[k % 5][1]}\n{make(rng, 10)}"
        elif k % 9 == 2:
            text += f" write to user{k}@host.example or +1 (212) 555-0{100 + k}"
        elif k % 9 == 3:
            text = f"{rows[-3][1]} indeed" if k % 2 and not toxic[k - 3] else text
        rows.append((k, text))
    spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, toxic[k]) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, toxic, items


def test_stages_take_effect_in_order(spark, folder, vocabulary):
    path, rows, toxic, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]
    kept = [(k, t) for k, t in rows if not toxic[k]]
    seen, single = {}, []
    for k, t in kept:
        core = tuple(words(t.removesuffix(" indeed")))
        if core not in seen:
            seen[core] = k
            single.append((k, t))
    assert len(single) < len(kept)
    clean = [(k, t) for k, t in single if not any(item in t for _, item in items)]
    mask = lambda t: re.sub(r"\+1 \(212\) 555-\d+", "<PHONE>", re.sub(r"user\d+@host\.example", "<EMAIL>", t))
    want = {k: mask(t) for k, t in clean}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want)
    judge = Tokenizer.from_file(vocabulary)
    for r in got:
        assert bpe.unpack_ids(r["ids"]).tolist() == judge.encode(r["text"], add_special_tokens=False).ids
        assert r["decoded"] == r["text"] and r["n_chars"] == len(r["text"])


def test_every_stage_but_the_last_keeps_the_columns_and_takes_odd_rows(spark, folder, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            result = stage(spark, docs, folder[0])
            assert result.columns == docs.columns, name
            result.count()
    assert stage_count(spark, odd, folder[0]) == odd.count() - 3


def stage_count(spark, docs, path):
    """Odd rows left by all stages: copies 7, 8 and 9 go, all else stays."""
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    return docs.select("doc_id", "n_tokens", "decoded").count()
