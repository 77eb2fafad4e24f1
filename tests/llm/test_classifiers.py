"""Toxicity, language and quality: held-out accuracy on planted classes, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import langid, quality, toxicity
from starloom.llm.common import fold_of, labelled_sample


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold_of(F.col("id"), 5).alias("fold")).collect()
    assert all(r["fold"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_sample_is_bounded_and_skips_the_held_out_fold(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(7, "again")], "doc_id long, text string"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).union(spark.createDataFrame([(7, None), (7, 0), (None, 1)], "doc_id long, toxic int"))
    rows = labelled_sample(docs, labels, "toxic", 40).collect()
    assert len({r["doc_id"] for r in rows}) == 40
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["label"] == 1 for r in rows)


def test_machine_learns_pairs_that_sums_of_weights_cannot(make):
    rng = random.Random(1)
    insults, groups = ["fumble", "gravel"], ["norther", "islander"]
    rows, labels = [], []
    for k in range(2400):
        i, g = k % 3, k // 3 % 3  # 2: none
        text = " ".join([make(rng, 6), *insults[i : i + 1], *groups[g : g + 1]])
        rows.append(np.array(sorted(set().union(*map(toxicity.hashed_terms, set(text.split())))), np.int64))
        labels.append(float(i < 2 and i == g))  # each insult hurts one group only
    model = toxicity.train(rows, np.array(labels), epochs=40)
    told = {(i, g): model.scores([f"{make(rng, 6)} {i} {g}"])[0] > 0.5 for i in [*insults, ""] for g in [*groups, ""]}
    assert {pair for pair, yes in told.items() if yes} == {("fumble", "norther"), ("gravel", "islander")}


def test_toxicity_finds_stems_in_held_out_documents(spark, make):
    rng = random.Random(2)
    rows = [(k, make(rng, 40) + (f" vermin{rng.choice('abcdefgh')}{k % 3} " if k % 6 == 0 else " ") + make(rng, 40), int(k % 6 == 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in held]) > 0.98
    again = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs.repartition(7), labels).collect()}
    assert got == again


def test_language_of_held_out_documents(spark):
    rng = random.Random(3)
    kinds = {"aa": "kalomiru", "bb": "zfgthpq", "cc": "ñéüößäê"}
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(k, text(letters, rng.randint(3, 60)), lang) for k in range(200) for lang, letters in [list(kinds.items())[k % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, text("kalomiru", 9), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["language"] for r in langid.identify_language(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.97
    assert (got[900]["lang_pred"], got[900]["score"], got[900]["rejected"]) == ("und", 0.0, True)
    assert got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rejection_threshold():
    scores, right = np.array([0.9, 0.8, 0.7, 0.6]), np.array([True, True, True, False])
    assert langid.rejection_threshold(scores, right, 0.99) == 0.7
    assert langid.rejection_threshold(scores, np.zeros(4, bool)) == 1.0
    assert langid.rejection_threshold(np.array([0.9, 0.8]), np.ones(2, bool)) == 0.5


def test_trees_separate_and_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x[:2000], y[:2000])
    scores = model.scores(x[2000:])
    assert ((scores > 0.5) == y[2000:].astype(bool)).mean() > 0.95

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
            total += model.value[t, node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(scores[:50], [walk(r) for r in x[2000:2050]])


def test_statistics():
    row = dict(zip(quality.FEATURES, quality.statistics(["Ab cd\nAb 12!"])[0], strict=True))
    assert (row["chars"], row["words"], row["lines"], row["distinct_lines"], row["distinct_words"]) == (12, 4, 2, 1.0, 0.75)
    assert (row["upper"], row["digit"], row["mark"]) == (2 / 12, 2 / 12, 1 / 12)
    assert not quality.statistics([""])[0][:2].any()


def test_quality_of_held_out_documents(spark, make):
    rng = random.Random(5)
    rows = [(k, make(rng, 60) if k % 4 else " ".join(w + "$$$" for w in make(rng, 60).split()), int(k % 4 > 0)) for k in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs, labels).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_odd_rows_and_missing_labels(spark, odd, odd_rows, empty, no_labels):
    few = spark.createDataFrame([(7, 1, 0), (12, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for build, name in ((toxicity.score_toxicity, "score"), (quality.score_quality, "score")):
        for labels in (few, no_labels):
            rows = build(odd, labels, into=name).collect()
            assert len(rows) == len(odd_rows) and all(0 <= r[name] <= 1 and r["key"] == "kept" for r in rows)
            assert len({r[name] for r in rows if r["doc_id"] in (7, 8)}) == 1  # equal texts, equal scores
        assert build(empty, no_labels).count() == 0
    named = langid.identify_language(odd, odd, into="value").collect()
    assert len(named) == len(odd_rows) and {r["value"]["lang_pred"] for r in named} == {"xx", "und"}
    assert langid.identify_language(empty).count() == 0
    assert {r["language"]["lang_pred"] for r in langid.identify_language(odd, empty).collect()} == {"und"}


def test_language_scores_equal_a_plain_sum():
    """Batched, remembered sums against one pass over the subwords of each text."""
    rng = np.random.default_rng(3)
    model = langid.LanguageModel(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.4)
    texts = ["Ärger über alles, 12ab-cd!", "", "...", "один два два", "word " * 50, "x", "𝔞𝔟 mixed", "word"] * 3
    for _ in range(2):
        names, scores, low = model.predict(texts)
        for text, name, score in zip(texts, names, scores, strict=True):
            total, n = np.zeros(3), 0
            for word in langid.LETTERS.findall(text.lower()):
                at, _ = langid.buckets_of([word])
                assert len(at) == 1 + sum(max(len(word) + 3 - g, 0) for g in langid.GRAMS)
                total, n = total + model.logits[at].sum(0, dtype=float), n + len(at)
            if not n:
                assert (name, score) == ("und", 0.0)
                continue
            shares = langid.softmax((total / n + model.bias) / model.temperature)
            assert name == model.names[int(shares.argmax())] and abs(score - shares.max()) < 1e-6
            at, often = langid.bag_of(text)
            assert often.sum() == n
    assert (low == (scores < 0.4)).all()


def test_toxicity_score_equals_the_sum_over_pairs():
    """The factorised pair term against an explicit sum over all pairs of active terms."""
    rng = np.random.default_rng(4)
    texts = ["some plain words", "insult group mention insult", "Other, words!", ""]
    terms = np.unique([t for text in texts[:3] for piece in text.lower().split() for t in toxicity.hashed_terms(piece)])
    model = toxicity.FactorizationMachine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), toxicity.FACTORS)))
    for text, score in zip(texts, model.scores(texts), strict=True):
        active = sorted({int(np.searchsorted(terms, t)) for piece in text.lower().split() for t in toxicity.hashed_terms(piece) if t in terms})
        raw = 0.3 + sum(model.weights[i] for i in active)
        raw += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(active) for j in active[k + 1 :])
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-9
    assert model.active("unknown") == [] and model.raw([]) == 0.3
