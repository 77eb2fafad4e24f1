"""The set-similarity join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.llm import ngram_join


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, min(len(found), 1)))}


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    low = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(k)] = min(low.get(root(k), doc_id), doc_id)
    return sorted(((i, len(s), low.get(root(k)) if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, parts=3):
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=repr)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus(make):
    rng = random.Random(31)
    line, texts = make(rng, 40), []
    for k in range(40):  # pairs around the bar in documents that share a passage
        body = make(rng, rng.randint(60, 200)).split()
        cut = rng.randint(1, 9)
        texts += [f"{line} {' '.join(body)}", f"{line} {' '.join(body[: -cut * len(body) // 60] + make(rng, rng.randint(0, 12)).split())}"]
    base = make(rng, 300).split()
    texts += [" ".join(edited(rng, base, rng.randint(1, 9))) for _ in range(60)]  # a group whose members differ in similarity
    star = make(rng, 400).split()
    texts += [" ".join(edited(rng, star, 8)) for _ in range(40)] + [" ".join(star)]
    chain = make(rng, 200).split()
    texts += [" ".join(chain[k * 9 : k * 9 + 110]) for k in range(10)]
    texts += [make(rng, n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + ["One two three", "one TWO three", "one two three four five six", "One  two\tthree four\nfive six"]
    texts += [f"{make(rng, 3)} {line}" for _ in range(20)]
    rng.shuffle(texts)
    return [(k * 2, t) for k, t in enumerate(texts)]


def test_components_equal_those_of_all_pairs(spark, corpus):
    want = plain(corpus)
    assert len({c for *_, c in want}) < len(want) - 100
    assert joined(spark, corpus) == want


def test_split_tiles_give_the_same_links(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 8)
    monkeypatch.setattr(ngram_join, "BUCKETS", 1 << 18)
    assert joined(spark, corpus, 5) == plain(corpus)


def test_components_of_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, ngram_join.similar_components(odd).collect()), key=repr)
    assert got == plain(odd_rows)
    assert ngram_join.similar_components(empty).count() == 0


def test_one_id_with_several_texts(spark, make):
    rng = random.Random(33)
    a, b = make(rng, 50), make(rng, 60)
    assert joined(spark, [(1, a), (1, b), (2, b), (3, a)]) == [(1, 46, 1), (1, 56, 1), (2, 56, 1), (3, 46, 1)]


def test_word_hashes_in_pieces(monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 16)
    rng, powers = random.Random(34), ngram_join.Powers()
    for _ in range(300):
        texts = ["".join(rng.choice("abAB \t\né") for _ in range(rng.choice([0, 1, 5, 30, 80]))) for _ in range(6)] + ["x" * 40]
        array = pa.array(texts, pa.string())
        offsets = np.frombuffer(array.buffers()[1], np.int32).astype(np.int64)[: len(texts) + 1]
        hashes, counts = ngram_join.word_hashes(np.frombuffer(array.buffers()[2], np.uint8), offsets, powers)
        found = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
        assert np.diff(counts).tolist() == [len(f) for f in found]
        flat = [w for f in found for w in f]
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))


def test_kept_grams_and_bitmap_bound():
    for n in range(1, 400):
        kept = int(ngram_join.kept_of(n))
        assert n - kept + 1 == -(-n * 4 // 5) and 1 <= kept <= n


def test_linked_sets_share_enough_kept_grams(spark):
    """For random sets in a random order, and all at the bar."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(35), []
    for _ in range(3000):
        n, order = rng.randint(1, 60), list(range(200))
        rng.shuffle(order)
        rank = {g: k for k, g in enumerate(order)}
        a = set(rng.sample(range(200), n))
        b = set(a)
        for g in rng.sample(sorted(a), rng.randint(0, n // 5)):
            b.discard(g)
            if rng.random() < 0.5:
                b.add(rng.randrange(200))
        if not b or 5 * len(a & b) < 4 * len(a | b):
            continue
        kept = [set(sorted(x, key=rank.get)[: int(ngram_join.kept_of(len(x)))]) for x in (a, b)]
        rows.append((len(a), len(b), len(kept[0] & kept[1])))
    assert len(rows) > 1000
    found = spark.createDataFrame(rows, "n int, m int, shared int")
    assert found.where(~ngram_join.enough_kept(F.col("n"), F.col("m"), F.col("shared"))).count() == 0


def test_bitmaps_of_large_sets(spark):
    rng, pairs = np.random.default_rng(36), []
    for n in (300, 511, 900, 1000, 1024, 3000, 4000, 8000):
        x = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        pairs += [(True, x[:n], x[: n + n // 4]), (True, x[n // 9 : n], x[: n]), (False, x[:n], x[n:])]
    rows = [(k, len(x), ngram_join.bitmap(x).tolist(), len(y), ngram_join.bitmap(y).tolist()) for k, (_, x, y) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "k int, n int, a array<long>, m int, b array<long>")
    may = frame.select("k", ngram_join.may_link(F.col("n"), F.col("m"), F.col("a"), F.col("b")).alias("may")).orderBy("k")
    assert [r["may"] for r in may.collect()] == [linked for linked, *_ in pairs]
    assert any(len(r[2]) != len(r[4]) for r in rows)


def test_a_pair_of_the_last_step_is_formed_in_one_tile(spark, make):
    rng = random.Random(37)
    base = make(rng, 150).split()
    rows = [(k, " ".join(edited(rng, base, rng.randint(1, 3)))) for k in range(40)]  # similarities around the bar, many kept grams in common
    frame = spark.createDataFrame(rows, "id long, text string")
    each = ngram_join.described(frame, ngram_join.bucket_counts(frame)).withColumn("node", F.col("id")).cache()
    members = ngram_join.tiles(each).select("tile", "node", "over").distinct().withColumn("label", F.col("node"))
    formed = sorted(map(tuple, ngram_join.unresolved(ngram_join.met(members, each)).collect()))
    assert len(formed) == len(set(formed)) > 50
    sets = [plain_set(t) for _, t in rows]
    linked = {(a, b) for b in range(40) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert linked and linked <= set(formed)
    kept = ngram_join.sharing(spark.createDataFrame(formed, "leader long, node long"), each)
    assert linked <= set(map(tuple, kept.collect()))


def test_first_shared_grams_lie_where_they_are_looked_for(spark):
    """For random linked sets in a random order, most of them at the bar."""
    rng, rows = random.Random(38), []
    while len(rows) < 1500:
        n = rng.randint(1, 80)
        a = rng.sample(range(10**6), n)
        b = a[rng.randint(0, n // 5) :] + rng.sample(range(10**6, 2 * 10**6), rng.randint(0, n // 4))
        same = len(set(a) & set(b))
        if same * 5 >= (len(a) + len(b) - same) * 4:
            order = {g: rng.random() + (g in a and g in b) * rng.choice([0, 1]) for g in {*a, *b}}
            a, b = (sorted(x, key=order.get) for x in (a, b))
            rows.append((len(a), next(k for k, g in enumerate(a) if g in b), len(b), next(k for k, g in enumerate(b) if g in a)))
    found = spark.createDataFrame(rows, "n int, at int, m int, b_at int")
    most = ngram_join.most_after(F.col("n"), F.col("at")), ngram_join.most_after(F.col("m"), F.col("b_at"))
    assert found.where((most[0] < F.col("m")) | (most[1] < F.col("n"))).count() == 0


def test_tiles_of_grams_that_come_too_late_are_left_out(spark, make):
    """Texts that share five sixths of their grams can't link by one that comes after the first ninth of both."""
    rng = random.Random(39)
    base = make(rng, 100).split()
    texts = [list(base) for _ in range(30)]
    for text in texts:
        for at in (20, 50, 80):
            text[at] = f"new{rng.randrange(10**6)}"
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    each = ngram_join.described(frame, ngram_join.bucket_counts(frame)).withColumn("node", F.col("id")).cache()
    assert each.where(F.size("grams") > 15).count() == 30  # some kept grams are those of the base
    assert ngram_join.tiles(each).count() == 0


def test_both_sides_of_the_last_join_are_one_shuffle(spark, make):
    rng = random.Random(40)
    frame = spark.createDataFrame([(k, make(rng, 30)) for k in range(4)], "id long, text string")
    each = ngram_join.described(frame, ngram_join.bucket_counts(frame)).withColumn("node", F.col("id"))
    members = ngram_join.tiles(each).withColumn("label", F.col("node")).drop("leader")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        formed = ngram_join.unresolved(members.join(each.select("node", "n", "bits", F.col("grams").alias("earlier")), "node"))
        assert "ReusedExchange" in formed._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
