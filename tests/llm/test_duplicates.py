"""Near-duplicates, fingerprints, decontamination and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from starloom.llm import components, decontaminate, fingerprints, near_dedup, passages
from starloom.llm.align import best_match, edit_distance, similarity
from starloom.llm.common import WordHashes, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def edited(rng, found, n):
    out = list(found)
    for _ in range(n):
        k, kind = rng.randrange(max(len(out), 1)), rng.random() if out else 0.6
        if kind < 0.5:
            out[k] = f"new{rng.randrange(1000)}"
        elif kind < 0.75:
            out.insert(k, f"new{rng.randrange(1000)}")
        else:
            del out[k]
    return out


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(5000):
        a = [rng.randrange(3) for _ in range(rng.randrange(14))]
        b = edited(rng, a or [0], rng.randrange(5)) if rng.random() < 0.5 else [rng.randrange(3) for _ in range(rng.randrange(14))]
        limit = rng.randrange(16)
        assert edit_distance(a, b, limit) == min(distance(a, b), limit + 1)
    assert similarity([], [], 0.8) == 1.0 and similarity([1], [], 0.8) == 0.0


def test_best_match():
    rng = random.Random(2)
    for _ in range(1500):
        p, t = ([rng.randrange(3) for _ in range(rng.randrange(1, n))] for n in (10, 18))
        rows = [distance(p, t[i:j]) for j in range(len(t) + 1) for i in range(j + 1)]
        got, end = best_match(p, t)
        assert got == min(rows) and min(distance(p, t[i:end]) for i in range(end + 1)) == got


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        top[high] = low
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for link in links if link[0] != link[1] for x in link}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_extended_by_later_links(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(k, k + 1) for k in range(100, 106)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(30)]
    later = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(10)] + [(106, 99), (99, 5), (2000, 2001), (3000, 3000)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components.components(frame(pairs)).cache()
    want = {r["node"]: r["label"] for r in components.components(frame(pairs + later)).collect()}
    got = components.extended(labels, frame(later)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got if r["node"] != 3000} == want  # a link of a node with itself gives it a label of its own
    monkeypatch.setattr(components, "components", None)  # no later link: nothing is gone through again
    assert components.extended(labels, frame([])) is labels


@pytest.fixture(scope="module")
def corpus(make):
    """Groups of edited copies (one large), a shared opening line, and texts of their own."""
    rng = random.Random(4)
    texts, line = [], make(rng, 14)
    for size, length in ((120, 60), (6, 200), (5, 40), (3, 400)):
        base = make(rng, length).split()
        texts += [" ".join(edited(rng, base, rng.randrange(length // 20))) for _ in range(size)]
    texts += [f"{line} {make(rng, rng.randint(20, 90))}" for _ in range(60)] + [make(rng, rng.randint(3, 120)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_classes_equal_components_of_all_similar_pairs(spark, corpus):
    found = {i: words(t) for i, t in corpus}
    label = {i: i for i in found}
    for i in found:
        for j in range(i + 1, len(found)):
            if similarity(found[i], found[j], 0.8):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == label
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == sorted(set(label.values()))


def test_centre_of_a_star_joins_its_variants(spark, make):
    """Variants are near their base only, and the base is no leader: it has the largest id."""
    rng = random.Random(11)
    base, rows = make(rng, 150).split(), []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(150), 18):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    rows.append((1000, " ".join(base)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 61 and {r["class_id"] for r in got} == {0}


def test_split_buckets_of_a_common_line(spark, make, monkeypatch):
    """Pairs inside buckets that half the texts share, dealt in parts, all of it unlike its leaders."""
    monkeypatch.setattr(near_dedup, "PART", 4)
    rng = random.Random(12)
    line, rows = make(rng, 40), []
    for k in range(40):
        body = make(rng, 60).split()
        rows += [(2 * k, f"{line} {' '.join(body)}"), (2 * k + 1, f"{line} {' '.join(edited(rng, body, 6))}")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_texts_of_one_id_are_kept(spark, make):
    rng = random.Random(14)
    a, b, c = make(rng, 40), make(rng, 50), make(rng, 60)
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (3, a), (1, b)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.keep_one(docs).collect())) == sorted([(1, a), (1, b), (2, c)])


def test_clashing_names_stay(spark, make):
    rng = random.Random(15)
    text = make(rng, 30)
    names = ["_gone", "_twice", "mark", "id", "first", "tile", "node", "leader", "values", "bits"]
    rows = [(k, text if k < 2 else make(rng, 20), *["kept"] * len(names)) for k in range(4)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_bitmaps_reject_no_link(make):
    rng = random.Random(16)
    hashes = WordHashes()
    for _ in range(400):
        a = make(rng, rng.randint(3, 90)).split()
        b = edited(rng, a, rng.randint(0, len(a) // 4))
        if similarity(a, b, 0.8):
            p, q = (near_dedup.bitmap(hashes(x)) for x in (a, b))
            differ = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) + (1 << 64)).bit_count() for x, y in zip(p, q, strict=True))
            assert differ <= 2 * int(max(len(a), len(b)) * 0.2 + 1e-9)


def bounds(spark, pairs):
    """(may_link, wide_may_link) of pairs of word lists."""
    hashes, rows = WordHashes(), []
    for a, b in pairs:
        sides = [[len(h), near_dedup.bitmap(h).tolist(), near_dedup.wide_bitmap(h).tolist()] for h in (hashes(a), hashes(b))]
        rows.append((len(rows), *sides[0], *sides[1]))
    frame = spark.createDataFrame(rows, "k int, n int, a array<long>, wa array<long>, m int, b array<long>, wb array<long>")
    a, b = ([F.col(c)[i] for i in range(near_dedup.BITS // 64)] for c in "ab")
    loose = near_dedup.may_link(F.col("n"), F.col("m"), a, b)
    wide = near_dedup.wide_may_link(F.col("n"), F.col("m"), F.col("wa"), F.col("wb"))
    return [(r["loose"], r["wide"]) for r in frame.select("k", loose.alias("loose"), wide.alias("wide")).orderBy("k").collect()]


def test_wide_bitmaps_reject_no_link(spark, make):
    rng, pairs = random.Random(17), []
    for n in [rng.randint(3, 90) for _ in range(150)] + [255, 256, 257, 270, 500, 513, 1000, 1100]:
        a = make(rng, n).split()
        pairs += [(a, edited(rng, a, rng.randint(0, n // 4))), (a, a[: int(n * 0.8) + 1]), (a[: int(n * 0.8) + 1], a)]
    linked = [bool(similarity(a, b, 0.8)) for a, b in pairs]
    assert sum(linked) > 200 and sum(len(near_dedup.wide_bitmap(WordHashes()(a))) != len(near_dedup.wide_bitmap(WordHashes()(b))) for a, b in pairs) > 5
    assert all(loose and wide for (loose, wide), same in zip(bounds(spark, pairs), linked, strict=True) if same)


def test_wide_bitmaps_tell_long_texts_with_a_common_passage(spark):
    common = [f"c{k}" for k in range(600)]
    texts = [common + [f"t{t}w{k}" for k in range(200)] for t in range(5)]
    found = bounds(spark, [(a, b) for a in texts for b in texts if a is not b])
    assert all(loose for loose, _ in found) and not any(wide for _, wide in found)


def test_a_filter_on_the_similarity_aligns_once(spark):
    pairs = spark.createDataFrame([("one two three", "one two three"), ("one", "two")], "a string, b string")
    found = pairs.select("a", near_dedup.aligned(F.col("a"), F.col("b"), 0.8).alias("similarity")).where("similarity >= 0.8")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [("one two three", 1.0)]


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == len(odd_rows)
    assert {r["class_id"] for r in rows if r["doc_id"] in (7, 8, 9)} == {7}
    assert all(r["class_id"] == r["doc_id"] for r in rows if r["doc_id"] not in (7, 8, 9))
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 10, 11, 12] and ids.count(None) == 2
    assert near_dedup.near_classes(empty).count() == near_dedup.keep_one(empty).count() == 0


def test_order_matters_to_sketches():
    hashes = WordHashes()
    kmers = hashes([f"w{k}" for k in range(200)])
    assert (near_dedup.order_sketches(kmers) == near_dedup.order_sketches(kmers)).all()
    assert (near_dedup.order_sketches(kmers) == near_dedup.order_sketches(kmers[::-1])).mean() < 0.2
    assert len(np.unique(near_dedup.labelled(np.repeat(kmers[:3], 4)))) == 12


def test_sketches_find_pairs_at_the_bar():
    rng = np.random.default_rng(13)
    for n in (10, 20, 40, 100, 300):
        for edits in (n * 3 // 20, n // 5):
            hits = 0
            for _ in range(200):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                b = a.copy()
                b[rng.choice(n, edits, replace=False)] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
                p, q = near_dedup.sketches(a), near_dedup.sketches(b)
                hits += bool((p == q).any())
            assert hits >= 0.97 * 200, (n, edits, hits)


def test_fingerprints_of_edited_texts(spark, odd_rows, corpus):
    rows = [(i, t) for i, t in [*odd_rows, *((100 + i, t) for i, t in corpus[:80])] if i is not None]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(rows)
    order, text, hashes = sorted(dict(rows), reverse=True), dict(rows), WordHashes()
    for k, i in enumerate(order):
        own, follows = text[i] or "", text[order[(k + 1) % len(order)]] or ""
        cut = len(own) // 3
        change = own[: len(own) - cut] + follows[:cut]
        marks = [fingerprints.signature(t, hashes) for t in (own, change, follows)]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(change.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.written(marks[0]) and got[i]["edited_fingerprint"] == fingerprints.written(marks[1])
        assert got[i]["near_edited"] == fingerprints.likeness_of(marks[0], marks[1]) and got[i]["near_next"] == fingerprints.likeness_of(marks[0], marks[2])


def plain_minhash(text):
    """Signature by Python's integers, one shingle and one function at a time."""
    whole = (1 << 64) - 1

    def spread(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & whole
        return x ^ (x >> 32)

    found = re.findall(r"\w+", text.lower()) or (["".join(text.split())] if text.strip() else [])
    hashed = [xxhash.xxh3_64_intdigest(w.encode()) for w in found]
    take, grams = min(5, len(hashed)), set()
    for k in range(len(hashed) - take + 1 if hashed else 0):
        value = hashed[k]
        for h in hashed[k + 1 : k + take]:
            value = (value * 0x9E3779B97F4A7C15 + h) & whole
        grams.add(spread((value + take) & whole))
    functions = zip(fingerprints.FACTORS.tolist(), fingerprints.OFFSETS.tolist(), strict=True)
    return "".join(f"{spread(min((g * f + o) & whole for g in grams)) >> 48:04x}" for f, o in functions) if grams else ""


def test_fingerprints_equal_plain_minhash(odd_rows, corpus):
    hashes = WordHashes()
    texts = [t or "" for _, t in odd_rows if len(t or "") < 2000] + [t for _, t in corpus[:25]]
    for text, mark in zip(texts, fingerprints.signatures(texts, hashes), strict=True):
        assert fingerprints.written(mark) == plain_minhash(text)


def test_one_document_follows_itself(spark, empty):
    row = fingerprints.with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0
    assert fingerprints.with_edits(empty).count() == 0


def test_repeated_and_null_ids_give_a_row_each(odd, odd_rows):
    assert fingerprints.with_edits(odd).count() == len(odd_rows)


def test_likeness_estimates_jaccard(make):
    rng, hashes = random.Random(6), WordHashes()
    gaps = []
    for _ in range(60):
        a = make(rng, 300).split()
        b = edited(rng, a, rng.randrange(30))
        p, q = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        gaps.append(fingerprints.likeness_of(fingerprints.signature(" ".join(a), hashes), fingerprints.signature(" ".join(b), hashes)) - len(p & q) / len(p | q))
    assert abs(np.mean(gaps)) < 0.03 and np.abs(gaps).max() < 0.25


def test_similar_documents(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in corpus}
    rows = fingerprints.similar_documents(docs).collect()
    assert rows and all(abs(r["similarity"] - len(sets[r["leader"]] & sets[r["doc_id"]]) / len(sets[r["leader"]] | sets[r["doc_id"]])) < 1e-9 for r in rows)
    linked = {r["doc_id"] for r in rows} | {r["leader"] for r in rows}
    alike = {i for i in sets for j in sets if i != j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    assert len(alike - linked) <= 0.02 * len(alike)


def test_decontamination_equals_search_of_every_item(spark, make):
    rng = random.Random(7)
    items = [(k, make(rng, rng.randint(12, 50)).capitalize() + ".") for k in range(30)] + [(90, None), (91, ""), (92, "tiny")]
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower())
    rows = []
    for k in range(150):
        text, item = make(rng, rng.randint(0, 120)), items[rng.randrange(30)][1]
        if k % 3 == 0:
            text += "\n" + (item.upper() if k % 2 else item) + "\n" + make(rng, 20)
        elif k % 3 == 1:
            letters = list(item)
            for _ in range(rng.randint(1, max(1, len(item) // 8))):
                letters[rng.randrange(len(letters))] = rng.choice("xyz")
            text += " " + "".join(letters) + " " + make(rng, 9)
        rows.append((k, text))
    found = {(r["doc_id"], int(x["item"])): x for r in decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for x in r["leaks"]}
    want = {}
    for i, text in rows:
        for k, item in items[:30]:
            folded = plain(item).strip()
            d, _ = best_match(folded, plain(text))
            if d <= min(int(decontaminate.EDITS * len(folded)), (len(folded) - decontaminate.Q) // decontaminate.Q):
                want[i, k] = d
    assert {key: x["distance"] for key, x in found.items()} == want
    for (i, k), x in found.items():
        if x["distance"] == 0:
            assert plain(dict(rows)[i][x["start"] : x["end"]]).strip() == plain(dict(items)[k]).strip()


def test_decontamination_of_odd_rows_long_texts_and_blocks(spark, odd, odd_rows, empty, make, monkeypatch):
    rng = random.Random(8)
    item = make(rng, 30)
    no_items = spark.createDataFrame([], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    monkeypatch.setattr(decontaminate, "PIECE", 5_000)
    items = spark.createDataFrame([(1, item), (2, make(rng, 40)), (3, item)], "item_id long, text string")
    found = decontaminate.with_leaks(odd, items)
    assert found.columns == [*odd.columns, "leaks"] and found.count() == len(odd_rows)
    assert decontaminate.without_leaks(odd, items).count() == len(odd_rows)
    assert decontaminate.without_leaks(odd, no_items).columns == odd.columns
    assert decontaminate.with_leaks(empty, items).count() == 0
    text = f"{make(rng, 2_000)} {item} {make(rng, 3_000)}"
    benchmark = decontaminate.Benchmark(["1"], [item])
    at = text.index(item)
    assert [(x["start"], x["end"]) for x in decontaminate.find_in([text], benchmark)[0]] == [(at, at + len(item))]
    assert len(decontaminate.find_in([f"{item} and {item}"], benchmark)[0]) == 2


def test_passages_cover_every_repeated_run(spark, make):
    rng = random.Random(9)
    shared = [make(rng, n).split() for n in (55, 70, 120)]
    rows = []
    for k in range(90):
        parts = [make(rng, rng.randint(0, 150)).split(), shared[k % 3] if k % 2 else [], make(rng, rng.randint(5, 60)).split()]
        rows.append((k, " ".join(sum(parts, []))))
    rows += [(500, rows[1][1]), (501, " ".join(edited(rng, rows[5][1].split(), 4)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    text = {i: words(t) for i, t in rows}
    seen = {}
    for i, found in text.items():
        for j in range(len(found) - 49):
            seen.setdefault(tuple(found[j : j + 50]), set()).add(i)
    covered = {i: set() for i in text}
    for r in got:
        assert r["doc_id"] != r["other_id"] and min(r["end"] - r["start"], r["other_end"] - r["other_start"]) >= 50
        a, b = text[r["doc_id"]][r["start"] : r["end"]], text[r["other_id"]][r["other_start"] : r["other_end"]]
        assert abs(1 - distance(a, b) / max(len(a), len(b)) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        covered[r["other_id"]].update(range(r["other_start"], r["other_end"]))
    for i, found in text.items():
        for j in range(len(found) - 49):
            if len(seen[tuple(found[j : j + 50])]) > 1:
                # Members meet their representative only; a few more words at an end may be shared with another member.
                assert covered[i].issuperset(range(j + 4, j + 46))
    clean = {i for i in range(0, 90, 2)}
    assert not clean & ({r["doc_id"] for r in got} | {r["other_id"] for r in got})


def test_exact_passages_before_and_after_templates(make):
    rng = np.random.default_rng(14)
    fresh = lambda n: rng.integers(0, 1 << 16, n).astype("<u2")
    passage = fresh(60)
    for fields in (3, 5, 10, 40):
        labels = [fresh(5) for _ in range(fields)]
        form = lambda: np.concatenate([part for label in labels for part in (fresh(7), label)])  # noqa: B023, E731
        one, other = form(), form()
        for turn in (1, -1):
            x, y = (np.concatenate([passage, f][::turn]) for f in (one, other))
            at = 0 if turn > 0 else len(one)
            for anchor in (at, at + 30, at + 55):
                found = passages.passages_of(x, y, [(anchor, anchor)])
                assert any(p["start"] <= at and at + 60 <= p["end"] and p["similarity"] >= 0.8 for p in found)


def test_windows_find_passages_at_the_bar():
    rng = np.random.default_rng(15)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in (50, 55, 60):
        hits = 0
        for _ in range(150):
            p = fresh(n)
            q = p.copy()
            q[rng.choice(n, n // 5, replace=False)] = fresh(n // 5)
            tokens = [passages.shingles(np.r_[fresh(80), part, fresh(80)], passages.SHINGLE) for part in (p, q)]
            a, b = ({int(t[c]): passages.packed(*map(np.int64, (c, l, r))) for c, l, r in passages.compact_windows(t, passages.LEAST - passages.SHINGLE + 1)} for t in tokens)
            hits += any(passages.shared_words(a[key], b[key]) >= passages.LEAST for key in a.keys() & b.keys())
        assert hits >= 0.96 * 150, (n, hits)


def test_compact_windows_hold_every_range(make):
    rng = random.Random(10)
    tokens = WordHashes()([str(rng.randrange(400)) for _ in range(300)])
    found = passages.compact_windows(tokens, 20)
    for factor, offset in zip(passages.FACTORS, passages.OFFSETS, strict=True):
        hashed = tokens * factor + offset
        for low in range(0, 280, 7):
            for high in range(low + 20, 301, 13):
                c = low + int(hashed[low:high].argmin())
                assert any(hashed[w[0]] == hashed[c] and w[1] <= low and high - 1 <= w[2] for w in found if low <= w[0] < high)


def test_windows_of_many_texts_are_those_of_each():
    rng, near = np.random.default_rng(41), passages.NEAR
    texts = [rng.integers(0, kinds, n, dtype=np.uint64) for n, kinds in [(46, 9), (200, 3), (45, 99), (700, 1 << 60), (0, 2), (300, 150), (1, 2)]]
    c, left, right = passages.widths(np.concatenate(texts), np.array([len(t) for t in texts]), 46, near)
    want, first = {}, 0
    for tokens in texts:
        for factor, offset in zip(passages.FACTORS, passages.OFFSETS, strict=True):
            open_ranges, hashed = [(0, len(tokens))], tokens * factor + offset
            while open_ranges:
                low, high = open_ranges.pop()
                if high - low >= 46:
                    at = low + int(hashed[low:high].argmin())
                    a, b = want.get(first + at, (0, 0))
                    want[first + at] = max(a, min(at - low, near)), max(b, min(high - 1 - at, near))
                    open_ranges += [(low, at), (at + 1, high)]
        first += len(tokens)
    assert dict(zip(c.tolist(), zip(left.tolist(), right.tolist(), strict=True), strict=True)) == want


def test_equal_words_are_extended_once(monkeypatch):
    rng, calls = np.random.default_rng(42), []
    fresh = lambda n: rng.integers(0, 1 << 16, n).astype("<u2")
    run, extend = fresh(40), passages.extend
    x, y = (np.concatenate([fresh(300), run, fresh(300)]) for _ in range(2))
    monkeypatch.setattr(passages, "extend", lambda *args: calls.append(args) or extend(*args))
    assert passages.passages_of(x, y, [(300 + k, 300 + k) for k in range(36)]) == []  # 40 words are too few
    assert len(calls) == 2


def test_turns_are_the_nearest_in_order():
    rng = random.Random(43)
    for _ in range(3000):
        part = [rng.randrange(3) for _ in range(rng.randint(0, 13))]
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 4))] + part for _ in range(2))
        a, b = a[:13], b[:13]
        fits = [(p, q) for p in range(9) for q in range(9) if len(a[p : p + 5]) == 5 and a[p : p + 5] == b[q : q + 5] and (p, q) in passages.TURNS]
        assert passages.next_turn(a, b) == min(fits, key=passages.TURNS.get, default=None)


def test_windows_that_do_not_fit_the_first_meet_others(spark):
    def window(token, doc, place, left, right):
        return token, doc, int(passages.packed(*map(np.int64, (place, place - left, place + right))))

    rows = [window(7, 1, 50, 50, 0), *[window(7, d, 0, 0, 60) for d in (2, 3, 4)]]  # the first ends where the others begin
    rows += [window(8, 1, p, 60, 60) for p in (100, 300, 500)] + [window(8, 2, 70, 60, 60)]  # repeats of one document
    rows += [window(9, 5, p, 60, 60) for p in (100, 300)]  # a token of one document only
    for size in (10_000, 2):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = passages.links(spark.createDataFrame(rows, "key long, id long, w long")).distinct().collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, found)) == [(2, 70, 1, 100), (2, 70, 1, 300), (2, 70, 1, 500), (3, 0, 2, 0), (4, 0, 2, 0)]


def test_passages_do_not_depend_on_the_layout(spark, make):
    rng = random.Random(31)
    shared = [make(rng, 70) for _ in range(3)]
    rows = [(k, " ".join([make(rng, 20), shared[k % 3], make(rng, 40), shared[k % 2], make(rng, 10)])) for k in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, *others = (sorted(map(tuple, passages.repeated_passages(frame.repartition(n)).collect())) for n in (1, 4, 16))
    assert one and others == [one, one]
    twice = spark.createDataFrame([(1, " ".join([shared[0], make(rng, 60), shared[0]])), (2, shared[0])], "doc_id long, text string")
    assert {(r["doc_id"], r["start"], r["other_id"], r["other_start"]) for r in passages.repeated_passages(twice).collect()} == {(2, 0, 1, 0), (2, 0, 1, 130)}


def test_passages_of_odd_rows(odd, empty):
    rows = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(8, 7), (9, 7)}
    assert passages.repeated_passages(empty).count() == 0


def test_places_are_confirmed_as_packed_numbers(spark):
    rng = np.random.default_rng(44)
    x = rng.integers(0, 1 << 16, 80).astype("<u2")
    rows = [(x[10:].tobytes(), 10, np.concatenate([x[:5], x]).tobytes(), [(40 << 32) | 45, (12 << 32) | 17])]
    frame = spark.createDataFrame(rows, "x binary, low int, y binary, places array<long>")
    found = frame.select(passages.confirmed(*(F.col(c) for c in frame.columns)).alias("p")).collect()[0]["p"]
    assert [(p["start"], p["end"], p["other_start"], p["other_end"], p["similarity"]) for p in found] == [(10, 80, 15, 85, 1.0)]


def test_windows_refused_by_the_first_of_their_token_meet_others(spark, make, monkeypatch):
    rng, rows, wanted = random.Random(45), [], {}
    for k in range(25):
        shared = make(rng, 60).split()
        texts = [
            [*shared[:42], *make(rng, 30).split()],  # the first two hold all tokens of the passage, but under LEAST words of it
            [*make(rng, 30).split(), *shared[18:]],
            [*make(rng, 50).split(), *shared, *make(rng, 50).split()],
            [*make(rng, 70).split(), *edited(rng, shared, 3), *make(rng, 40).split()],
        ]
        rows += [(10 * k + n, " ".join(text)) for n, text in enumerate(texts)]
        wanted[10 * k + 3, 10 * k + 2] = 50
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (passages.BLOCK, 3):  # windows of a token in one block, and in many
        monkeypatch.setattr(passages, "BLOCK", block)
        found = passages.repeated_passages(frame.repartition(3)).collect()
        assert {(r["doc_id"], r["other_id"]) for r in found} == set(wanted)
        assert all(r["start"] <= 85 and r["end"] >= 115 for r in found)


def test_every_group_of_a_token_is_tried(spark, make):
    rng = random.Random(46)
    line, bodies = make(rng, 12), [make(rng, 60) for _ in range(4)]
    lone = [(k, f"{make(rng, 55)} {line} {make(rng, 55)}") for k in range(40)]  # share no more than a line
    cluster = [(100 + k, f"{make(rng, 55)} {line} {bodies[k % 4]} {make(rng, 9)}") for k in range(24)]
    frame = spark.createDataFrame(lone + cluster, "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(frame).collect()}
    label = {k: k for k, _ in cluster}
    for _ in cluster:
        for one, other in found:
            label[one] = label[other] = min(label[one], label[other])
    assert label == {k: 100 + (k - 100) % 4 for k, _ in cluster}
    assert all(one % 4 == other % 4 for one, other in found)


def test_windows_that_align_are_put_together():
    rng = np.random.default_rng(47)
    fresh = lambda n, kinds=1 << 16: rng.integers(1, kinds, n).astype("<u2")
    linked = 0
    for turn in range(60):
        token, body = fresh(5), [fresh(60, 1 << 16 if turn % 2 else 3) for _ in range(2)]
        texts = []
        for _ in range(12):
            parts = []
            for b in body:
                b = b[: rng.integers(0, 61)] if rng.random() < 0.3 else b
                for at in sorted(rng.choice(60, rng.integers(0, 7), replace=False), reverse=True):
                    if at < len(b):
                        b = np.concatenate([b[:at], fresh(rng.integers(0, 10)), b[at + rng.integers(0, 10) :]])
                parts.append(b)
            texts.append((len(parts[0]), np.concatenate([parts[0], token, parts[1], fresh(9)])))
        c = np.array([at for at, _ in texts])
        sides = [
            passages.beside(pa.chunked_array([pa.array([x[at + 5 : at + 69].tobytes() for at, x in texts], pa.binary())]), False),
            passages.beside(pa.chunked_array([pa.array([x[max(at - 64, 0) : at].tobytes() for at, x in texts], pa.binary())]), True),
        ]
        own, none = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        every = {(int(a), int(b)) for a, b in zip(*passages.pairs_apart(none, own, c, own, sides, True)[:2], strict=True)}
        one, other, more = passages.pairs_apart(none, own, c, own, sides, False)
        assert {(int(a), int(b)) for a, b in zip(one, other, strict=True)} <= every
        assert len(more) or len(set(zip(one.tolist(), other.tolist(), strict=True))) == len(every)
        for a in range(len(texts)):
            for b in range(a + 1, len(texts)):
                if passages.passages_of(texts[b][1], texts[a][1], [(texts[b][0], texts[a][0])]):
                    linked += 1
                    assert (a, b) in every
    assert linked > 500


def test_groups_of_a_token_are_joined_by_confirmed_links():
    edges = [(1, 5, 10, 3, 7, True), (1, 6, 40, 5, 10, True), (1, 9, 2, 3, 7, False), (1, 9, 4, 3, 7, False), (2, 4, 0, 3, 0, False), (3, 8, 1, 7, 1, True)]
    key, own, c, a, ac, ok = (np.array(x) for x in zip(*edges, strict=True))
    found = sorted(zip(*(x.tolist() for x in passages.groups_left(key, own, c, a, ac, ok)), strict=True))
    # places 2 and 4 of document 9 are one window; tokens 2 and 3 have no pair that was not tried
    assert found == [(1, 3, 7, 3, 7), (1, 5, 10, 3, 7), (1, 6, 40, 3, 7), (1, 9, 2, 9, 2), (1, 9, 4, 9, 2)]
