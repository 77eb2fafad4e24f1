"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from starloom.llm import spelling

OUT = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain(rows):
    counts = plain_counts(rows)
    around = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if near(a, b):
                around[a].append(b)
                around[b].append(a)
    forms = {}
    for w, found in around.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(around[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == OUT
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    letters = "aabcdeéßlÿz"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["aaaaaaaa", "abababab", "zzzzzzzzz"]

    def variant(w):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:k] + (rng.choice(letters) if kind else "") + w[k + (kind != 1) :]

    often = [(w, rng.choice([2, 20, 300])) for w in roots]
    often += [(variant(w), rng.choice([2, 3, 25])) for w in roots for _ in range(6)]
    for w in roots:
        once = variant(w)
        often += [(once, 25), *[(variant(once), 2) for _ in range(3)]]
    bag = [w for w, n in often for _ in range(n)]
    rng.shuffle(bag)
    shapes = [str.upper, str.title, lambda w: w, lambda w: w]
    return [(k, " ".join(rng.choice(shapes)(w) for w in bag[k::150]) + ("!7x" if k % 2 else ",")) for k in range(150)]


def test_forms_equal_those_of_all_pairs(spark, rows):
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])
    for parts in (1, 4):
        assert result(spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))) == want


def test_forms_of_odd_rows(odd, odd_rows, empty):
    assert result(spelling.spelling_forms(odd)) == plain(odd_rows)
    assert result(spelling.spelling_forms(empty)) == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(42)
    for _ in range(2000):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        costs = [rng.randrange(5) for _ in places]
        cost = dict(zip(places, costs, strict=True))
        pairs = [(cost[a] + cost[b]) for a in places for b in places if b - a >= 2]
        a, b = spelling.pivots_of(places, costs)
        assert b - a >= 2 and cost[a] + cost[b] == min(pairs)


def test_every_near_pair_shares_a_key():
    rng = random.Random(43)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(7, 9)))
        k, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:k] + (rng.choice("abc") if kind else "") + a[k + (kind != 1) :]
        if a == b or len(b) < 7:
            continue
        ranks = {g: rng.randrange(4) for g in {*spelling.grams_of(a), *spelling.grams_of(b)}}
        found = {}
        for w in (a, b):
            grams = spelling.grams_of(w)
            places, last = spelling.prefix_of(grams, ranks)
            asked = spelling.asked_keys(w, *spelling.pivots_of(places, [ranks[grams[p]] for p in places]))
            found[w] = last, set(asked), set(spelling.offered_keys(w, places))
        (last_a, piv_a, pre_a), (last_b, piv_b, pre_b) = found[a], found[b]
        assert (last_a <= last_b and piv_a & pre_b) or (last_b <= last_a and piv_b & pre_a), (a, b)
