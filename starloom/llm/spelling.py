"""Spelling variants by pivotal grams: frequent near words name the forms of rare ones.

Two words are near if one inserted, deleted or replaced code point turns one into the other.

* All positional bigrams of a word are ordered by how many words hold them, rare ones first; the first three (and all that
  tie with the third) are its prefix. Of these, two that do not overlap are its pivots, chosen by dynamic programming for
  the smallest sum of counts. One edit can touch only one pivot, so the other stays, moved by one place at most; and
  the word whose prefix ends earlier in the order keeps its staying pivot inside the prefix of the other.
* A staying pivot also splits the word: what lies on the other side of it than the edit is equal. The index is keyed by that
  side's text, which holds the position limits (from the left, or from the right). An edit after both pivots leaves all up to
  the second one's end, an edit before both all from the first one's beginning. An edit that lies between them or touches one
  leaves the outer side of the other, and what is beyond both; two letters of that far end join the key where there are so many.
* Candidates are joined by key. Lengths that differ by one at most, letters whose counts differ by two in parity at most
  (one bit a letter), and edit distance verify them.

Bigram counts are one number per pair of letters, at most the square of the alphabet (90 letters in runs of A-Z and U+00C0 to
U+00FF), so every task may hold them. Words are counted with partial sums before the shuffle. Nothing is collected per word but
its near words, which a word's length and the alphabet bound.

Defined cases: null and empty texts have no words; a null id counts as the empty text in hashes; rows that repeat count each
time; of near words with equal counts the first in code-point order is the form; texts of any length are read whole; an
empty table has no words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.session import cut_lineage, discard

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SHORTEST = 7
LEAST = 2  # occurrences of a word
TIMES = 10  # a form is so many times as frequent
GRAM = 2
EDITS = 1
FAR = 2  # letters of the far end in a key
DAMAGED = 31  # one run in so many loses a code point
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def damaged(doc_id: Column, run: Column) -> Column:
    """The lower-case run, without one code point where the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGED == 0, shorter).otherwise(run)


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of enough code points and occurrences."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    words = runs.select(damaged(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= LEAST)


def grams_of(word: str) -> list[str]:
    return [word[k : k + GRAM] for k in range(len(word) - GRAM + 1)]


def prefix_of(grams: list[str], ranks: dict[str, int]) -> tuple[list[int], int]:
    """Places of a word's first grams in the global order (with all that tie with the last of them), and that last one's rank."""
    order = sorted((ranks[g], k) for k, g in enumerate(grams))
    last = order[min(GRAM * EDITS, len(order) - 1)][0]
    return sorted(k for rank, k in order if rank <= last), last


def asked_keys(word: str, first: int, second: int) -> list[str]:
    """Keys of a word's pivots, for edits after both, before both, up to the second's end, and from the first's beginning."""
    end = word[-FAR:] if len(word) - second - GRAM >= FAR else ""
    begin = word[:FAR] if first >= FAR else ""
    return [f"<{word[: second + GRAM]}|", f">{word[first:]}|", f"<{word[: first + GRAM]}|{end}", f">{word[second:]}|{begin}"]


def offered_keys(word: str, places: list[int]) -> list[str]:
    """Keys of a word's prefix grams, with and without the letters of the far end."""
    sides = [(f"<{word[: k + GRAM]}|", word[-FAR:]) for k in places] + [(f">{word[k:]}|", word[:FAR]) for k in places]
    return [key + far for key, letters in sides for far in ("", letters)]


def pivots_of(places: list[int], costs: list[int]) -> list[int]:
    """EDITS + 1 disjoint grams of the least total cost; ``places`` ascend.

    best[i][k]: the cheapest choice of k grams among the first i, as (cost, places); a gram at p follows the last
    place that ends before p.
    """
    wanted = EDITS + 1
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * wanted]
    for i, (place, cost) in enumerate(zip(places, costs, strict=True), 1):
        before = max((j for j in range(i) if j == 0 or places[j - 1] + GRAM <= place), default=0)
        row: list[tuple[int, tuple[int, ...]] | None] = [(0, ())]
        for k in range(1, wanted + 1):
            rest = best[before][k - 1]
            choices = [c for c in (best[i - 1][k], (rest[0] + cost, (*rest[1], place)) if rest else None) if c]
            row.append(min(choices) if choices else None)
        best.append(row)
    chosen = best[-1][wanted]
    return list(chosen[1]) if chosen else []


def index_keys(word: Column, often: dict[str, int]) -> Column:
    """Struct of a word: ``last`` (its prefix's end in the global order), the keys it asks for and those it offers."""
    ranks = {g: k for k, g in enumerate(sorted(often, key=lambda g: (often[g], g)))}

    @F.pandas_udf("last int, asked array<string>, offered array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in batches:
            lasts, asked, offered = [], [], []
            for w in words:
                grams = grams_of(w)
                places, last = prefix_of(grams, ranks)
                lasts.append(last)
                asked.append(asked_keys(w, *pivots_of(places, [often[grams[k]] for k in places])))
                offered.append(offered_keys(w, places))
            yield pd.DataFrame({"last": lasts, "asked": asked, "offered": offered})

    return run(word)


def letter_parities(word: Column) -> Column:
    """One bit a letter (by its code point modulo 64): set if it occurs an odd number of times. An edit changes two at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(63))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram, one number per pair of letters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda k: F.substring(F.col("word"), k, F.lit(GRAM)))
    rows = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: r["count"] for r in rows}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all near words of each word, both ways; ``words``: word, n (words distinct)."""
    keys = index_keys(F.col("word"), gram_counts(words))
    indexed = words.select("word", "n", F.length("word").alias("size"), letter_parities(F.col("word")).alias("letters"), keys.alias("keys"))
    indexed = cut_lineage(indexed.select("word", "n", "size", "letters", "keys.*"))
    side = ["word", "n", "size", "letters", "last"]
    asked = indexed.select(*side, F.explode(F.array_distinct("asked")).alias("key"))
    other = indexed.select(*[F.col(c).alias(f"near_{c}") for c in side], F.explode("offered").alias("key"))
    pairs = asked.join(other, "key").where(
        "last <= near_last and abs(size - near_size) <= 1 and bit_count(letters ^ near_letters) <= 2 and word <> near_word"
    )
    pairs = pairs.where(F.levenshtein("word", "near_word", EDITS) == EDITS)
    ends = [F.struct(F.col("word"), F.col("n"), F.col("near_word").alias("near"), "near_n"), F.struct(F.col("near_word").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))]
    return pairs.select(F.explode(F.array(*ends)).alias("pair")).select("pair.*").distinct()


def followed_to_the_end(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form; each form is far more frequent, so there is no circle.

    Every round doubles how far a word's pointer reaches.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, at = at, cut_lineage(moved)
        discard(before)
        done = at.where("moved").isEmpty()
        if done:
            return at.select("word", "root")


def spelling_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = cut_lineage(counted_words(docs, doc_id, text))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("near").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= F.col("n") * TIMES, F.struct(F.col("best.word").alias("word"), (-F.col("best.less")).alias("n")))
    named = cut_lineage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form")))
    roots = followed_to_the_end(named.where("form is not null").select("word", F.col("form.word").alias("form")))
    out = named.join(roots, "word", "left")
    return out.select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
