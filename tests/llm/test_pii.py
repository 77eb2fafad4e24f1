"""Base spans against Python's regular expressions, and identifiers discovered from their contexts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from starloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def test_base_spans_equal_plain_matching(spark):
    rng = random.Random(1)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "7", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0101", "x@y.z", "a@b.c_d@e.f", "10.0.0.1", "é", "😀", "\n", "("]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8", "1.2.3", "000255.1.1.1", "99999999999999999999.1.1.1", "4" * 16, "79927398713" * 2, "+1" + " " * 30 + "2", "a@b", "@", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for row in frame.select("text", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [(s["start"], s["rank"], s["end"]) for s in row["s"]] == brute(row["text"]), row["text"]


def test_long_runs_neither_recurse_nor_take_squares(spark):
    texts = ["7" * 200_000, "a" * 200_000, "a.b" * 60_000, "1." * 10_000, "+1" + "()" * 60_000, "x@" + "a." * 60_000, " ".join(["+1 (212) 555-0101"] * 300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(pii.base_spans(F.col("text"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 0, 0, 2_500, 0, 1, 300]


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        rows.append((k, f"{make(rng, 9)} tel: +1 (212) 555-{1000 + k} {make(rng, 5)}"))
        rows.append((100 + k, f"{make(rng, 9)} please reply quickly to user{k}@host.example for more {make(rng, 4)}"))
    rows.append((200, f"{make(rng, 4)} tel: 555-0199-ext7 {make(rng, 4)}"))  # no base pattern has it
    rows.append((201, f"{make(rng, 4)} please reply quickly to @nick_77 for more {make(rng, 3)}"))
    rows.append((202, f"{make(rng, 4)} and later 555-0199-ext7, again"))
    rows.append((203, f"{make(rng, 4)} room 4711b is free and code x99 {make(rng, 4)}"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_discover_unseen_identifiers(labelled):
    got = {r["doc_id"]: [(r["text"][s["start"] : s["end"]], pii.KINDS[s["rank"]], s["base"]) for s in r["pii"]] for r in pii.find_pii(labelled).collect()}
    assert got[200] == [("555-0199-ext7", "phone", False)]
    assert got[201] == [("nick_77", "email", False)] or got[201] == [("@nick_77", "email", False)]
    assert got[202] == [("555-0199-ext7", "phone", False)]
    assert got[203] == [] and got[0] == [("+1 (212) 555-1000", "phone", True)]


def test_masks_and_keeps_columns(spark, odd, odd_rows, empty):
    docs = spark.createDataFrame([(1, "😀 a@b.cd, +1 (212) 555-0101 x", "k"), (2, None, "k"), (None, "ip 10.1.2.3", "k"), (1, "😀 a@b.cd, +1 (212) 555-0101 x", "k")], "doc_id long, text string, value string")
    rows = pii.mask_pii(docs)
    assert rows.columns == docs.columns
    assert sorted(str(r["text"]) for r in rows.collect()) == ["None", "ip <IP>", "😀 <EMAIL>, <PHONE> x", "😀 <EMAIL>, <PHONE> x"]
    found = pii.find_pii(odd)
    assert found.columns == [*odd.columns, "pii"] and found.count() == len(odd_rows)
    assert pii.find_pii(empty).count() == 0


def test_overlapping_spans_are_masked_together(spark):
    spans = "array<struct<start:int,rank:int,end:int,base:boolean>>"
    docs = spark.createDataFrame([("abcdefgh", [(1, 2, 5, True), (3, 3, 6, True), (7, 0, 8, True)])], f"text string, s {spans}")
    assert docs.select(pii.masked(F.col("text"), F.col("s")).alias("m")).first()["m"] == "a<CARD>g<EMAIL>"
    assert docs.select(pii.described(F.col("s")).alias("d")).first()["d"] == "card:1:5,phone:3:6,email:7:8"
