"""Small tables with awkward rows for all operators."""

import random

import pytest

SYLLABLES = "ka lo mi ne ru sa te vo pi da zu ber tol fin gra".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make():
    return sentence


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank, no letters, one word, non-BMP, repeated rows, ties and a very long text."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    body = sentence(rng, 120)
    return [
        (None, None), (None, body), (1, None), (2, ""), (3, "   \n\t "), (4, "1234 !!! ..."), (5, "word"), (6, "😀 naïve 日本語 ﬁ"),
        (7, body), (7, body), (8, body), (9, body.upper() + "!"), (10, long), (11, "a" * 50_000), (12, sentence(rng, 80)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names operators also use."""
    names = ["lang", "source", "n_chars", "score", "key", "id", "value", "start", "rep", "bucket", "label", "range"]
    rows = [(i, t, "xx", "s", 0, *["kept"] * 9) for i, t in odd_rows]
    kinds = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` string" for n in names[3:]]]
    return spark.createDataFrame(rows, ", ".join(kinds)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
