"""The manifest against a plain tree built in one process."""

import hashlib
import random
import zlib

import pytest

from starloom.llm import merkle

OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """Top of a tree and, for each leaf, its (left, right) siblings level by level."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, place in enumerate(at):
            run = place // 16 * 16
            ways[leaf].append(("".join(digests[run:place]), "".join(digests[place + 1 : run + 16])))
        digests = [sha("".join(digests[k : k + 16])) for k in range(0, len(digests), 16)]
        at = [p // 16 for p in at]
    return digests[0], ways


def plain(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> expected result rows."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf_of((doc_id, source, lang, n, text))
        now = leaf_of((doc_id, source, lang, n, lowered)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else own
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, now, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s])]) for s in names}
    root, upper = climb([trees[s][0] for s in names])
    out = []
    for s, high in zip(names, upper, strict=True):
        top, ways = trees[s]
        for (_, _, own, now, doc_id), way in zip(sorted(groups[s]), ways, strict=True):
            fold = now
            for left, right in way + high:
                fold = sha(left + fold + right)
            out.append((doc_id, own, top, root, sha("".join(a + b for a, b in way + high)), fold, fold == root))
    return out


def result(df):
    assert df.columns == OUT
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(make):
    rng = random.Random(21)
    sizes = {"a": 700, None: 300, "Ä": 1, "b": 16, "c": 17, "": 2, **{f"s{k}": 1 for k in range(20)}}
    out, k = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            text = make(rng, rng.randint(0, 9)).title() if k % 7 else None
            out.append((k * 3, text, None if k % 11 == 0 else "xx", source, None if k % 13 == 0 else k))
            k += 1
    rng.shuffle(out)
    return out


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_equals_a_plain_tree(spark, rows):
    want = plain(rows)
    assert {r[-1] for r in want} == {True, False}
    for parts in (1, 5):
        assert result(merkle.document_manifest(spark.createDataFrame(rows, KINDS).repartition(parts))) == sorted(want, key=repr)


def test_trees_of_many_levels_and_lone_leaves(spark):
    one = [(7, "Only one", "en", "s", 8)]
    assert result(merkle.document_manifest(spark.createDataFrame(one, KINDS))) == plain(one)
    many = [(k, f"T{k}", "en", "hot", k) for k in range(4100)] + [(5000, "x", "en", "other", 1)]
    assert result(merkle.document_manifest(spark.createDataFrame(many, KINDS))) == sorted(plain(many), key=repr)


def test_manifest_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()]
    assert result(merkle.document_manifest(odd)) == sorted(plain(rows), key=repr)
    assert result(merkle.document_manifest(empty)) == []


def test_any_rows_and_groups(spark):
    """Other keys, groups and handed values than those of documents."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(k % 3, f"k{k:03}", k * 1.5) for k in range(60)], "part int, name string, steps double")
    digest = merkle.row_digest([F.col("name"), F.col("steps")])
    found = merkle.manifest(frame, F.col("part"), F.col("name"), digest, F.col("name"))
    assert found.where(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert found.select("root").distinct().count() == 1 and found.count() == 60
