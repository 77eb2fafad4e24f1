"""Document fingerprints: MinHash over shingles of five words, and documents with equal signature bands.

``PERMUTATIONS`` universal hash functions (odd factor, offset, modulo 2^64) are applied to all shingle hashes of a
text in vectorised numpy; 16 mixed bits of each minimum make the fingerprint, as hexadecimal text. The likeness
of two fingerprints is their share of equal positions, an estimate of the Jaccard similarity.

Defined cases: a null text counts as the empty one; a text without words is one shingle, its bare characters, and a
text without characters has an empty fingerprint (like itself only); fewer than five words make one shingle; texts
of any length are read whole; equal texts have equal fingerprints. Ids are whole numbers; rows with a null id come
last, and repeated ids follow each other in the order of a hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import WordHashes, filled, mix, shingles
from starloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS = 64
BANDS = 16
_RANDOM = np.random.default_rng(20240607)
FACTORS = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
FIRST_ID = -(1 << 63)


def signature_of(found: np.ndarray) -> np.ndarray:
    """16-bit minima of the shingles of word hashes (one at least)."""
    grams = shingles(found, SHINGLE)
    low = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(grams), 4096):
        part = grams[start : start + 4096]
        hashed = FACTORS[:, None] * part[None, :]
        hashed += OFFSETS[:, None]
        np.minimum(low, hashed.min(1), out=low)
    return (mix(low) >> np.uint64(48)).astype(">u2")


def signatures(texts: list[str], hashes: WordHashes) -> Iterator[np.ndarray | None]:
    """Signature of each text; none for a text without characters but white space."""
    for text, found in zip(texts, hashes.of(texts), strict=True):
        if not len(found):
            bare = "".join(text.split())
            found = hashes([bare]) if bare else found
        yield signature_of(found) if len(found) else None


def signature(text: str, hashes: WordHashes) -> np.ndarray | None:
    return next(signatures([text], hashes))


def written(found: np.ndarray | None) -> str:
    return "" if found is None else found.tobytes().hex()


def likeness_of(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([written(s) for s in signatures(filled(texts), hashes)], dtype=str)

    return run(text)


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of the shingle sets of two text columns; 0 if one has no shingle."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(WordHashes().of(filled(left)), WordHashes().of(filled(right)), strict=True):
            p, q = np.unique(shingles(x, SHINGLE)), np.unique(shingles(y, SHINGLE))
            same = len(np.intersect1d(p, q, assume_unique=True))
            out.append(same / max(len(p) + len(q) - same, 1))
        return pd.Series(out, dtype=float)

    return run(a, b)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(leader, doc_id, similarity): documents that share a signature band with a smaller id, Jaccard verified.

    In each band value every document is paired with the smallest id only, so a group of copies makes one link each.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null")
    marked = cut_lineage(own.select("id", fingerprint(F.col("text")).alias("print")).where("print <> ''").distinct())
    width = 4 * PERMUTATIONS // BANDS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("print"), b * width + 1, F.lit(width))))
    rows = cut_lineage(marked.select("id", F.explode(band).alias("band")))
    leaders = rows.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("_most")).where("leader <> _most")
    pairs = rows.join(leaders, "band").where("id <> leader").select("leader", "id").distinct()
    one = own.select(F.col("id").alias("leader"), F.col("text").alias("_a"))
    found = pairs.join(own, "id").join(one, "leader")
    similar = found.select("leader", F.col("id").alias("doc_id"), jaccard(F.col("_a"), F.col("text")).alias("similarity"))
    return similar.where(F.col("similarity") >= SIMILARITY).distinct()


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows dealt into ranges of descending ids, each range with a copy of the row that follows its last one.

    The ranges come from approximate quantiles of the ids, one per shuffle partition. The driver holds one id per
    range. Columns: range, tail (the copied row), id, order, text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("key", F.coalesce("id", F.lit(FIRST_ID)))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = sorted(set(own.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or []))
    cuts_array = np.array(cuts, np.int64)

    def ranges_of(key: Column) -> Column:
        @F.pandas_udf("int")
        def run(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts_array, keys.to_numpy(np.int64), "left").astype(np.int32))

        return run(key)

    heads = own.select("key", ranges_of(F.col("key")).alias("range")).groupBy("range").agg(F.max("key").alias("head")).collect()
    order = sorted((r["range"], r["head"]) for r in heads)
    # The row after a range is the head of the range below it; after the lowest range come the first rows again.
    after = {head: order[(k + 1) % len(order)][0] for k, (_, head) in enumerate(order)}
    tails = F.create_map(*[F.lit(x) for pair in after.items() for x in pair]) if after else None
    placed = own.withColumn("range", ranges_of(F.col("key")))
    targets = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")))
    if tails is not None:
        other = F.array(F.struct(F.get(F.map_values(F.map_filter(tails, lambda k, v: k == F.col("key"))), F.lit(0)).alias("range"), F.lit(True).alias("tail")))
        targets = F.when(F.col("key").isin(list(after)), F.concat(targets, other)).otherwise(targets)
    return placed.withColumn("_to", F.explode(targets)).select("_to.range", "_to.tail", "id", "key", "text"), ranges


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the fingerprint of its text and of its edited text, and their likenesses.

    The edited text has its last third (code points, rounded down) replaced by the beginning of the next document
    in descending id order; the first follows the last. One shuffle of the texts by id range.
    """
    dealt, ranges = followed(docs, doc_id, text)
    sorted_rows = dealt.withColumn("tie", F.xxhash64("text")).repartition(ranges, "range").sortWithinPartitions(
        "range", "tail", F.desc("key"), "tie", "text"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        before = None  # (id, text, signature) of a row that waits for the next one
        for batch in batches:
            follows, out = [], []  # each row that got its next one, and that one
            texts = batch["text"].tolist()
            for tail, own_id, own_text, mark in zip(batch["tail"], batch["id"].astype("object"), texts, signatures(texts, hashes), strict=True):
                if before is None and tail:  # a second copy of the row that follows
                    continue
                if before is not None:
                    follows.append((before, own_text, mark))
                before = None if tail else (own_id, own_text, mark)
            changed = [edited(own_text, next_text) for (_, own_text, _), next_text, _ in follows]
            for ((own_id, own_text, mark), _, next_mark), change, other in zip(follows, changed, signatures(changed, hashes), strict=True):
                digest = hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((own_id, len(own_text), digest, written(mark), written(other), likeness_of(mark, other), likeness_of(mark, next_mark)))
            yield pd.DataFrame(out, columns=list(OUT))

    return sorted_rows.select("range", "tail", F.col("id").cast("string").alias("id"), "text").mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]
