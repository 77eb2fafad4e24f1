"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of lower-case words. Its k-mers of three words (short texts: also of two) are labelled with their occurrence; each of
``SKETCHES`` hash functions picks the ``PICK`` smallest labelled k-mers, kept in text order, and their hash is a sketch
value. Texts that agree in a value (and lie in one band of lengths; bands overlap where linkable lengths meet) share a bucket. A pair is a link
when 1 - edit distance / longer length is at least ``SIMILARITY`` in words. Links give connected components; the smallest id names the class.

1. Equal word sequences are one node from the start, so exact copies cost one row each.
2. One shuffle deals the nodes to their buckets. Values that many nodes may share (a table of ``SLOTS`` counts tells) are dealt in parts of
   about ``PART`` nodes, whose first nodes form the bucket again, so no bucket gathers in one task.
3. Every node is paired with the first node of a bucket, one pair a node: groups of near copies stay linear.
4. Buckets that still hold nodes of several components go on, with their most linked node (the centre of a star joins its variants),
   and then with all pairs of different components that are left.

Before any alignment a pair must pass a bound: each edit changes at most two words of the two multisets of words, each differing bit
of two bitmaps stands for a word of one text only, so more differing bits than twice the allowed edits prove a pair unlike. In the last step the
bound is part of the join, with bitmaps that are wider for longer texts, so buckets full of unlike texts (a common passage) make few pairs.

Defined cases: null texts, texts without a word and rows without an id stay in classes of their own; texts of
any length are read whole; a text of fewer than three words has one k-mer; rows that repeat an id and a text are
copies, of which the filter keeps one; rows of one id with other texts are nodes of their own (their classes may carry the same name, and the
filter keeps one row of each); an empty table has no rows. Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.llm.align import similarity
from starloom.llm.common import WordHashes, filled, mix, shingles
from starloom.llm.components import components, extended
from starloom.llm.ngram_join import differing, mixed, ordered
from starloom.session import cut_lineage, discard

SHINGLE = 3
SIMILARITY = 0.8
SKETCHES = 40
PICK = 2
SHORT = 32  # texts of so many words are sketched by pairs of words too
BITS = 512
MOST_BITS = 4096
SLOTS = 1 << 16
PART = 4096
WIDE = 8  # a band of lengths spans this power of 5/4
MARKS = 1 << 20
_RANDOM = np.random.default_rng(20240601)
FACTORS = _RANDOM.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mer hashes made different from their second occurrence on; first occurrences stay, whatever else the text repeats."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    if fresh.all():
        return kmers
    first = np.flatnonzero(fresh)
    occurrence = np.arange(len(kmers)) - np.repeat(first, np.diff(np.r_[first, len(kmers)]))
    out = np.empty_like(kmers)
    out[order] = np.where(fresh, ranked, mix(ranked + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def order_sketches(kmers: np.ndarray) -> np.ndarray:
    """One value per hash function: its smallest labelled k-mers, in text order."""
    marked = labelled(kmers)
    out = np.empty(SKETCHES, np.uint64)
    pick, step = min(PICK, len(kmers)), max(1, (1 << 18) // len(kmers))
    for start in range(0, SKETCHES, step):
        hashed = marked[None, :] * FACTORS[start : start + step, None] + OFFSETS[start : start + step, None]
        rows = np.arange(len(hashed))
        places = []
        for _ in range(pick):
            places.append(hashed.argmin(1))
            hashed[rows, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen = kmers[np.sort(np.stack(places, 1), 1)]
        value = np.zeros(len(hashed), np.uint64)
        for k in range(pick):
            value = mix(value * np.uint64(31) + chosen[:, k])
        out[start : start + step] = value
    return out


def sketches(found: np.ndarray) -> np.ndarray:
    """The sketch values of a text's word hashes; a place of the list always stands for the same function and width."""
    values = order_sketches(shingles(found, SHINGLE))
    return np.r_[values, order_sketches(shingles(found, SHINGLE - 1))] if len(found) <= SHORT else values


def key_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def bitmap(found: np.ndarray, bits: int = BITS) -> np.ndarray:
    """64-bit numbers: one of ``bits`` bits flips for each labelled word. The two halves of a bitmap make the one of half its bits."""
    flips = np.bincount((labelled(mix(found)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool)).view(np.int64)


def wide_bitmap(found: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits a word, within ``BITS`` and ``MOST_BITS``."""
    return bitmap(found, min(max(1 << (4 * len(found) - 1).bit_length(), BITS), MOST_BITS))


def sketch(text: Column) -> Column:
    """Struct of the text key (null without words), the number of words, the sketch values and the bitmap, also wide."""

    @F.pandas_udf("key binary, n int, values array<long>, bits array<long>, wide array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            rows = []
            for found in hashes.of(filled(texts)):
                if not len(found):
                    rows.append((None, 0, None, None, None))
                    continue
                wide = wide_bitmap(found)
                rows.append((key_of(found), len(found), sketches(found).view(np.int64), np.bitwise_xor.reduce(wide.reshape(-1, BITS // 64), 0), wide))
            yield pd.DataFrame(rows, columns=["key", "n", "values", "bits", "wide"])

    return run(text)


def aligned(a: Column, b: Column, least: float) -> Column:
    """Word similarity of two text columns by banded alignment, 0 below ``least``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for left, right in batches:
            pairs = zip(hashes.of(filled(left)), hashes.of(filled(right)), strict=True)
            yield pd.Series([similarity(x.tolist(), y.tolist(), least) for x, y in pairs], dtype=float)

    # not deterministic for the planner: else a filter on the result is moved below it and aligns a second time, in more workers
    return run.asNondeterministic()(a, b)


def buckets(nodes: DataFrame) -> DataFrame:
    """(tile, leader, node) of all buckets with several nodes; parts of a split bucket have leaders that are nodes of the bucket's leader."""
    step = WIDE * float(np.log(1 / SIMILARITY))
    band = F.floor(F.log("n") / step)
    reach = F.floor(F.log(F.col("n") / SIMILARITY + 1e-6) / step)  # the band of the longest text it may link with
    each = nodes.select("node", F.explode(F.sequence(band, reach)).alias("band"), "values")
    each = each.select("node", "band", F.posexplode("values").alias("i", "value"))
    rows = each.select(F.xxhash64("i", "value", "band").alias("tile"), "node").withColumn("slot", F.pmod("tile", F.lit(SLOTS)))
    often = rows.groupBy("slot").count().select("slot", F.expr(f"cast(count div {PART} + 1 as int)").alias("parts"))
    rows = rows.join(F.broadcast(often), "slot")  # SLOTS rows at most
    rows = rows.select("tile", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), (F.col("parts") > 1).alias("split"))
    own = Window.partitionBy("tile", "part")
    led = rows.withColumn("leader", F.min("node").over(own)).withColumn("many", F.max("node").over(own) > F.col("leader"))
    led = cut_lineage(led.where("many or split"))
    heads = led.where("split and leader = node").select("tile", "node")
    first = heads.groupBy("tile").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    again = heads.join(first, "tile").select("tile", "leader", "node")
    found = cut_lineage(led.where("many").select("tile", "leader", "node").unionByName(again))
    discard(led)
    return found


def may_link(n: Column, m: Column, a: list[Column], b: list[Column]) -> Column:
    """False where lengths or bitmaps prove a pair unlike."""
    longer = F.greatest(n, m)
    edits = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return (longer - F.least(n, m) <= edits) & (differ <= 2 * edits)


def wide_may_link(n: Column, m: Column, a: Column, b: Column) -> Column:
    """False where the wide bitmaps prove a pair unlike that ``may_link`` allows.

    Edits that make up for different lengths change one word only. Texts that may link have bitmaps of one size or one twice the other's.
    """
    longer = F.greatest(n, m)
    edits = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    return differing(a, b) <= 2 * edits - (longer - F.least(n, m))


BITMAP = [f"b{k}" for k in range(BITS // 64)]


def sided(light: DataFrame, side: str) -> DataFrame:
    return light.select(*[F.col(c).alias(f"{side}_{c}") for c in light.columns])


def fits(one: str, other: str) -> Column:
    return may_link(F.col(f"{one}_n"), F.col(f"{other}_n"), *[[F.col(f"{s}_{b}") for b in BITMAP] for s in (one, other)])


def allowed(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (leader, node) that lengths and bitmaps allow; ``light``: node, n and the bitmap's numbers."""
    joined = pairs.join(sided(light, "x"), F.col("leader") == F.col("x_node")).join(sided(light, "y"), pairs["node"] == F.col("y_node"))
    return joined.where(fits("x", "y")).select("leader", "node")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted nodes (node, id, mark) from rows (id, mark, text).

    The hashed places of the wanted ids, ``MARKS`` at most, are broadcast first, so most other texts are not shuffled (were all places
    taken, all would be, and the join alone would decide).
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("place")
    places = wanted.select(place).distinct()
    near = rows.select("id", "mark", "text", place).join(F.broadcast(places), "place", "left_semi")
    return cut_lineage(near.join(wanted, ["id", "mark"]).groupBy("node").agg(F.min("text").alias("text")))


def confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leader, node, similarity) of the links among stored pairs."""
    ends = pairs.select(F.explode(F.array("leader", "node")).alias("node")).distinct()
    texts = texts_of(rows, nodes.select("node", "id", "mark").join(ends, "node"))
    one = texts.select(F.col("node").alias("leader"), F.col("text").alias("_a"))
    joined = pairs.join(texts, "node").join(one, "leader")
    found = joined.select("leader", "node", aligned(F.col("_a"), F.col("text"), SIMILARITY).alias("similarity"))
    found = cut_lineage(found.where(F.col("similarity") >= SIMILARITY))
    discard(texts)
    return found


def links(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, node, similarity): so many links that their components are those of all links between texts that share a bucket; and
    these ``components``.

    ``rows``: id, mark, text; ``nodes``: node, id, mark, n, values, bits, wide.
    """
    narrow = [F.col("bits")[k].alias(b) for k, b in enumerate(BITMAP)]
    light = nodes.select("node", "n", *narrow)
    found = buckets(nodes)
    members = cut_lineage(found.select("tile", "node").distinct())
    first = allowed(found.where("leader < node").select("leader", "node").distinct(), light)
    tried = cut_lineage(first.groupBy("node").agg(F.min("leader").alias("leader")).select("leader", "node"))
    discard(found)
    known = confirmed(tried, rows, nodes)

    labels = components(known, "leader", "node")
    rest = mixed(members, labels)
    if rest.isEmpty():
        return known, labels
    degree = known.select(F.explode(F.array("leader", "node")).alias("node")).groupBy("node").agg(F.count("node").alias("links"))
    ranked = rest.join(degree, "node", "left").withColumn("order", F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("node")))
    centres = ranked.groupBy("tile").agg(F.max_by(F.struct("node", "label"), "order").alias("centre"))
    pairs = rest.join(centres, "tile").where("label <> centre.label").select(F.col("centre.node").alias("leader"), "node")
    second = cut_lineage(allowed(ordered(pairs), light).join(tried, ["leader", "node"], "left_anti"))
    found = confirmed(second, rows, nodes)
    known, labels = known.unionByName(found), extended(labels, found, "leader", "node")

    held = rest.groupBy("node").agg(F.collect_list("tile").alias("tiles")).join(nodes.select("node", "n", *narrow, "wide"), "node")
    last = mixed(rest.select("tile", "node"), held.join(labels, "node", "left"))
    pairs = sided(last, "x").join(sided(last, "y"), F.col("x_tile") == F.col("y_tile"))
    once = F.array_min(F.array_intersect("x_tiles", "y_tiles")) == F.col("x_tile")
    wide = wide_may_link(F.col("x_n"), F.col("y_n"), F.col("x_wide"), F.col("y_wide"))
    pairs = pairs.where((F.col("x_node") < F.col("y_node")) & (F.col("x_label") != F.col("y_label")) & fits("x", "y") & once & wide)
    pairs = pairs.select(F.col("x_node").alias("leader"), F.col("y_node").alias("node"))
    third = cut_lineage(pairs.join(tried.unionByName(second), ["leader", "node"], "left_anti"))
    found = confirmed(third, rows, nodes)
    discard(members, tried, rest, second, last, third)
    return known.unionByName(found), extended(labels, found, "leader", "node")


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, mark, first, text_class, n_links) of every row; ``mark``: hash of the text, ``first``: (id, mark) of the first row of its class."""
    rows = docs.select(F.col(doc_id).alias("id"), F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).alias("mark"), F.col(text).alias("text"))
    each = cut_lineage(rows.withColumn("_s", sketch(F.col("text"))).select("id", "mark", "_s.*"))
    own = cut_lineage(each.select("id", "mark", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")))
    folded = each.where("key is not null and id is not null").groupBy("key").agg(
        F.min(F.struct("id", "mark")).alias("first"), F.first(F.struct("n", "values", "bits", "wide")).alias("s")
    )
    nodes = cut_lineage(folded.select(F.monotonically_increasing_id().alias("node"), "key", "first.*", "s.*"))
    discard(each)
    found, labels = links(rows, nodes)
    degree = found.select(F.explode(F.array("leader", "node")).alias("node")).groupBy("node").agg(F.count("node").alias("n_links"))
    placed = nodes.select("node", "key", F.struct("id", "mark").alias("own")).join(labels, "node", "left")
    placed = placed.join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = placed.groupBy("label").agg(F.min("own").alias("first"))
    names = cut_lineage(placed.join(lowest, "label").select("key", "first", F.col("own.id").alias("text_class"), "n_links"))
    discard(nodes)
    return own.join(names, "key", "left").select("id", "mark", "first", "text_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, text_class, n_links) of every row: near class, class of equal texts, confirmed links of the text."""
    named = _classes(docs, doc_id, text)
    return named.select(F.col("id").alias("doc_id"), F.coalesce("first.id", "id").alias("class_id"), F.coalesce("text_class", "id").alias("text_class"), "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near class: the one with the smallest id. Columns stay."""
    own = uuid.uuid4().hex  # names that no column has
    at, mark, taken = f"id_{own}", f"mark_{own}", f"taken_{own}"
    named = cut_lineage(_classes(docs, doc_id, text).where("id is not null"))
    gone = named.where("first is not null and (id <> first.id or mark <> first.mark)").select(F.col("id").alias(at), F.col("mark").alias(mark)).distinct()
    hashed = F.struct(F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"))
    marked = docs.withColumn(taken, hashed)
    kept = marked.join(gone, (F.col(doc_id) == F.col(at)) & (F.col(taken) == F.col(mark)), "left_anti")
    twice = named.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias(at), F.col("mark").alias(mark))
    if not twice.isEmpty():
        same = (F.col(doc_id) == F.col(at)) & (F.col(taken) == F.col(mark))
        worded = kept.join(twice, same, "left_semi").dropDuplicates([doc_id, taken])
        kept = kept.join(twice, same, "left_anti").unionByName(worded)
    return kept.drop(taken)
