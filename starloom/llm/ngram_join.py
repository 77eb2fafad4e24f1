"""Set-similarity join of documents by their word n-grams: exact Jaccard links and the components they form.

A text's set holds the distinct runs of ``SHINGLE`` words. Two sets link when their Jaccard similarity is at least ``SHARE``.

1. Grams are counted per hash bucket (a table of ``BUCKETS`` numbers, whatever the size of the data). The counts give one
   order of all grams, rare ones first. Any order gives the same links; this one keeps common passages out of the prefixes.
2. Texts of equal sets are one node. A node keeps its rarest grams, so many that linked sets must share one of them, and a
   bitmap: each gram flips one of ``BITS`` to ``MOST_BITS`` bits, more for larger sets (a full bitmap proves nothing).
3. Tiles: nodes of one band of set sizes that keep the same gram. Bands are wide and a node enters the next one if sets of
   linkable size lie there. Tiles of grams that may be frequent (by their bucket's count) are split into parts of
   about ``PART`` nodes, and the parts' first nodes form the tile again.
4. In a tile nodes are paired with its first node, one pair a node, so groups of near copies stay linear. Tiles
   that hold nodes of several components go on: first with their most linked node (if it has a link), then with all pairs of different
   components that share enough kept grams, each pair in the tile of the first one it shares (``met``).
5. A pair is dropped if the bits in which the bitmaps differ prove that the overlap is too small (each differing bit stands for
   a gram of one set only). The rest is decided by intersecting the sorted sets.

Words are compared by 64-bit hashes. Only texts of candidates are shuffled; their ids are marked in a table of ``MARKS`` bits, so
most other texts are never sent (were the table full, all would be, and the join alone would decide).

Defined cases: a null text or one without words has an empty set and links with nothing; a text of fewer words than
``SHINGLE`` is one shingle, its whole sequence; rows without an id link with nothing and have no component; rows that repeat an id
and a text are equal sets; rows of one id with other texts are separate nodes named by the same id; texts of any length are read
whole; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.llm.common import mix, shingles
from starloom.llm.components import components, extended
from starloom.session import cut_lineage, discard

SHINGLE = 5
SHARE = (4, 5)  # a Jaccard similarity of four fifths
BUCKETS = 1 << 18
BITS = 512
MOST_BITS = 4096
PART = 4096
MARKS = 1 << 24
FIRST = 32  # a pair is formed once if it shares one of so many rarest grams
WIDE = 8  # a band of sizes spans this power of 5/4
PIECE = 1 << 20  # bytes hashed at once
_RANDOM = np.random.default_rng(20240612)
_BASE = int(_RANDOM.integers(1, 1 << 62)) * 2 + 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end at a bound or after white space, so they cut no word."""
    start = 0
    while start < len(data):
        end = start + PIECE
        if end < len(data):
            bound = int(bounds[np.searchsorted(bounds, end, "right") - 1])
            gaps = np.flatnonzero(SPACE[data[start:end]])
            end = max(bound, start + int(gaps[-1]) + 1 if len(gaps) else 0)
            if end <= start:  # one word fills the range
                later = np.flatnonzero(SPACE[data[start:]])
                end = min(start + int(later[0]) + 1 if len(later) else len(data), int(bounds[np.searchsorted(bounds, start, "right")]))
        end = min(end, len(data))
        yield start, end
        start = end


def word_hashes(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 bytes, in order, and how many of them lie before each bound. No word crosses a bound."""
    hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in pieces(data, bounds):
        part = data[start:end]
        up, down = powers.to(len(part))
        inside = ~SPACE[part]
        cuts = bounds[(bounds > start) & (bounds < end)] - start
        before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        before[cuts] = False
        after[cuts - 1] = False
        begin, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)))
        firsts.append(begin + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), bounds)


def gram_sets(texts: pa.Array, powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string column."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_of = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    nulls = texts.is_null().to_numpy(zero_copy_only=False)
    block = np.r_[np.arange(0, len(texts), 256), len(texts)]
    for first, last in zip(block[:-1], block[1:], strict=True):
        bounds = ends[first : last + 1] - ends[first]
        found, counts = word_hashes(bytes_of[ends[first] - ends[0] : ends[last] - ends[0]], bounds, powers)
        for k in range(last - first):
            own = found[counts[k] : counts[k + 1]] if not nulls[first + k] else found[:0]
            yield np.unique(shingles(own, SHINGLE))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many sets hold a gram of each hash bucket, counted in each task and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sets = list(gram_sets(batch.column(0), powers))
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "often"])

    found = texts.select("text").mapInArrow(run, "bucket long, often long").groupBy("bucket").agg(F.sum("often").alias("often")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"]] = found["often"]
    return counts


def kept_of(sizes: np.ndarray | int) -> np.ndarray | int:
    """How many of its rarest grams a set keeps: linked sets share SHARE of the larger one, so one of these is among them."""
    return sizes - -(-sizes * SHARE[0] // SHARE[1]) + 1


def key_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def bitmap(found: np.ndarray) -> np.ndarray:
    """64-bit numbers of one to two bits a gram, within ``BITS`` and ``MOST_BITS``. The two halves of a bitmap make the one of half its bits."""
    bits = min(max(1 << (len(found) - 1).bit_length(), BITS), MOST_BITS) if len(found) else BITS
    flips = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool)).view(np.int64)


def described(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, key, n, grams, parts, bits) of rows (id, text): kept grams, into how many parts their tiles go, and the bitmap."""
    ranks = np.empty(BUCKETS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    parts_of = np.minimum(counts // PART + 1, 1 << 30).astype(np.int32)

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys, sizes, grams, parts, bits = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for found in gram_sets(batch.column(1), powers):
                keys.append(key_of(found))
                sizes.append(len(found))
                bucket = (found >> np.uint64(46)).astype(np.int64)
                rare = np.argsort(ranks[bucket], kind="stable")[: kept_of(len(found))] if len(found) else bucket
                grams.append(found[rare].view(np.int64))
                parts.append(parts_of[bucket[rare]])
                bits.append(bitmap(found))
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())]
            columns += [lists(grams, pa.int64()).slice(1), lists(parts, pa.int32()).slice(1), lists(bits, pa.int64()).slice(1)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "grams", "parts", "bits"])

    return rows.mapInArrow(run, "id long, key binary, n int, grams array<long>, parts array<int>, bits array<long>")


def band_of(n: Column) -> Column:
    """The band of a set size."""
    return F.floor(F.log(n) / (WIDE * float(np.log(SHARE[1] / SHARE[0]))))


def tile_of(gram: Column, band: Column) -> Column:
    return F.xxhash64(gram, band)


def most_after(n: Column, at: Column) -> Column:
    """The size of the largest set with which one of size ``n`` may link if ``at`` grams come before the first shared one."""
    low, high = SHARE
    return F.floor((n - at) * (low + high) / low + 1e-6) - n


def tiles(nodes: DataFrame) -> DataFrame:
    """(tile, leader, node, over, at) of the tiles where nodes may link; a split tile's parts have leaders that are nodes of the tile's leader.

    ``over``: the tile is of the band above the node's own; two such nodes meet in their own band too. ``at``: how many of the node's
    grams come before the tile's. Of a tile that is not split, nodes are left out that ``most_after`` shows to link with no other by this
    gram as the first that they share.
    """
    reach = band_of(F.col("n") * SHARE[1] / SHARE[0] + 1e-6)  # the band of the largest set it may link with
    each = nodes.select("node", "n", F.posexplode(F.sequence(band_of(F.col("n")), reach)).alias("above", "band"), F.arrays_zip("grams", "parts").alias("kept"))
    each = each.select("node", "n", "above", "band", F.posexplode("kept").alias("at", "kept"))
    part = F.when(F.col("kept.parts") > 1, F.pmod(F.xxhash64("node"), F.col("kept.parts")).cast("int")).otherwise(-1)  # -1: not split
    rows = each.select(tile_of(F.col("kept.grams"), F.col("band")).alias("tile"), "node", (F.col("above") > 0).alias("over"), "n", "at", part.alias("part"))
    own = Window.partitionBy("tile", "part")
    most = most_after(F.col("n"), F.col("at"))
    least = F.min(F.when(most >= F.col("n"), F.col("n"))).over(own)  # the smaller set of a link may link with its like
    rows = rows.withColumn("least", least).where((most >= F.col("least")) | (F.col("part") >= 0))
    led = rows.withColumn("leader", F.min("node").over(own)).withColumn("many", F.max("node").over(own) > F.col("leader"))
    led = cut_lineage(led.where("many or part >= 0").drop("n", "least"))
    columns = ["tile", "leader", "node", "over", "at"]
    heads = led.where("part >= 0 and leader = node").drop("leader")
    first = heads.groupBy("tile").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    return led.where("many").select(columns).unionByName(heads.join(first, "tile").select(columns))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ; if one has twice the other's, its halves are laid over each other first."""
    size = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    one, other = (F.when(F.size(x) > size, F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), xor)).otherwise(x) for x in (a, b))
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))


def may_link(n: Column, m: Column, a: Column, b: Column) -> Column:
    """False where sizes or bitmaps prove that two sets are too unlike: 2 · overlap is at most n + m - differing bits.

    Sets whose sizes may link have bitmaps of one width, or one has twice the other's.
    """
    differ = differing(a, b)
    low, high = SHARE
    sizes = (F.least(n, m) * high >= F.greatest(n, m) * low)
    return sizes & ((n + m - differ) * (low + high) >= 2 * low * (n + m))


def enough_kept(n: Column, m: Column, shared: Column) -> Column:
    """False where two sets share too few of their kept grams to link.

    In the global order, whichever kept part ends first, the overlap is what both kept parts share and, at most, all the rest of that set.
    """
    low, high = SHARE
    rest = [F.ceil(x * low / high) - 1 for x in (n, m)]
    return (shared + F.greatest(*rest)) * (low + high) >= low * (n + m)


def overlapping(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact decision on two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return same * SHARE[1] >= (len(x) + len(y) - same) * SHARE[0]


def linked(pairs: DataFrame) -> DataFrame:
    """The links (leader, node) among pairs (leader, node, a, b) with the two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sides = zip(gram_sets(batch.column(2), powers), gram_sets(batch.column(3), powers), strict=True)
            yield batch.select([0, 1]).filter(pa.array([overlapping(x, y) for x, y in sides], pa.bool_()))

    return pairs.select("leader", "node", "a", "b").mapInArrow(run, "leader long, node long")


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted nodes (node, id, key), from rows (id, text)."""
    place = F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int")
    marked = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at"))
    words = marked.agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")).toPandas()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[words["at"]] = words["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            at = batch.column(2).fill_null(0).to_numpy()
            batch = batch.filter(pa.array((marks[at >> 6] >> (at & 63)) & 1 == 1))
            keys = pa.array(map(key_of, gram_sets(batch.column(1), powers)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, batch.column(1)], ["id", "key", "text"])

    found = rows.select("id", "text", place.alias("place")).mapInArrow(run, "id long, key binary, text string")
    return cut_lineage(found.join(wanted, ["id", "key"]).groupBy("node").agg(F.min("text").alias("text")))


def allowed(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (leader, node) that sizes and bitmaps allow; ``light``: node, n, bits."""
    one, other = (light.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "bits")]) for side in ("a", "b"))
    joined = pairs.join(other, pairs["node"] == F.col("b_node")).join(one, F.col("leader") == F.col("a_node"))
    return joined.where(may_link(F.col("a_n"), F.col("b_n"), F.col("a_bits"), F.col("b_bits"))).select("leader", "node")


def confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links among stored pairs (leader, node), decided by the texts of both."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("leader", "node")).alias("node")).distinct()
    texts = texts_of(rows, nodes.select("node", "id", "key").join(ends, "node"))
    one = texts.select(F.col("node").alias("leader"), F.col("text").alias("a"))
    found = cut_lineage(linked(pairs.join(texts.withColumnRenamed("text", "b"), "node").join(one, "leader")))
    discard(texts)
    return found


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (tile, node, more) with the nodes' ``label``, of the tiles that hold nodes of several components."""
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return cut_lineage(named.join(several.select("tile"), "tile"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct()


def met(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (tile, node, over, at) with n, bits and ``earlier``: those of the node's FIRST rarest grams that come before the tile's.

    Two nodes that may link meet in the tile of the first gram that they share, and there they have no earlier gram in common. Rows
    without ``at`` get it as far as the FIRST grams tell.
    """
    firsts = rows.join(nodes.select("node", "n", "bits", F.slice("grams", 1, FIRST).alias("grams")), "node")
    if "at" not in rows.columns:
        band = band_of(F.col("n")) + F.col("over").cast("int")
        place = F.array_position(F.transform("grams", lambda gram: tile_of(gram, band)), F.col("tile")).cast("int")
        firsts = firsts.withColumn("at", F.when(place > 0, place - 1).otherwise(F.size("grams")))
    return firsts.withColumn("earlier", F.slice("grams", 1, F.least("at", F.lit(FIRST)))).drop("grams")


def unresolved(last: DataFrame) -> DataFrame:
    """The pairs (leader, node) of ``met`` rows that are of different components and that sizes, bitmaps and places of the tile's gram
    allow, each from one tile where the FIRST grams of both decide it."""
    columns = ("tile", "node", "over", "at", "label", "n", "bits", "earlier")
    a, b = ({c: F.col(f"{side}_{c}") for c in columns} for side in "ab")
    one, other = (last.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "ab")  # alike, so they share one shuffle
    fits = (a["node"] < b["node"]) & (a["label"] != b["label"]) & ~(a["over"] & b["over"])
    fits = fits & (b["n"] <= most_after(a["n"], a["at"])) & (a["n"] <= most_after(b["n"], b["at"]))
    fits = fits & ~F.arrays_overlap(a["earlier"], b["earlier"]) & may_link(a["n"], b["n"], a["bits"], b["bits"])
    return one.join(other, (a["tile"] == b["tile"]) & fits).select(a["node"].alias("leader"), b["node"].alias("node"))


def sharing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (leader, node) that share enough kept grams."""
    one, other = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "grams")]) for side in ("a", "b"))
    joined = pairs.join(other, pairs["node"] == F.col("b_node")).join(one, F.col("leader") == F.col("a_node"))
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return joined.where(enough_kept(F.col("a_n"), F.col("b_n"), shared)).select("leader", "node")


def link_labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``components`` of all links, from so many of them as it takes.

    ``rows``: id, text; ``nodes``: node, id, key, n, grams, parts, bits.
    """
    found = cut_lineage(tiles(nodes))
    light = nodes.select("node", "n", "bits")
    members = cut_lineage(found.select("tile", "node", "over", "at").distinct())
    first = allowed(found.where("leader < node").select("leader", "node").distinct(), light)
    tried = cut_lineage(first.groupBy("node").agg(F.min("leader").alias("leader")).select("leader", "node"))
    discard(found)
    linked_pairs = confirmed(tried, rows, nodes)

    labels = components(linked_pairs, "leader", "node")
    rest = mixed(members, labels)
    degree = linked_pairs.select(F.explode(F.array("leader", "node")).alias("node")).groupBy("node").agg(F.count("node").alias("links"))
    known = rest.join(degree, "node", "left").withColumn("order", F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("node")))
    centres = known.groupBy("tile").agg(F.max_by(F.struct("node", "label"), "order").alias("centre"), F.max("links").alias("links"))
    pairs = rest.join(centres.where("links > 0"), "tile").where("label <> centre.label").select(F.col("centre.node").alias("leader"), "node")
    second = cut_lineage(allowed(ordered(pairs), light).join(tried, ["leader", "node"], "left_anti"))
    labels = extended(labels, confirmed(second, rows, nodes), "leader", "node")

    last = met(mixed(rest.select("tile", "node", "over", "at"), labels), nodes)
    fresh = cut_lineage(unresolved(last).distinct().join(tried.unionByName(second), ["leader", "node"], "left_anti"))
    third = cut_lineage(sharing(fresh, nodes))
    labels = extended(labels, confirmed(third, rows, nodes), "leader", "node")
    discard(members, tried, rest, second, fresh, third)
    return labels


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest id that links lead to."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    each = cut_lineage(described(rows, bucket_counts(rows)))
    own = cut_lineage(each.select("id", "key", "n"))
    named = each.where("key is not null and id is not null")
    folded = named.groupBy("key").agg(F.min("id").alias("id"), F.first(F.struct("n", "grams", "parts", "bits")).alias("set"))
    nodes = cut_lineage(folded.select(F.monotonically_increasing_id().alias("node"), "id", "key", "set.*"))
    discard(each)
    labels = link_labels(rows, nodes)
    placed = nodes.select("node", "id", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = placed.groupBy("label").agg(F.min("id").alias("component"))
    names = cut_lineage(placed.join(lowest, "label").select("key", "component"))
    discard(nodes)
    out = own.withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))).join(names, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
