"""Merkle manifest of a dataset by nested-interval labels.

Rows are leaves. Every group of rows is a tree whose leaves ascend by a key; the trees' tops, ordered by group, are the
leaves of one more tree, whose top is the root. A node is labelled with the interval [lo, hi) of the leaf ranks it covers,
so a run (``FANOUT`` neighbours below one parent) and the place of a child in it follow from ranks alone:

* Ranks come from one range shuffle of digests by (group, key): rows are numbered by their place in their partition, and small
  counts per (partition, group) are added up, so a group that holds a third of all rows spreads over many tasks.
* Levels are built bottom-up: nodes are grouped by (tree, lo div width of the parent), ``FANOUT`` rows a group at most.
* Ancestors are attached top-down: a run of one level joins the node of the level above whose interval contains it, by equal
  (tree, bucket of the level). A node carries the steps to the root: the bytes of its left and right siblings on each level,
  which are the interval differences [run.lo, lo) and [hi, run.hi) within its run. Leaves take the steps of their run,
  so what is shuffled with steps is one row for ``FANOUT`` leaves.

Digests are SHA-256 over lower-case hexadecimal texts; frames hold them as 32 bytes each.

Defined cases: null values are written ``-``; a null group is a group of its own and comes first; null keys come first; equal
keys follow each other by their digests (equal rows are interchangeable); a tree of one leaf has that leaf as its top; an empty
table has no rows; texts of any length are hashed whole; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.session import cut_lineage

FANOUT = 16
BYTES = 32  # of one digest
PLACE = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its partition below these bits


def hash_text(text: Column) -> Column:
    """SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def written(digest: Column) -> Column:
    """Lower-case hexadecimal text of digests."""
    return F.lower(F.hex(digest))


def row_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and its text; null as ``-``."""
    texts = [v.cast("string") for v in values]
    return hash_text(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, digest, more) with ``lo``, the rank of the row in its tree, and ``n``, the tree's size."""
    order = ["tree", "key", "digest"]
    placed = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumn("part", F.shiftright("at", 33))
    place = F.col("at").bitwiseAND(PLACE)
    counts = placed.groupBy("tree", "part").agg(F.min(place).alias("first"), F.count("tree").alias("here"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    return placed.join(shifts, ["tree", "part"]).withColumn("lo", place + F.col("shift")).drop("at", "part", "shift")


def _runs(nodes: DataFrame, level: int, kept: Column | None = None) -> DataFrame:
    """Runs of nodes (tree, lo, hi, n, digest) below one parent of ``level``: interval, body (digests in order), parent digest.

    A lone leaf is the only row of its run and stays the top itself.
    """
    bucket = F.expr(f"lo div {FANOUT**level}").alias("bucket")
    child = F.struct("lo", "hi", "digest", *([kept.alias("row")] if kept is not None else []))
    runs = nodes.groupBy("tree", bucket).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
    body = F.unhex(F.array_join(F.transform("children", lambda c: F.hex(c["digest"])), ""))
    runs = runs.withColumn("body", body)
    top = F.when(F.col("n") == 1, F.col("body")).otherwise(hash_text(written(F.col("body"))))
    return cut_lineage(runs.withColumn("digest", top) if kept is not None else runs.withColumn("digest", top).drop("children"))


def levels_of(leaves: DataFrame, kept: Column | None) -> list[DataFrame]:
    """Runs of each level, lowest first. Trees end at the level where one node is left."""
    found = [_runs(leaves.withColumn("hi", F.col("lo") + 1), 1, kept)]
    while True:
        level = len(found)
        rest = found[-1].where(F.col("n") > FANOUT**level)  # trees with more than one node on this level
        if rest.isEmpty():
            return found
        found.append(_runs(rest.select("tree", "lo", "hi", "n", "digest"), level + 1))


def _step(child_lo: Column, width: int) -> Column:
    """The child's left and right siblings as bytes, from the difference of its interval and its run's."""
    place = F.floor((child_lo - F.col("lo")) / width).cast("int")
    left = F.substring(F.col("body"), F.lit(1), place * BYTES)
    right = F.substring(F.col("body"), (place + 1) * BYTES + 1, F.length("body"))
    return F.struct(left.alias("left"), right.alias("right"))


def with_ancestors(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest runs with ``steps``, the way from their parent node to the root; ``tops``: tree, steps of the tree's top, and more.

    ``tops`` has one row per tree; its further columns are handed down.
    """
    handed = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for level in range(len(runs), 0, -1):
        width, own = FANOUT**level, runs[level - 1]
        height = (F.col("n") <= width) & (F.lit(level == 1) | (F.col("n") > width // FANOUT))  # the level of a tree's top run
        first = own.where(height).join(tops, "tree").select(*own.columns, "steps", *handed)
        if above is not None:
            node = above.select("tree", F.expr(f"node_lo div {width}").alias("bucket"), "node_lo", "node_hi", "steps", *handed)
            inside = own.where(~height).join(node, ["tree", "bucket"]).where("node_lo <= lo and hi <= node_hi")
            first = first.unionByName(inside.select(*own.columns, "steps", *handed))
        if level == 1:
            return first
        below = width // FANOUT
        child = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(below).cast("long")))
        nodes = first.withColumn("node_lo", child).withColumn("node_hi", F.least(F.col("node_lo") + below, F.col("hi")))
        above = nodes.withColumn("steps", F.concat(F.array(_step(F.col("node_lo"), below)), "steps"))
    raise ValueError("no level")


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(steps, digest, lambda own, s: hash_text(written(F.concat(s["left"], own, s["right"]))))


def siblings(steps: Column) -> Column:
    """Hexadecimal text of all siblings, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: written(F.concat(s["left"], s["right"]))), "")


def manifest(rows: DataFrame, group: Column, key: Column, digest: Column, kept: Column) -> DataFrame:
    """(kept, leaf, steps, subroot, root) of every row; ``kept`` is any expression over the row to hand through.

    Leaf, subroot and root are 32 bytes; ``steps`` lists the siblings from the leaf to the root.
    """
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # null sorts before every value
    leaves = ranked(rows.select(tree.alias("tree"), key.alias("key"), digest.alias("digest"), kept.alias("row")))
    own = levels_of(leaves, F.col("row"))
    subroots = None
    for level, runs in enumerate(own, 1):
        top = runs.where((F.col("n") <= FANOUT**level) & (F.lit(level == 1) | (F.col("n") > FANOUT ** (level - 1))))
        top = top.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
        subroots = top if subroots is None else subroots.unionByName(top)
    upper = levels_of(ranked(subroots.withColumn("row", F.col("key"))), F.col("row"))
    root = upper[-1].select(F.col("tree"), F.col("digest").alias("root"), F.array().cast("array<struct<left:binary,right:binary>>").alias("steps"))
    named = _leaves(with_ancestors(upper, root)).select(F.col("row").alias("tree"), "steps", F.col("leaf").alias("subroot"), "root")
    return _leaves(with_ancestors(own, named))


def _leaves(runs: DataFrame) -> DataFrame:
    """Rows of the lowest runs with all their steps."""
    each = runs.withColumn("_child", F.explode("children"))
    step = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(F.array(_step(F.col("_child.lo"), 1)), "steps"))
    handed = [c for c in ("subroot", "root") if c in runs.columns]
    return each.select(F.col("_child.row").alias("row"), F.col("_child.digest").alias("leaf"), step.alias("steps"), *handed)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of documents with a check of rows changed since: every fifth by the hash of its id has its letters in lower case.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (of the row as it is now), verified.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = row_digest([F.col(c) for c in [*fields, "text"]])
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    now = F.when(changed, row_digest([*[F.col(c) for c in fields], lower_ascii(F.col("text"))]))
    found = manifest(docs, F.col("source"), F.col("doc_id"), leaf, F.struct(F.col("doc_id").alias("doc_id"), now.alias("now")))
    root = folded(F.coalesce("row.now", "leaf"), F.col("steps"))
    out = found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded"))
    return out.select(
        "doc_id", written(F.col("leaf")).alias("leaf"), written(F.col("subroot")).alias("subroot"), written(F.col("root")).alias("root"),
        "proof_sha256", written(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
