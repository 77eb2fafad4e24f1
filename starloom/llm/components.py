"""Connected components of links, by smallest labels and pointer jumps over stored frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starloom.session import cut_lineage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): for every node of a link the smallest node that links lead to.

    Each round gives a node the smallest label among its neighbours, then the label of that label, so long
    chains halve. Minima are combined before the shuffle; every round is stored, so lineage stays short.
    """
    both = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut_lineage(both.union(both.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("node"), F.least("a", "n").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        joined = labels.join(near, labels["node"] == near["a"])
        lower = cut_lineage(joined.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = cut_lineage(lower.join(of, "label").select("node", "old", F.least("label", "top").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """The ``components`` of all links: ``labels`` are those of the links before, ``links`` the stored ones that came after.

    Only the components that later links touch are gone through again, as one node each.
    """
    if links.isEmpty():
        return labels
    for end in (left, right):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        links = links.join(known, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    links = cut_lineage(links.select(left, right, f"{left}_label", f"{right}_label"))
    tops = components(links, f"{left}_label", f"{right}_label").select("label", F.col("node").alias("of"))
    ends = links.select(F.explode(F.array(left, right)).alias("node")).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    both = labels.select("node", "label").unionByName(fresh).withColumnRenamed("label", "of")
    return cut_lineage(both.join(tops, "of", "left").select("node", F.coalesce("label", "of").alias("label")))
