"""Hierarchies of dimension columns: levels by distinct count, parents, siblings, links across tables.

All frames here have one row per column of the warehouse; windows run per table over its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions.names import is_measure, name_similarity
from starloom.session import cut_lineage

CROSS_MINIMUM = 0.5


def dimension_columns(stats: DataFrame) -> DataFrame:
    """Columns that are no measure by name and have at least two values."""
    measure = is_measure(F.col("table_name"), F.col("column_name"), F.col("type_name"))
    return stats.where(~measure & (F.col("cardinality") >= 2)).select(
        "table_name", "column_name", "position", F.col("type_name").alias("data_type"), "cardinality", "null_count"
    )


def hierarchy_levels(columns: DataFrame) -> DataFrame:
    """Levels from few to many distinct values, for tables with at least two dimension columns."""
    by_size = Window.partitionBy("table_name").orderBy("cardinality", "position")
    numbered = columns.withColumns(
        {
            "level": F.row_number().over(by_size) - 1,
            "total_levels": F.count(F.lit(1)).over(Window.partitionBy("table_name")),
            "parent": F.lag("column_name").over(by_size),
            "child": F.lead("column_name").over(by_size),
        }
    ).where(F.col("total_levels") >= 2)
    role = (
        F.when(F.col("level") == 0, "ROOT")
        .when(F.col("level") == F.col("total_levels") - 1, "LEAF")
        .otherwise("INTERMEDIATE")
    )
    return numbered.withColumn("role", role)


def parent_child(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("child").isNotNull()).select(
        "table_name", F.col("column_name").alias("parent"), "child", F.col("level").alias("parent_level")
    )


def magnitude(cardinality: Column) -> Column:
    """Whole digits of the count less one, i.e. floor(log10), without floating point."""
    return F.when(cardinality <= 0, 0).otherwise(F.length(cardinality.cast("string")) - 1)


def siblings(levels: DataFrame, minimum: float = 0.3) -> DataFrame:
    """Columns of one table with counts of the same magnitude and similar names (both directions)."""
    tagged = levels.select("table_name", "column_name", "cardinality", "level", magnitude(F.col("cardinality")).alias("bucket"))
    other = tagged.select(
        "table_name", "bucket",
        F.col("column_name").alias("sibling"),
        F.col("cardinality").alias("sibling_cardinality"),
        F.col("level").alias("sibling_level"),
    )
    pairs = tagged.join(other, ["table_name", "bucket"]).where(F.col("column_name") != F.col("sibling"))
    similar = pairs.withColumn("name_similarity", name_similarity(F.col("column_name"), F.col("sibling")))
    return similar.where(F.col("name_similarity") > minimum).drop("bucket")


def cross_confidence() -> Column:
    c1, c2 = F.col("cardinality1"), F.col("cardinality2")
    closeness = F.when((c1 > 0) & (c2 > 0), F.least(c1, c2) / F.greatest(c1, c2)).otherwise(0.0)
    distance = F.abs(F.col("level1") - F.col("level2"))
    score = (
        0.4
        + F.when(F.col("data_type1") == F.col("data_type2"), 0.2).otherwise(0.0)
        + closeness * 0.2
        + F.when(distance == 0, 0.1).when(distance == 1, 0.05).otherwise(0.0)
        + F.when(F.col("role1") == F.col("role2"), 0.1).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def cross_hierarchy_links(levels: DataFrame, minimum: float | None = None) -> DataFrame:
    """Same-named levels of different tables with similarity scores."""

    def side(i: int) -> DataFrame:
        return levels.select(
            F.lower("column_name").alias("_name"),
            *[F.col(c).alias(f"{n}{i}") for c, n in [
                ("table_name", "table"), ("column_name", "column"), ("cardinality", "cardinality"),
                ("level", "level"), ("role", "role"), ("data_type", "data_type"),
            ]],
        )

    pairs = side(1).join(side(2), "_name").where(F.col("table1") < F.col("table2")).drop("_name")
    links = pairs.withColumns(
        {
            "name_similarity": name_similarity(F.col("column1"), F.col("column2")),
            "cardinality_similarity": F.coalesce(
                F.try_divide(F.least("cardinality1", "cardinality2"), F.greatest("cardinality1", "cardinality2")),
                F.lit(0.0),
            ),
            "relationship_confidence": cross_confidence(),
        }
    )
    return links if minimum is None else links.where(F.col("relationship_confidence") >= minimum)


def hierarchy_summary(levels: DataFrame, links: DataFrame) -> DataFrame:
    """One row: tables, depth, roots, leaves and confident cross links."""
    sure = links.agg(F.count_if(F.col("relationship_confidence") > 0.7).alias("n"))
    return levels.agg(
        F.count_distinct("table_name").alias("tables_with_hierarchies"),
        F.coalesce(F.max("total_levels"), F.lit(0)).alias("max_hierarchy_depth"),
        F.count_if(F.col("role") == "ROOT").alias("root_nodes"),
        F.count_if(F.col("role") == "LEAF").alias("leaf_nodes"),
    ).withColumn("high_confidence_cross_relationships", sure.scalar())


def _in_level_order(entry: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])


def hierarchy_rows(levels: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row per table: root, leaf, levels between, parent, sibling and cross relationships as text.

    The levels (one row per column) are stored first because four results read them.
    """
    levels = cut_lineage(levels)
    inner = F.when(F.col("role") == "INTERMEDIATE", F.struct("level", F.col("column_name").alias("text")))
    chain = F.when(
        F.col("child").isNotNull(),
        F.struct("level", F.concat_ws(" -> ", "column_name", "child").alias("text")),
    )
    rows = levels.groupBy("table_name").agg(
        F.max("total_levels").alias("total_levels"),
        F.max(F.when(F.col("role") == "ROOT", F.col("column_name"))).alias("root_column"),
        F.max(F.when(F.col("role") == "ROOT", F.col("cardinality"))).alias("root_cardinality"),
        F.max(F.when(F.col("role") == "LEAF", F.col("column_name"))).alias("leaf_column"),
        F.max(F.when(F.col("role") == "LEAF", F.col("cardinality"))).alias("leaf_cardinality"),
        _in_level_order(inner).alias("intermediate_levels"),
        _in_level_order(chain).alias("parent_child_relationships"),
    )
    near = siblings(levels).groupBy("table_name").agg(
        _in_level_order(
            F.struct("level", "sibling_level", F.concat_ws(" <-> ", "column_name", "sibling").alias("text"))
        ).alias("sibling_relationships")
    )
    out = rows.join(near, "table_name", "left")
    links = cross_hierarchy_links(levels) if links is None else links
    text = F.format_string("%s.%s <-> %s.%s", "table1", "column1", "table2", "column2")
    across = (
        links.select(F.explode(F.array("table1", "table2")).alias("table_name"), text.alias("text"))
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list("text")).alias("cross_hierarchy_relationships"))
    )
    empty = F.array().cast("array<string>")
    return out.join(across, "table_name", "left").withColumns(
        {
            "hierarchy_name": F.concat("table_name", F.lit("_hierarchy")),
            "original_table_name": F.replace(F.col("table_name"), F.lit("_stage1"), F.lit("")),
            "sibling_relationships": F.coalesce("sibling_relationships", empty),
            "cross_hierarchy_relationships": F.coalesce("cross_hierarchy_relationships", empty),
        }
    )


def levels_from_profile(profile: DataFrame) -> DataFrame:
    """Levels over all dimension columns of the stored profile, single columns included."""
    by_size = Window.partitionBy("table_name").orderBy("cardinality", "position")
    everything = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return profile.where(F.col("classification") == "dimension").select(
        "table_name", "column_name", "cardinality", "null_count",
        (F.row_number().over(by_size) - 1).alias("level"),
        F.first("column_name").over(everything).alias("root_column"),
        F.last("column_name").over(everything).alias("leaf_column"),
        F.count(F.lit(1)).over(Window.partitionBy("table_name")).alias("total_levels"),
    )


def custom_hierarchy(requests: DataFrame, known_tables: DataFrame) -> DataFrame:
    """User-ordered levels (table_name, hierarchy_name, levels array) as chains; unknown tables drop."""
    known = requests.join(known_tables.select("table_name").distinct(), "table_name", "left_semi")
    size = F.size("levels")
    return known.select(
        "table_name", "hierarchy_name",
        F.get("levels", F.lit(0)).alias("root_column"),
        F.get("levels", size - 1).alias("leaf_column"),
        F.when(size > 2, F.slice("levels", F.lit(2), size - 2)).otherwise(F.array().cast("array<string>")).alias("intermediate_levels"),
        F.zip_with(
            F.slice("levels", F.lit(1), size - 1), F.slice("levels", F.lit(2), size - 1),
            lambda a, b: F.concat_ws(" -> ", a, b),
        ).alias("parent_child_relationships"),
        size.alias("total_levels"),
    )


def edit_hierarchies(stored: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Append the edited rows: given fields replace those of the latest version."""
    from starloom.operators.versioned import latest_by_key, merge_partial, next_versions

    current = latest_by_key(stored, keys, "version").join(edits.select(*keys), keys, "left_semi")
    return next_versions(stored, merge_partial(current, edits, keys), keys)


# Fixed value: hierarchy name of a deleted row.
TOMBSTONE = "DELETED"


def delete_hierarchies(stored: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Append a tombstone version for the given keys."""
    from starloom.operators.versioned import latest_by_key, next_versions

    current = latest_by_key(stored, keys, "version").join(doomed.select(*keys), keys, "left_semi")
    return next_versions(stored, current.withColumn("hierarchy_name", F.lit(TOMBSTONE)), keys)


def current_hierarchies(stored: DataFrame, keys: list[str]) -> DataFrame:
    from starloom.operators.versioned import latest_by_key

    return latest_by_key(stored, keys, "version").where(F.col("hierarchy_name") != TOMBSTONE)
