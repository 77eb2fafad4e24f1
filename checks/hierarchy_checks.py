"""Hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import IS_MEASURE, catalog_cte, check, silver, stats_cte
from starloom.functions.names import name_similarity
from starloom.operators import hierarchy, profile
from starloom.session import cut_lineage

S1 = "_stage1"
LEVELS = f"""{stats_cte(renamed=True, suffix=S1)},
 dims AS (SELECT table_name, column_name, position, type_name AS data_type, cardinality, null_count FROM stats
   WHERE NOT ({IS_MEASURE}) AND cardinality >= 2),
 levels AS (SELECT *, CASE WHEN level = 0 THEN 'ROOT' WHEN level = total_levels - 1 THEN 'LEAF' ELSE 'INTERMEDIATE' END AS role FROM
   (SELECT *, row_number() OVER w - 1 AS level, count(*) OVER (PARTITION BY table_name) AS total_levels,
     lag(column_name) OVER w AS parent, lead(column_name) OVER w AS child FROM dims WINDOW w AS (PARTITION BY table_name ORDER BY cardinality, position))
   WHERE total_levels >= 2)"""

JACCARD = """(len(list_intersect(list_distinct(string_split({a}, '_')), list_distinct(string_split({b}, '_')))) * 1.0
 / len(list_distinct(list_concat(string_split({a}, '_'), string_split({b}, '_')))))"""


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.dimension_columns(profile.column_statistics(silver(spark, sf_dir, S1)))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_levels(dims(spark, sf_dir))


@check("H1_dimension_columns", f"WITH {LEVELS} SELECT * FROM dims")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(spark, sf_dir)


@check("H2_hierarchy_levels", f"WITH {LEVELS} SELECT table_name, column_name, cardinality, level, total_levels, role FROM levels")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).select("table_name", "column_name", "cardinality", "level", "total_levels", "role")


@check("H3_parent_child", f"WITH {LEVELS} SELECT table_name, column_name AS parent, child, level AS parent_level FROM levels WHERE child IS NOT NULL")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.parent_child(levels(spark, sf_dir))


SIBLINGS = f"""sib AS (SELECT a.table_name, a.column_name, a.cardinality, a.level, b.column_name AS sibling, b.cardinality AS sibling_cardinality,
  b.level AS sibling_level, {JACCARD.format(a='a.column_name', b='b.column_name')} AS sim FROM levels a JOIN levels b
  ON a.table_name = b.table_name AND length(CAST(a.cardinality AS VARCHAR)) = length(CAST(b.cardinality AS VARCHAR)) AND a.column_name <> b.column_name),
 siblings AS (SELECT * FROM sib WHERE sim > 0.3)"""


@check("H4_siblings", f"WITH {LEVELS}, {SIBLINGS} SELECT table_name, column_name, sibling, sibling_cardinality, round(sim, 6) AS name_similarity FROM siblings")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.siblings(levels(spark, sf_dir)).select(
        "table_name", "column_name", "sibling", "sibling_cardinality", F.round("name_similarity", 6).alias("name_similarity")
    )


@check(
    "H5_name_similarity",
    f"""WITH {LEVELS} SELECT a.table_name AS table1, a.column_name AS column1, b.table_name AS table2, b.column_name AS column2,
        round({JACCARD.format(a='a.column_name', b='b.column_name')}, 6) AS similarity FROM dims a JOIN dims b
        ON a.position = b.position AND a.table_name < b.table_name""",
)
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = dims(spark, sf_dir).select("position", "table_name", "column_name")
    one = cols.withColumnsRenamed({"table_name": "table1", "column_name": "column1"})
    two = cols.withColumnsRenamed({"table_name": "table2", "column_name": "column2"})
    return one.join(two, "position").where("table1 < table2").select(
        "table1", "column1", "table2", "column2", F.round(name_similarity(F.col("column1"), F.col("column2")), 6).alias("similarity")
    )


LINKS = """links AS (SELECT a.table_name AS table1, a.column_name AS column1, b.table_name AS table2, b.column_name AS column2,
  a.level AS level1, b.level AS level2, a.role AS role1, b.role AS role2,
  least(a.cardinality, b.cardinality) * 1.0 / greatest(a.cardinality, b.cardinality) AS sim,
  least(1.0, 0.4 + CASE WHEN a.data_type = b.data_type THEN 0.2 ELSE 0 END + 0.2 * least(a.cardinality, b.cardinality) / greatest(a.cardinality, b.cardinality)
   + CASE abs(a.level - b.level) WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0 END + CASE WHEN a.role = b.role THEN 0.1 ELSE 0 END) AS conf
  FROM levels a JOIN levels b ON a.column_name = b.column_name AND a.table_name < b.table_name)"""


@check(
    "H6_cross_hierarchy_links",
    f"""WITH {LEVELS}, {LINKS} SELECT table1, column1, table2, column2, level1, level2, role1, role2, CAST(1.0 AS DOUBLE) AS name_similarity,
        round(CAST(sim AS DOUBLE), 6) AS cardinality_similarity FROM links""",
)
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.cross_hierarchy_links(levels(spark, sf_dir))
    return found.select("table1", "column1", "table2", "column2", "level1", "level2", "role1", "role2", "name_similarity",
                        F.round("cardinality_similarity", 6).alias("cardinality_similarity"))


@check(
    "H7_cross_confidence",
    f"WITH {LEVELS}, {LINKS} SELECT table1, column1, table2, column2, round(CAST(conf AS DOUBLE), 6) AS relationship_confidence FROM links WHERE conf >= 0.5",
)
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.cross_hierarchy_links(levels(spark, sf_dir), hierarchy.CROSS_MINIMUM)
    return found.select("table1", "column1", "table2", "column2", F.round("relationship_confidence", 6).alias("relationship_confidence"))


@check(
    "H8_hierarchy_summary",
    f"""WITH {LEVELS}, {LINKS} SELECT count(DISTINCT table_name) AS tables_with_hierarchies, max(total_levels) AS max_hierarchy_depth,
        count(*) FILTER (role = 'ROOT') AS root_nodes, count(*) FILTER (role = 'LEAF') AS leaf_nodes,
        (SELECT count(*) FROM links WHERE conf > 0.7) AS high_confidence_cross_relationships FROM levels""",
)
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels(spark, sf_dir)
    return hierarchy.hierarchy_summary(found, hierarchy.cross_hierarchy_links(found))


HIERARCHY_ROWS = f"""{SIBLINGS}, {LINKS}, hrows AS (SELECT table_name, max(total_levels) AS total_levels, max(column_name) FILTER (role = 'ROOT') AS root_column,
   max(cardinality) FILTER (role = 'ROOT') AS root_cardinality, max(column_name) FILTER (role = 'LEAF') AS leaf_column,
   max(cardinality) FILTER (role = 'LEAF') AS leaf_cardinality,
   coalesce(string_agg(column_name, '|' ORDER BY level) FILTER (role = 'INTERMEDIATE'), '') AS intermediate_levels,
   string_agg(column_name || ' -> ' || child, '|' ORDER BY level) FILTER (child IS NOT NULL) AS parent_child_relationships,
   table_name || '_hierarchy' AS hierarchy_name, replace(table_name, '_stage1', '') AS original_table_name
   FROM levels GROUP BY table_name)"""
ARRAYS = ["intermediate_levels", "parent_child_relationships", "sibling_relationships", "cross_hierarchy_relationships"]


@check(
    "H9_hierarchy_rows",
    f"""WITH {LEVELS}, {HIERARCHY_ROWS} SELECT *,
        coalesce((SELECT string_agg(column_name || ' <-> ' || sibling, '|' ORDER BY level, sibling_level) FROM siblings s WHERE s.table_name = h.table_name), '') AS sibling_relationships,
        coalesce((SELECT string_agg(table1 || '.' || column1 || ' <-> ' || table2 || '.' || column2, '|' ORDER BY table1 || '.' || column1 || ' <-> ' || table2 || '.' || column2)
          FROM links WHERE table1 = h.table_name OR table2 = h.table_name), '') AS cross_hierarchy_relationships FROM hrows h""",
)
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy.hierarchy_rows(levels(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, "|") for c in ARRAYS})


@check(
    "H10_levels_from_profile",
    f"""WITH {catalog_cte(renamed=True)} SELECT table_name, column_name, cardinality, null_count, row_number() OVER w - 1 AS level,
        first_value(column_name) OVER w AS root_column, last_value(column_name) OVER (PARTITION BY table_name ORDER BY cardinality, position
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS leaf_column, count(*) OVER (PARTITION BY table_name) AS total_levels
        FROM catalog WHERE classification = 'dimension' WINDOW w AS (PARTITION BY table_name ORDER BY cardinality, position)""",
)
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.levels_from_profile(profile.catalog_profile(silver(spark, sf_dir)))


@check(
    "H11_custom_hierarchy",
    f"""WITH {LEVELS}, r AS (SELECT table_name, list(column_name ORDER BY level DESC) AS l FROM levels WHERE table_name <> 'region_stage1' GROUP BY table_name)
        SELECT table_name, 'mine' AS hierarchy_name, l[1] AS root_column, l[len(l)] AS leaf_column,
        array_to_string(l[2:len(l) - 1], '|') AS intermediate_levels, len(l) AS total_levels FROM r""",
)
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels(spark, sf_dir)
    ordered = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("level", "column_name")))), lambda e: e["column_name"])
    requests = found.groupBy("table_name").agg(ordered.alias("levels")).withColumn("hierarchy_name", F.lit("mine"))
    known = found.where(F.col("table_name") != "region_stage1")
    return hierarchy.custom_hierarchy(requests, known).select(
        "table_name", "hierarchy_name", "root_column", "leaf_column", F.array_join("intermediate_levels", "|").alias("intermediate_levels"), "total_levels"
    )


@check(
    "H12_hierarchy_edits",
    f"""WITH {LEVELS}, {HIERARCHY_ROWS} SELECT table_name, CASE WHEN table_name = 'part_stage1' THEN 'products' ELSE hierarchy_name END AS hierarchy_name,
        root_column, CASE WHEN table_name = 'part_stage1' THEN 2 ELSE 1 END AS version FROM hrows WHERE table_name <> 'orders_stage1'""",
)
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["table_name"]
    stored = cut_lineage(hierarchy.hierarchy_rows(levels(spark, sf_dir)).select("table_name", "hierarchy_name", "root_column")
                         .withColumn("version", F.lit(1).cast("bigint")))
    edits = stored.where(F.col("table_name") == "part_stage1").select(
        "table_name", F.lit("products").alias("hierarchy_name"), F.lit(None).cast("string").alias("root_column"))
    edited = hierarchy.edit_hierarchies(stored, edits, key)
    deleted = hierarchy.delete_hierarchies(edited, stored.where(F.col("table_name") == "orders_stage1").select("table_name"), key)
    return hierarchy.current_hierarchies(deleted, key)
