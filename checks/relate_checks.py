"""Relationship discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import RENAMES, STAR_SCHEMA, catalog_cte, check, erd_cte, silver, star, table
from starloom.functions.names import type_family, types_compatible
from starloom.operators import profile, relate
from starloom.session import cut_lineage

PAIR = relate.PAIR_KEY


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.catalog_profile(silver(spark, sf_dir))


# Key candidates by uniqueness: the 80 % rule finds no numeric key, so names are matched on this profile.
def erd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.erd_profile(silver(spark, sf_dir))


COMPATIBLE = """(lower(a.type_name) = lower(b.type_name) OR (lower(a.type_name) IN ('int32', 'int64', 'float64')
 AND lower(b.type_name) IN ('int32', 'int64', 'float64')))"""

BY_NAME = f"""named AS (SELECT a.table_name AS table1, a.column_name AS column1, b.table_name AS table2, b.column_name AS column2,
  a.type_name AS type1, b.type_name AS type2, a.cardinality AS cardinality1, b.cardinality AS cardinality2, a.is_pk AS is_pk1, b.is_pk AS is_pk2,
  least(1.0, 0.5 + CASE WHEN a.is_pk AND b.is_pk THEN 0.3 WHEN a.is_pk OR b.is_pk THEN 0.15 ELSE 0 END
   + CASE WHEN a.cardinality > 0 AND b.cardinality > 0 THEN 0.2 * least(a.cardinality, b.cardinality) / greatest(a.cardinality, b.cardinality) ELSE 0 END) AS confidence
  FROM erd a JOIN erd b ON lower(a.column_name) = lower(b.column_name) AND a.table_name < b.table_name WHERE {COMPATIBLE})"""
NAMED = f"WITH {erd_cte(renamed=True)}, {BY_NAME}"


@check("G1_pk_list", f"WITH {catalog_cte(renamed=True)} SELECT table_name, column_name FROM catalog WHERE is_pk")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.primary_keys(catalog(spark, sf_dir)).select("table_name", "column_name")


@check(
    "G2_types_compatible",
    f"""WITH {catalog_cte(renamed=True)} SELECT a.table_name AS table1, a.column_name AS column1, b.table_name AS table2, b.column_name AS column2,
        {COMPATIBLE} AS compatible FROM catalog a JOIN catalog b ON a.position = b.position AND a.table_name < b.table_name""",
)
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = catalog(spark, sf_dir).select("position", "table_name", "column_name", "type_name")
    a, b = cols.alias("a"), cols.alias("b")
    pairs = a.join(b, F.col("a.position") == F.col("b.position")).where(F.col("a.table_name") < F.col("b.table_name"))
    return pairs.select(
        F.col("a.table_name").alias("table1"), F.col("a.column_name").alias("column1"), F.col("b.table_name").alias("table2"),
        F.col("b.column_name").alias("column2"), types_compatible(F.col("a.type_name"), F.col("b.type_name")).alias("compatible"),
    )


@check("G3_join_candidates_by_name", f"{NAMED} SELECT table1, column1, table2, column2, type1, type2, cardinality1, cardinality2, is_pk1, is_pk2 FROM named")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relate.join_candidates_by_name(erd(spark, sf_dir))
    return found.select(*PAIR, "type1", "type2", "cardinality1", "cardinality2", "is_pk1", "is_pk2")


@check("G4_join_confidence", f"{NAMED} SELECT table1, column1, table2, column2, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM named")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.join_candidates_by_name(erd(spark, sf_dir)).select(*PAIR, F.round("confidence", 6).alias("confidence"))


@check(
    "G5_relationship_type_by_pk",
    f"""{NAMED} SELECT table1, column1, table2, column2,
        CASE WHEN is_pk1 AND is_pk2 THEN 'many_to_many' WHEN is_pk1 OR is_pk2 THEN 'one_to_many' ELSE 'many_to_many' END AS by_name,
        CASE WHEN is_pk1 AND is_pk2 THEN 'one_to_one' WHEN is_pk1 OR is_pk2 THEN 'one_to_many' ELSE 'many_to_many' END AS typed FROM named""",
)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relate.join_candidates_by_name(erd(spark, sf_dir))
    return pairs.select(
        *PAIR, relate.relationship_type_by_pk().alias("by_name"), relate.relationship_type_by_pk("one_to_one").alias("typed")
    )


FK_SQL = """SELECT CASE WHEN is_pk1 AND NOT is_pk2 THEN table2 ELSE table1 END AS foreign_key_table,
  CASE WHEN is_pk1 AND NOT is_pk2 THEN column2 ELSE column1 END AS foreign_key_column,
  CASE WHEN is_pk1 AND NOT is_pk2 THEN table1 ELSE table2 END AS referenced_table,
  CASE WHEN is_pk1 AND NOT is_pk2 THEN column1 ELSE column2 END AS referenced_column,
  CASE WHEN is_pk1 AND is_pk2 THEN 'many_to_many' ELSE 'one_to_many' END AS relationship_type
  FROM named WHERE confidence > 0.7 AND (is_pk1 OR is_pk2)"""


@check("G6_foreign_key_candidates", f"{NAMED} {FK_SQL}")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.foreign_key_candidates(relate.join_candidates_by_name(erd(spark, sf_dir))).drop("confidence")


@check(
    "G7_relationship_report",
    f"""{NAMED} SELECT count(*) AS join_candidates, count(*) FILTER (confidence > 0.7) AS high_confidence_joins,
        count(*) FILTER (confidence > 0.7 AND (is_pk1 OR is_pk2)) AS foreign_key_candidates FROM named""",
)
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.relationship_report(relate.join_candidates_by_name(erd(spark, sf_dir)))


@check(
    "G7_relationship_list",
    f"""{NAMED} SELECT 'join' AS kind, table1, column1, table2, column2 FROM named UNION ALL
        SELECT 'foreign_key', foreign_key_table, foreign_key_column, referenced_table, referenced_column FROM ({FK_SQL})""",
)
def g7_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.relationship_list(relate.join_candidates_by_name(erd(spark, sf_dir))).select("kind", *PAIR)


def overlap_cte(tables: list[str] | None = None, renamed: bool = False, suffix: str = "") -> str:
    """Distinct text of every column, and shared values of every compatible pair of different tables."""
    parts, position = [], 0
    for tab in STAR_SCHEMA:
        for column, kind in STAR_SCHEMA[tab].items():
            shown = column if kind == "String" else f"CAST({column} AS VARCHAR)"
            if kind == "DateTime":
                shown = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
            if kind == "Float64":  # whole numbers look alike whatever their type
                shown = f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"
            if tables is None or tab in tables:
                parts.append(
                    f"SELECT DISTINCT {position} AS cid, '{tab}{suffix}' AS table_name, "
                    f"'{RENAMES[tab][column] if renamed else column}' AS column_name, "
                    f"'{type_family(kind)}' AS family, {shown} AS value FROM {tab} WHERE {column} IS NOT NULL"
                )
                position += 1
    return "vals AS MATERIALIZED (" + " UNION ALL ".join(parts) + """),
     card AS MATERIALIZED (SELECT cid, table_name, column_name, count(*) AS cardinality FROM vals GROUP BY ALL),
     shared AS MATERIALIZED (SELECT a.cid AS cid1, b.cid AS cid2, count(*) AS overlap_count FROM vals a JOIN vals b
       ON a.family = b.family AND a.value = b.value AND a.cid < b.cid AND a.table_name <> b.table_name GROUP BY ALL)"""


def overlap_sql(tables: list[str] | None = None, renamed: bool = False, suffix: str = "") -> str:
    return f"""{overlap_cte(tables, renamed, suffix)}, linked AS MATERIALIZED (SELECT p.table_name AS table1, p.column_name AS column1, q.table_name AS table2,
      q.column_name AS column2, p.cardinality AS cardinality1, q.cardinality AS cardinality2, x.is_pk AS is_pk1, y.is_pk AS is_pk2,
      x.classification AS classification1, y.classification AS classification2,
      overlap_count, overlap_count * 1.0 / least(p.cardinality, q.cardinality) AS conf
      FROM shared JOIN card p ON p.cid = cid1 JOIN card q ON q.cid = cid2
      JOIN erd x ON x.table_name = p.table_name AND x.column_name = p.column_name
      JOIN erd y ON y.table_name = q.table_name AND y.column_name = q.column_name
      WHERE p.cardinality >= 2 AND q.cardinality >= 2),
     rel AS (SELECT *, CASE WHEN overlap_count <> least(cardinality1, cardinality2) THEN 'many_to_many'
       WHEN is_pk1 AND is_pk2 THEN 'one_to_one' ELSE 'one_to_many' END AS relationship_type FROM linked WHERE conf >= 0.8)"""


SHOWN = "table1, column1, table2, column2, cardinality1, cardinality2, overlap_count"
OVERLAP_COLUMNS = [*PAIR, "cardinality1", "cardinality2", "overlap_count"]


@check(
    "G8_join_candidates_by_overlap",
    f"""WITH {erd_cte()}, {overlap_sql()} SELECT {SHOWN}, is_pk1, is_pk2, classification1, classification2,
        round(CAST(conf * 100 AS DOUBLE), 2) AS overlap_percentage, round(CAST(conf AS DOUBLE), 4) AS join_confidence FROM rel""",
)
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relate.join_candidates_by_overlap(star(spark, sf_dir))
    return found.select(*OVERLAP_COLUMNS, "is_pk1", "is_pk2", "classification1", "classification2", "overlap_percentage", "join_confidence")


@check(
    "G8_integer_meets_double",
    """SELECT 'parts' AS table1, 'whole' AS column1, 'sizes' AS table2, 'real' AS column2, count(DISTINCT p_size) AS overlap_count FROM part
       HAVING count(DISTINCT p_size) > 1""",
)
def g8_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part")
    tables = {"parts": size.select(F.col("p_size").cast("bigint").alias("whole")), "sizes": size.select(F.col("p_size").cast("double").alias("real"))}
    return relate.join_candidates_by_overlap(tables).select(*PAIR, "overlap_count")


@check(
    "G8_value_overlaps",
    f"WITH {overlap_cte()} SELECT cid1, cid2, overlap_count FROM shared",
)
def g8_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star(spark, sf_dir)
    _, pairs = relate.value_overlaps(tables)
    owner = profile.column_catalog(tables).select("cid", "table_name")
    one = owner.withColumnsRenamed({"cid": "cid1", "table_name": "t1"})
    two = owner.withColumnsRenamed({"cid": "cid2", "table_name": "t2"})
    return pairs.join(one, "cid1").join(two, "cid2").where("t1 <> t2").select("cid1", "cid2", "overlap_count")


@check("G9_relationship_type_by_data", f"WITH {erd_cte()}, {overlap_sql()} SELECT table1, column1, table2, column2, relationship_type FROM rel")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.join_candidates_by_overlap(star(spark, sf_dir)).select(*PAIR, "relationship_type")


@check(
    "G10_analyze_erd",
    f"""WITH {erd_cte()}, {overlap_sql()} SELECT (SELECT count(*) FROM typed) AS total_tables,
        (SELECT count(*) FROM typed WHERE table_type = 'fact') AS fact_tables, (SELECT count(*) FROM typed WHERE table_type = 'dimension') AS dimension_tables,
        (SELECT count(*) FROM erd WHERE is_pk) AS primary_key_candidates, (SELECT count(*) FROM rel) AS total_relationships,
        (SELECT count(*) FROM rel WHERE conf > 0.7) AS high_confidence_relationships""",
)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.analyze_erd(star(spark, sf_dir))["summary"]


@check(
    "G11_erd_table_rows",
    f"""WITH {erd_cte()}, {overlap_sql()}, links AS (SELECT table1 AS t, table1 || '.' || column1 || ' = ' || table2 || '.' || column2 AS link FROM rel
          UNION ALL SELECT table2, table1 || '.' || column1 || ' = ' || table2 || '.' || column2 FROM rel),
        cols AS (SELECT table_name, coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (is_pk), '') AS primary_key_candidates,
          coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (classification = 'fact'), '') AS fact_columns,
          coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (classification = 'dimension'), '') AS dimension_columns FROM erd GROUP BY table_name)
        SELECT table_name, table_type, row_count, column_count, primary_key_candidates, c.fact_columns, c.dimension_columns,
          coalesce((SELECT string_agg(link, '|' ORDER BY link) FROM links WHERE t = table_name), '') AS relationships, 'silver' AS schema_name
        FROM typed JOIN cols c USING (table_name)""",
)
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relate.analyze_erd(star(spark, sf_dir))["tables"]
    return rows.withColumns(
        {c: F.array_join(c, "|") for c in ("primary_key_candidates", "fact_columns", "dimension_columns", "relationships")}
    )


@check(
    "G12_adjacent_cardinality_links",
    f"""WITH {catalog_cte(renamed=True)}, ordered AS (SELECT table_name, column_name AS column1, cardinality AS parent_cardinality,
          lead(column_name) OVER w AS column2, lead(cardinality) OVER w AS child_cardinality FROM catalog WHERE classification = 'dimension'
          WINDOW w AS (PARTITION BY table_name ORDER BY cardinality, position))
        SELECT table_name, column1, column2, 'hierarchy' AS relationship_type, round(least(parent_cardinality, child_cardinality) * 1.0
          / greatest(parent_cardinality, child_cardinality), 6) AS confidence, parent_cardinality, child_cardinality
        FROM ordered WHERE column2 IS NOT NULL AND least(parent_cardinality, child_cardinality) * 1.0 / greatest(parent_cardinality, child_cardinality) >= 0.5
        ORDER BY confidence DESC, table_name, column1 LIMIT 100""",
)
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.adjacent_cardinality_links(catalog(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@check(
    "G13_common_column_links",
    f"""WITH {catalog_cte(renamed=True)} SELECT a.table_name AS table1, b.table_name AS table2,
        string_agg(a.column_name, '|' ORDER BY a.column_name) AS columns, 'one_to_many' AS relationship_type, CAST(0.7 AS DOUBLE) AS confidence
        FROM catalog a JOIN catalog b ON a.column_name = b.column_name AND a.table_name < b.table_name GROUP BY 1, 2""",
)
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.common_column_links(catalog(spark, sf_dir)).withColumn("columns", F.array_join("columns", "|"))


@check(
    "G14_validate_relationships",
    f"""{NAMED}, used AS (SELECT table1 AS t FROM named UNION SELECT table2 FROM named)
        SELECT 'error' AS severity, 'missing_entity' AS finding, t AS table_name FROM used WHERE t IN ('supplier', 'customer')
        UNION ALL SELECT 'warning', 'orphaned_entity', table_name FROM (SELECT DISTINCT table_name FROM erd UNION SELECT 'events')
          WHERE table_name NOT IN (SELECT t FROM used) AND table_name NOT IN ('supplier', 'customer')""",
)
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = erd(spark, sf_dir)
    extra = table(spark, sf_dir, "events").select(F.lit("events").alias("table_name")).distinct()
    entities = found.select("table_name").where(~F.col("table_name").isin("supplier", "customer")).unionByName(extra)
    return relate.validate_relationships(entities, relate.join_candidates_by_name(found))


@check(
    "G15_relationship_edits",
    f"""{NAMED} SELECT table1, column1, table2, column2,
        CASE WHEN column1 = 'order_key' THEN 1.0 ELSE round(CAST(confidence AS DOUBLE), 6) END AS confidence,
        CASE WHEN column1 = 'order_key' THEN 2 ELSE 1 END AS version FROM named WHERE column1 <> 'nation_key'""",
)
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut_lineage(relate.join_candidates_by_name(erd(spark, sf_dir)).select(*PAIR, "confidence", "relationship_type"))
    stored = links.withColumns({"version": F.lit(1).cast("bigint"), "removed": F.lit(False)})
    edits = links.where(F.col("column1").isin("nation_key", "order_key")).withColumns(
        {"confidence": F.lit(1.0), "action": F.when(F.col("column1") == "nation_key", "remove").otherwise("set")}
    )
    current = relate.current_relationships(relate.edit_relationships(stored, edits))
    return current.select(*PAIR, F.round("confidence", 6).alias("confidence"), "version")
