"""Dimensional model, star tables and wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import IS_MEASURE, RENAMES, STAR_SCHEMA, check, erd_cte, silver
from checks.hierarchy_checks import LEVELS, S1
from checks.relate_checks import overlap_sql
from starloom.operators import calendar as cal
from starloom.operators import hierarchy, model, profile, relate
from starloom.plans.star import Gold, assemble_gold, wide_table
from starloom.session import cut_lineage


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ERD table rows, hierarchy rows, structure) of the silver tables."""
    stats = cut_lineage(profile.column_statistics(silver(spark, sf_dir, S1)))  # a stored profile
    found = profile.erd_rules(stats)
    levels = hierarchy.hierarchy_levels(hierarchy.dimension_columns(stats))
    return profile.table_types(found), hierarchy.hierarchy_rows(levels), stats.select("table_name", "column_name", "position", "type_name")


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.recommend(*parts(spark, sf_dir))


# The hierarchy CTEs read a second copy of the statistics.
BASE = f"""{erd_cte(renamed=True, suffix=S1)}, {LEVELS[LEVELS.index('dims AS'):]},
 cols AS (SELECT table_name, column_name, position, type_name, ({IS_MEASURE}) AS measure FROM stats),
 facts AS (SELECT 'fact' AS table_type, 'fact' || row_number() OVER (ORDER BY table_name) || '_fact' AS recommended_name, table_name AS source_table,
   coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (measure), '') AS fact_columns,
   coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (NOT measure), '') AS dimension_keys,
   string_agg(column_name, '|' ORDER BY column_name) AS columns, count(*) AS total_columns, 0 AS hierarchy_levels,
   CAST(NULL AS VARCHAR) AS root_column, CAST(NULL AS VARCHAR) AS leaf_column
   FROM cols WHERE table_name IN (SELECT table_name FROM typed WHERE table_type = 'fact') GROUP BY table_name),
 dims_ AS (SELECT 'dimension' AS table_type, 'dimension' || row_number() OVER (ORDER BY table_name) || '_dim' AS recommended_name, table_name AS source_table,
   '' AS fact_columns, '' AS dimension_keys,
   (SELECT string_agg(column_name, '|' ORDER BY column_name) FROM cols c WHERE c.table_name = h.table_name AND NOT measure) AS columns,
   (SELECT count(*) FROM cols c WHERE c.table_name = h.table_name AND NOT measure) AS total_columns,
   CAST(greatest(max(total_levels) - 2, 0) + 2 AS BIGINT) AS hierarchy_levels, max(column_name) FILTER (role = 'ROOT') AS root_column,
   max(column_name) FILTER (role = 'LEAF') AS leaf_column
   FROM levels h WHERE table_name NOT IN (SELECT source_table FROM facts) GROUP BY table_name)"""

SHOWN = ["table_type", "recommended_name", "source_table", "fact_columns", "dimension_keys", "columns", "total_columns",
         "hierarchy_levels", "root_column", "leaf_column"]


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN).withColumns({c: F.array_join(c, "|") for c in ("fact_columns", "dimension_keys", "columns")})


@check(
    "I1_latest_metadata",
    f"""WITH {BASE} SELECT 'erd' AS kind, table_name, '2024-02-02' AS analysis_timestamp, count(*) AS n FROM typed GROUP BY table_name
        UNION ALL SELECT 'hierarchy', table_name, '2024-02-02', 1 FROM levels GROUP BY table_name
        UNION ALL SELECT 'profile', table_name, NULL, count(*) FROM stats WHERE table_name <> 'region_stage1' GROUP BY table_name
        UNION ALL SELECT 'profile', 'region', NULL, count(*) FROM stats WHERE table_name = 'region_stage1'""",
)
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    erd, hierarchies, structure = parts(spark, sf_dir)

    def history(df: DataFrame) -> DataFrame:
        return df.withColumn("analysis_timestamp", F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-02-02"))))

    stored = history(erd).withColumn("schema_name", F.explode(F.array(F.lit("silver"), F.lit("gold"))))
    named = F.when(F.col("table_name") == "region_stage1", "region").otherwise(F.col("table_name"))
    stranger = structure.limit(1).withColumn("table_name", F.lit("stranger"))
    rows = structure.withColumn("table_name", named).unionByName(stranger).withColumnRenamed("table_name", "original_table_name")
    found = model.latest_metadata(stored, history(hierarchies), rows)
    out = [found[k].groupBy("table_name", "analysis_timestamp").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(label))
           for k, label in (("erd", "erd"), ("hierarchies", "hierarchy"))]
    prof = found["profile"].groupBy(F.col("original_table_name").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
    out.append(prof.withColumns({"kind": F.lit("profile"), "analysis_timestamp": F.lit(None).cast("string")}))
    return out[0].unionByName(out[1]).unionByName(out[2]).select("kind", "table_name", "analysis_timestamp", "n")


@check("I2_recommend_dimensions", f"WITH {BASE} SELECT * FROM dims_")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    erd, hierarchies, structure = parts(spark, sf_dir)
    facts = erd.where(F.col("table_type") == "fact").select("table_name")
    return shown(model.recommend_dimensions(hierarchies, structure, facts))


@check("I3_recommend_facts", f"WITH {BASE} SELECT * FROM facts")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    erd, _, structure = parts(spark, sf_dir)
    return shown(model.recommend_facts(erd, structure))


@check("I4_recommend", f"WITH {BASE} SELECT * FROM facts UNION ALL SELECT * FROM dims_")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(recommended(spark, sf_dir))


@check(
    "I4_recommendation_counts",
    f"WITH {BASE} SELECT (SELECT count(*) FROM facts) AS fact_tables, (SELECT count(*) FROM dims_) AS dimension_tables, "
    "(SELECT count(*) FROM facts) + (SELECT count(*) FROM dims_) AS total_recommendations",
)
def i4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.recommendation_counts(recommended(spark, sf_dir))


@check(
    "I5_rename_recommendation",
    f"""WITH {BASE} SELECT recommended_name, CASE WHEN recommended_name = 'fact2_fact' THEN 'items_fact' END AS final_name,
        CASE WHEN recommended_name = 'fact2_fact' THEN replace(columns, 'order_key', 'purchase_key') ELSE columns END AS columns,
        CASE WHEN recommended_name = 'fact2_fact' THEN replace(dimension_keys, 'order_key', 'purchase_key') ELSE dimension_keys END AS dimension_keys
        FROM (SELECT * FROM facts UNION ALL SELECT * FROM dims_)""",
)
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = model.rename_recommendation(recommended(spark, sf_dir), "fact2_fact", "items_fact", {"order_key": "purchase_key"})
    return renamed.select("recommended_name", "final_name", F.array_join("columns", "|").alias("columns"),
                          F.array_join("dimension_keys", "|").alias("dimension_keys"))


@check("I6_list_recommendations", f"WITH {BASE} SELECT table_type, recommended_name, source_table FROM facts")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.list_recommendations(recommended(spark, sf_dir), "fact").select("table_type", "recommended_name", "source_table")


LINE_COLUMNS = ", ".join(f"{c} AS {n}" for c, n in RENAMES["lineitem"].items() if n != "ship_date")


@check("I7_build_star_table", f"SELECT {LINE_COLUMNS}, strftime(l_shipdate, '%Y-%m-%d') AS ship_date FROM lineitem")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.rename_recommendation(recommended(spark, sf_dir), "fact2_fact", "items_fact")
    row = found.where(F.col("source_table") == "lineitem_stage1").first().asDict()
    built = model.build_star_table(silver(spark, sf_dir)["lineitem"], model.star_table_spec(row))
    return built.withColumn("ship_date", F.date_format("ship_date", "yyyy-MM-dd"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations with a final name each."""
    ending = F.when(F.col("table_type") == "fact", "_fact").otherwise("_dim")
    return cut_lineage(recommended(spark, sf_dir).withColumn("final_name", F.concat("original_table_name", ending)))


def gold_relationships(spark: SparkSession, sf_dir: str, recs: DataFrame) -> DataFrame:
    """Value overlaps of the silver tables under their gold names."""
    found = relate.join_candidates_by_overlap(silver(spark, sf_dir, S1), 0.7)
    names = recs.select("source_table", "final_name")
    for i in (1, 2):
        found = found.join(names.withColumnsRenamed({"source_table": f"table{i}", "final_name": f"_final{i}"}), f"table{i}")
    return found.withColumns({"table1": F.col("_final1"), "table2": F.col("_final2")})


GOLD = f"""{BASE}, {overlap_sql(renamed=True, suffix=S1).replace('conf >= 0.8', 'conf >= 0.7')},
 recs AS (SELECT *, replace(source_table, '_stage1', '') || CASE WHEN table_type = 'fact' THEN '_fact' ELSE '_dim' END AS final_name
   FROM (SELECT * FROM facts UNION ALL SELECT * FROM dims_)),
 links AS (SELECT a.final_name AS t1, column1 AS c1, b.final_name AS t2, column2 AS c2, round(CAST(conf AS DOUBLE), 4) AS conf
   FROM rel JOIN recs a ON a.source_table = table1 JOIN recs b ON b.source_table = table2),
 value_keys AS (SELECT * FROM (SELECT t1 AS fact, t2 AS dim, c1 AS fact_column, c2 AS dim_column, conf FROM links UNION ALL SELECT t2, t1, c2, c1, conf FROM links)
   WHERE conf > 0.7 AND fact IN (SELECT final_name FROM recs WHERE table_type = 'fact') AND dim IN (SELECT final_name FROM recs WHERE table_type = 'dimension')
   QUALIFY row_number() OVER (PARTITION BY fact, dim ORDER BY conf DESC, fact_column, dim_column) = 1)"""

NAMED_KEYS = f"""{BASE}, recs AS (SELECT *, replace(source_table, '_stage1', '') || CASE WHEN table_type = 'fact' THEN '_fact' ELSE '_dim' END AS final_name
   FROM (SELECT * FROM facts UNION ALL SELECT * FROM dims_)),
 d AS (SELECT final_name AS dim, root_column, replace(final_name, '_dim', '') AS stem,
   CASE WHEN list_contains(string_split(columns, '|'), root_column) THEN root_column ELSE string_split(columns, '|')[1] END AS dim_key FROM recs WHERE table_type = 'dimension'),
 keys AS (SELECT DISTINCT dim, root_column, unnest([root_column, stem || '_key', stem || '_id', stem]) AS key FROM d),
 first_keys AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN key = root_column THEN 0 ELSE 1 END, dim) = 1),
 wanted AS (SELECT final_name AS fact, unnest(string_split(dimension_keys, '|')) AS key FROM recs WHERE table_type = 'fact'),
 by_name AS (SELECT DISTINCT fact, dim FROM wanted JOIN first_keys USING (key)),
 left_over AS (SELECT final_name AS fact FROM recs WHERE table_type = 'fact' AND final_name NOT IN (SELECT fact FROM by_name)),
 fc AS (SELECT final_name AS fact, unnest(string_split(columns, '|')) AS col, unnest(range(len(string_split(columns, '|')))) AS pos FROM recs WHERE table_type = 'fact'),
 cand AS (SELECT fact, dim, col AS fact_column, dim_key AS dim_column FROM fc JOIN d ON col = dim_key OR col = root_column OR starts_with(lower(col), stem)
   QUALIFY row_number() OVER (PARTITION BY fact, dim ORDER BY pos) = 1)"""


@check("I8_choose_join_key", f"WITH {GOLD} SELECT fact, dim, fact_column, dim_column, 'relationship' AS rule FROM value_keys")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = named(spark, sf_dir)
    return model.choose_join_keys(recs, gold_relationships(spark, sf_dir, recs))


@check(
    "I8_choose_join_key_by_name",
    f"""WITH {NAMED_KEYS} SELECT c.*, 'name' AS rule FROM cand c WHERE (fact, dim) IN (SELECT (fact, dim) FROM by_name) OR fact IN (SELECT fact FROM left_over)""",
)
def i8_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = named(spark, sf_dir)
    nothing = gold_relationships(spark, sf_dir, recs).where(F.col("join_confidence") > 2)
    return model.choose_join_keys(recs, nothing)


@check(
    "I9_related_dimensions",
    f"WITH {NAMED_KEYS} SELECT fact, dim, 'key_name' AS via FROM by_name UNION ALL SELECT fact, NULL, 'any' FROM left_over",
)
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = named(spark, sf_dir)
    return model.related_dimensions(recs, gold_relationships(spark, sf_dir, recs).where(F.col("join_confidence") > 2))


@check("I9_related_by_relationship", f"WITH {GOLD} SELECT fact, dim, 'relationship' AS via FROM value_keys")
def i9_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = named(spark, sf_dir)
    return model.related_dimensions(recs, gold_relationships(spark, sf_dir, recs))


def prefixed(tab: str, name: str) -> str:
    return ", ".join(f"{tab}.{c} AS {name}_{n}" for c, n in RENAMES[tab].items() if STAR_SCHEMA[tab][c] != "DateTime")


@check(
    "I10_k_table",
    f"""SELECT {LINE_COLUMNS}, {prefixed('part', 'part_dim')}, {prefixed('supplier', 'supplier_dim')}, {prefixed('orders', 'orders_dim')}
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = silver(spark, sf_dir)
    wide = wide_table(tables["lineitem"], {
        "part_dim": (tables["part"], "part_key", "part_key"),
        "supplier_dim": (tables["supplier"], "supplier_key", "supplier_key"),
        "orders_dim": (tables["orders"], "order_key", "order_key"),
    })
    return wide.drop("ship_date", "orders_dim_order_date")


@check(
    "I10_k_table_report",
    """SELECT p_brand AS brand, r_name AS region, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def i10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = silver(spark, sf_dir)
    wide = wide_table(tables["lineitem"], {
        "part": (tables["part"], "part_key", "part_key"), "supplier": (tables["supplier"], "supplier_key", "supplier_key"),
        "nation": (tables["nation"], "supplier_nation_key", "nation_key"), "region": (tables["region"], "nation_region_key", "region_key"),
    })
    return wide.groupBy(F.col("part_part_brand").alias("brand"), F.col("region_region_name").alias("region")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("sales_amount") * (1 - F.col("discount"))), 2).alias("revenue")
    )


def gold(spark: SparkSession, sf_dir: str) -> Gold:
    """Star and wide tables of the silver tables, from recommendations and value overlaps alone."""
    recs = named(spark, sf_dir)
    return assemble_gold(silver(spark, sf_dir, S1), recs, gold_relationships(spark, sf_dir, recs))


@check(
    "I10_gold_left_out",
    f"""WITH {GOLD} SELECT * FROM (SELECT f.final_name AS fact, d.final_name AS dim,
          CASE WHEN k.dim_column IS NULL THEN 'no join key' WHEN s.cardinality < s.row_count - s.null_count THEN 'key repeats' END AS reason
        FROM recs f JOIN recs d ON f.table_type = 'fact' AND d.table_type = 'dimension'
        LEFT JOIN value_keys k ON k.fact = f.final_name AND k.dim = d.final_name
        LEFT JOIN stats s ON s.table_name = d.source_table AND s.column_name = k.dim_column) WHERE reason IS NOT NULL""",
)
def i10_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).left_out


@check(
    "I10_gold_wide_rows",
    """SELECT 'customer_k' AS wide, count(*) AS n FROM customer UNION ALL SELECT 'lineitem_k', count(*) FROM lineitem
       UNION ALL SELECT 'nation_k', count(*) FROM nation UNION ALL SELECT 'supplier_k', count(*) FROM supplier""",
)
def i10_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [df.select(F.lit(name).alias("wide")) for name, df in gold(spark, sf_dir).wide.items()]
    return reduce(DataFrame.unionByName, counts).groupBy("wide").agg(F.count(F.lit(1)).alias("n"))


@check(
    "I11_one_big_table",
    """SELECT l_orderkey AS order_key, l_linenumber AS line_num, strftime(l_shipdate, '%Y-%m') AS calendar_year_month, s_name AS supplier_name, p_name AS part_name
       FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""",
)
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = silver(spark, sf_dir)
    days = cal.calendar(cal.days_of(tables["lineitem"], "ship_date"))
    wide = model.one_big_table(
        tables["lineitem"],
        [model.DimensionJoin(name, tables[name], f"{name}_key", f"{name}_key") for name in ("supplier", "part")], "ship_date", days,
    )
    return wide.select("order_key", "line_num", "calendar_year_month", "supplier_name", "part_name")
