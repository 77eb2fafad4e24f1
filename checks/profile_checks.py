"""Profiling and quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.common import (
    CLASS_BY_TYPE, CLASS_ERD, IS_MEASURE, NULL_PCT, PK_UNIQUE, QUALITY_CATALOG, QUALITY_ERD, QUALITY_TABLE, RATIO,
    ORACLE, STAMP, STAR_SCHEMA, catalog_cte, check, erd_cte, joined, long_cte, silver, star, stats_cte, table, text_of,
)
from checks.infer_checks import inferred_cte
from starloom.functions.names import is_measure
from starloom.operators import profile, profile_state, quality
from starloom.session import scratch_path
from starloom.sources.ingest import land

KEY = ["table_name", "column_name"]


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_statistics(star(spark, sf_dir))


@check(
    "E1_row_and_column_count",
    f"WITH {stats_cte()} SELECT table_name, max(row_count) AS row_count, count(*) AS column_count FROM stats GROUP BY table_name",
)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )


@check("E2_cardinality", f"WITH {stats_cte()} SELECT table_name, column_name, cardinality FROM stats")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select(*KEY, "cardinality")


def holed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """events with NULL and blank values."""
    kind = F.col("event_type")
    return {
        "events": table(spark, sf_dir, "events").select(
            "event_id", F.when(kind != "error", F.col("value")).alias("value"),
            F.when(kind == "view", "").when(kind != "click", kind).alias("kind"),
        )
    }


HOLED = """(SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
 CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'click' THEN event_type END AS kind FROM events)"""


def holed_sql(count: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'events' AS table_name, '{c}' AS column_name, {count.format(c=c, t=f'CAST({c} AS VARCHAR)')} AS n FROM {HOLED}"
        for c in ("event_id", "value", "kind")
    )


@check("E3_null_count", holed_sql("count(*) - count({c})"))
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_statistics(holed(spark, sf_dir)).select(*KEY, F.col("null_count").alias("n"))


@check("E4_blank_or_null_count", holed_sql("count(*) FILTER ({c} IS NULL OR {t} = '')"))
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = profile.column_statistics(holed(spark, sf_dir))
    return counts.select(*KEY, (F.col("null_count") + F.col("blank_count")).alias("n"))


@check(
    "E5_sample_values",
    f"""WITH {long_cte(['customer', 'part', 'orders'])} SELECT table_name, column_name, string_agg(value, '|' ORDER BY value) AS sample_values FROM
        (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank FROM cells WHERE value <> '')
        WHERE rank <= 5 GROUP BY ALL""",
)
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: df for n, df in star(spark, sf_dir).items() if n in ("customer", "part", "orders")}
    return profile.sample_values(tables).select(*KEY, joined("sample_values"))


def rule(name: str, sql: str, build: Callable[[], Column], digits: int | None = None) -> None:
    """Register a rule over the statistics of the star tables."""
    shown = f"round(CAST({sql} AS DOUBLE), {digits})" if digits is not None else sql

    @check(name, f"WITH {stats_cte(renamed=True)} SELECT table_name, column_name, {shown} AS result FROM stats")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = build()
        if digits is not None:
            result = F.round(result, digits)
        return profile.column_statistics(silver(spark, sf_dir)).select(*KEY, result.alias("result"))


rule("E6_null_percentage", NULL_PCT, build=profile.null_percentage, digits=6)
rule("E6_cardinality_ratio", RATIO, build=profile.cardinality_ratio, digits=6)
rule("E7_classify_by_type_and_cardinality", CLASS_BY_TYPE, build=profile.classify_by_type_and_cardinality)

# A logical type per storage type, so that the name-based rules see every kind.
LOGICAL_SQL = """CASE WHEN type_name LIKE 'Int%' THEN 'integer' WHEN type_name LIKE 'Float%' THEN 'numeric'
 WHEN type_name = 'DateTime' THEN 'date' WHEN cardinality = 2 THEN 'boolean' ELSE 'string' END"""


def logical() -> Column:
    kind = F.col("type_name")
    return (
        F.when(kind.startswith("Int"), "integer").when(kind.startswith("Float"), "numeric").when(kind == "DateTime", "date")
        .when(F.col("cardinality") == 2, "boolean").otherwise("string")
    )


IDENT = "regexp_matches(lower(column_name), '(id|key|code|num|no|name)$')"
NUMERIC = f"({LOGICAL_SQL}) IN ('integer', 'decimal', 'numeric')"
DATED, FLAGGED = f"({LOGICAL_SQL}) IN ('date', 'datetime')", f"({LOGICAL_SQL}) = 'boolean'"
HIGH, LOW = f"({RATIO}) > 0.8", f"({RATIO}) < 0.1"
ROLE = f"CASE WHEN {NUMERIC} AND NOT {IDENT} THEN 'fact' ELSE 'dimension' END"
MEASURE_NAME = "regexp_matches(lower(column_name), '(amount|cost|price|value|quantity|qty|count|total|sum|avg|rate)$')"

rule("E8_classify_with_reasons", ROLE, build=lambda: profile.classify_with_reasons(logical()))
rule(
    "E8_classification_reasons",
    f"""concat_ws('|', CASE WHEN {NUMERIC} THEN 'Numeric data type (typically a measure/fact)' END,
      CASE WHEN {NUMERIC} AND {HIGH} THEN 'High cardinality confirms measure classification' END,
      CASE WHEN {NUMERIC} AND {MEASURE_NAME} THEN 'Column name suggests measure (amount, cost, quantity, etc.)' END,
      CASE WHEN {DATED} THEN 'Date/time column (typically dimension)' END,
      CASE WHEN {FLAGGED} THEN 'Boolean column (typically dimension)' END,
      CASE WHEN {IDENT} THEN 'Column name suggests identifier/key' END,
      CASE WHEN {LOW} AND NOT {NUMERIC} THEN 'Low cardinality non-numeric column (likely dimension)' END)""",
    build=lambda: F.array_join(profile.classification_reasons(logical()), "|"),
)
rule(
    "E9_classification_confidence",
    f"""least(1.0, CASE WHEN ({ROLE}) = 'fact' THEN 0.5 + CASE WHEN {NUMERIC} THEN 0.3 ELSE 0 END + CASE WHEN {HIGH} THEN 0.2 ELSE 0 END
        + CASE WHEN {IDENT} THEN 0 ELSE 0.1 END ELSE 0.5 + CASE WHEN {DATED} OR {FLAGGED} THEN 0.3 ELSE 0 END
        + CASE WHEN {IDENT} THEN 0.2 ELSE 0 END + CASE WHEN {LOW} THEN 0.1 ELSE 0 END END)""",
    build=lambda: profile.classification_confidence(logical()), digits=6,
)
rule("E10_classify_simple", f"CASE WHEN ({LOGICAL_SQL}) IN ('numeric', 'integer', 'decimal', 'float') THEN 'fact' ELSE 'dimension' END",
     build=lambda: profile.classify_simple(logical()))
rule("E11_classify_erd", CLASS_ERD, build=profile.classify_erd)
rule("E12_is_fact_column", IS_MEASURE, build=lambda: is_measure(F.col("table_name"), F.col("column_name"), F.col("type_name")))
rule(
    "E13_pk_candidate_80",
    f"""(({CLASS_BY_TYPE}) = 'dimension' AND null_count <= 0 AND ({RATIO}) >= 0.8 AND cardinality >= 100
        AND regexp_matches(type_name, 'Int(8|16|32|64)|String'))""",
    build=lambda: profile.pk_candidate_80(profile.classify_by_type_and_cardinality(), profile.suitable_storage_type()),
)
rule("E14_pk_candidate_unique", PK_UNIQUE, build=profile.pk_candidate_unique)
rule("E15_quality_score_catalog", QUALITY_CATALOG, build=profile.quality_score_catalog, digits=6)
rule("E16_quality_score_table", QUALITY_TABLE, build=profile.quality_score_table, digits=6)
rule("E17_quality_score_erd", QUALITY_ERD, build=profile.quality_score_erd, digits=6)
rule(
    "E18_quality_score_discover",
    "CASE WHEN cardinality + null_count > 0 THEN cardinality * 1.0 / (cardinality + null_count) ELSE 0 END",
    build=profile.quality_score_discover, digits=6,
)


@check("E19_table_type", f"WITH {erd_cte()} SELECT * FROM typed")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_types(profile.erd_profile(star(spark, sf_dir)))


@check(
    "E20_table_summary",
    f"""WITH {catalog_cte()} SELECT table_name, max(row_count) AS row_count, count(*) AS total_columns,
        count(*) FILTER (classification = 'fact') AS fact_columns, count(*) FILTER (classification = 'dimension') AS dimension_columns,
        round(avg(data_quality_score), 6) AS avg_data_quality, count(*) FILTER (data_quality_score > 0.8) AS high_quality_columns,
        count(*) FILTER (is_pk) AS primary_key_candidates, count(*) FILTER (null_count > 0) AS columns_with_nulls
        FROM catalog GROUP BY table_name""",
)
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.table_summary(profile.catalog_profile(star(spark, sf_dir)))
    return summary.withColumn("avg_data_quality", F.round("avg_data_quality", 6))


@check(
    "E21_schema_summary",
    f"""WITH {catalog_cte()}, t AS (SELECT count(DISTINCT table_name) AS total_tables, count(*) AS total_columns,
          count(*) FILTER (classification = 'fact') AS total_fact_columns, count(*) FILTER (classification = 'dimension') AS total_dimension_columns,
          count(*) FILTER (is_pk) AS total_primary_key_candidates FROM catalog)
        SELECT *, round(total_columns * 1.0 / total_tables, 6) AS avg_columns_per_table,
          round(CASE WHEN total_dimension_columns > 0 THEN total_fact_columns * 1.0 / total_dimension_columns ELSE 0 END, 6) AS fact_dimension_ratio FROM t""",
)
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.schema_summary(profile.catalog_profile(star(spark, sf_dir)))
    return summary.withColumns({c: F.round(c, 6) for c in ("avg_columns_per_table", "fact_dimension_ratio")})


def landed_long(tables: list[str]) -> str:
    """Text cells of landed tables, timestamps as dates."""
    parts = []
    for tab in tables:
        for column, kind in STAR_SCHEMA[tab].items():
            shown = f"strftime({column}, '%Y-%m-%d')" if kind == "DateTime" else text_of(column, kind)
            parts.append(f"SELECT '{tab}' AS table_name, '{column}' AS column_name, coalesce({shown}, '') AS value FROM {tab}")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


def landed(spark: SparkSession, sf_dir: str, names: list[str], stamped: bool = False) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        df = table(spark, sf_dir, name)
        for column, kind in STAR_SCHEMA[name].items():
            if kind == "DateTime":
                df = df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))
        out[name] = land(df, STAMP) if stamped else land(df, STAMP).drop("create_date")
    return out


def profile_sql(tables: list[str], n: int = 10) -> str:
    return f"""{landed_long(tables)},
     dist AS (SELECT table_name, column_name, value, count(*) AS cnt FROM cells GROUP BY ALL),
     base AS (SELECT table_name, column_name, CAST(sum(cnt) AS BIGINT) AS row_count, count(*) AS cardinality,
       CAST(coalesce(sum(cnt) FILTER (value = ''), 0) AS BIGINT) AS blank_count FROM dist GROUP BY ALL),
     sampled AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank
       FROM dist WHERE value <> ''),
     {inferred_cte('sampled')},
     arrays AS (SELECT table_name, column_name, string_agg(value, '|' ORDER BY value) AS sample_values,
       string_agg(value, '|' ORDER BY value) FILTER (rank <= 5) AS five FROM sampled WHERE rank <= {n} GROUP BY ALL)"""


FULL_PROFILE = f"""SELECT table_name, column_name, inferred_type, pattern, round(type_confidence, 6) AS type_confidence, cardinality,
  blank_count AS null_count, round(blank_count * 100.0 / row_count, 6) AS null_percentage,
  CASE WHEN inferred_type = 'numeric' AND NOT {IDENT} THEN 'fact' ELSE 'dimension' END AS classification,
  (CASE WHEN inferred_type = 'numeric' AND NOT {IDENT} THEN 'fact' ELSE 'dimension' END = 'dimension' AND blank_count = 0
    AND cardinality * 1.0 / row_count >= 0.8 AND cardinality >= 100 AND inferred_type IN ('string', 'date')) AS is_primary_key_candidate,
  round((greatest(0.0, 1.0 - blank_count * 1.0 / row_count) + least(cardinality / 1000.0, 1.0)) / 2, 6) AS data_quality_score,
  round(cardinality * 1.0 / row_count, 6) AS cardinality_ratio, sample_values, row_count
  FROM base JOIN inferred USING (table_name, column_name) JOIN arrays USING (table_name, column_name)"""

PROFILE_COLUMNS = ["table_name", "column_name", "inferred_type", "pattern", "type_confidence", "cardinality", "null_count",
                   "null_percentage", "classification", "is_primary_key_candidate", "data_quality_score",
                   "cardinality_ratio", "sample_values", "row_count"]
ROUNDED = ["type_confidence", "null_percentage", "data_quality_score", "cardinality_ratio"]


def shown(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.select(*columns).withColumn("sample_values", F.array_join("sample_values", "|"))
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED if c in columns})


@check("E22_profile_table", f"WITH {profile_sql(['lineitem'])} {FULL_PROFILE}")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = landed(spark, sf_dir, ["lineitem"])
    return shown(profile.profile_table(tables["lineitem"], "lineitem"), PROFILE_COLUMNS)


@check("E23_profile_schema", f"WITH {profile_sql(list(STAR_SCHEMA))} {FULL_PROFILE}")
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile.profile_schema(landed(spark, sf_dir, list(STAR_SCHEMA))), PROFILE_COLUMNS)


@check(
    "E24_discover",
    f"""WITH {profile_sql(list(STAR_SCHEMA))} SELECT table_name AS original_table_name, column_name AS original_column_name,
        inferred_type, pattern, CASE WHEN inferred_type = 'numeric' THEN 'fact' ELSE 'dimension' END AS classification,
        cardinality, 0 AS null_count, five AS sample_values, 1.0::DOUBLE AS data_quality_score, 1 AS version
        FROM base JOIN inferred USING (table_name, column_name) JOIN arrays USING (table_name, column_name)""",
)
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.discover(landed(spark, sf_dir, list(STAR_SCHEMA), stamped=True))
    return shown(found, ["original_table_name", "original_column_name", "inferred_type", "pattern", "classification",
                         "cardinality", "null_count", "sample_values", "data_quality_score", "version"])


def loads(spark: SparkSession, sf_dir: str, stamped: bool = False) -> profile_state.ProfileState:
    """The tables landed on three days, each day a third of the rows, and one day loaded twice."""
    path, tables = scratch_path(spark, "profile-state"), landed(spark, sf_dir, list(STAR_SCHEMA), stamped)
    skip = ("create_date",) if stamped else ()
    for day in (0, 1, 2, 1):
        share = {name: df.where(F.pmod(F.xxhash64(*df.columns[:4]), F.lit(3)) == day) for name, df in tables.items()}
        profile_state.add_load(spark, path, f"2024-06-0{day + 1}", share, skip)
    return profile_state.load_state(spark, path)


@check("E23_profile_of_loads", f"WITH {profile_sql(list(STAR_SCHEMA))} {FULL_PROFILE}")
def e23_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile_state.profile_of_state(loads(spark, sf_dir)), PROFILE_COLUMNS)


@check("E24_discover_of_loads", ORACLE["E24_discover"])
def e24_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile_state.discover_of_state(loads(spark, sf_dir, stamped=True))
    return shown(found, ["original_table_name", "original_column_name", "inferred_type", "pattern", "classification",
                         "cardinality", "null_count", "sample_values", "data_quality_score", "version"])


@check("E22_profile_of_two_halves", f"WITH {profile_sql(['lineitem'])} {FULL_PROFILE}")
def e22_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states in one plan, added up without being stored."""
    df = landed(spark, sf_dir, ["lineitem"])["lineitem"]
    odd = F.col("l_linenumber").cast("int") % 2 == 1
    states = [profile_state.state_of({"lineitem": df.where(side)}) for side in (odd, ~odd)]
    return shown(profile_state.profile_of_state(profile_state.merged(*states)), PROFILE_COLUMNS)


VIEW_SQL = {
    "facts": "classification = 'fact'", "dimensions": "classification <> 'fact'", "keys": "is_pk", "poor": "data_quality_score < 0.5",
}


@check(
    "E25_catalog_summary",
    f"WITH {catalog_cte(renamed=True)} " + " UNION ALL ".join(
        f"SELECT '{v}' AS listing, row_number() OVER (ORDER BY {'data_quality_score DESC, ' if v != 'poor' else ''}table_name, column_name) AS place, "
        f"table_name, column_name, round(data_quality_score, 6) AS score FROM catalog WHERE {c}" for v, c in VIEW_SQL.items()
    ),
)
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    from pyspark.sql import Window

    views = profile.catalog_views(profile.catalog_profile(silver(spark, sf_dir)))
    parts = []
    for name in VIEW_SQL:
        order = ["table_name", "column_name"] if name == "poor" else [F.col("data_quality_score").desc(), "table_name", "column_name"]
        place = F.row_number().over(Window.partitionBy("listing").orderBy(*order))
        parts.append(views[name].withColumn("listing", F.lit(name)).select(
            "listing", place.alias("place"), "table_name", "column_name", F.round("data_quality_score", 6).alias("score")))
    return reduce(DataFrame.unionByName, parts)


@check(
    "E26_erd_nodes",
    f"""WITH {catalog_cte()} SELECT table_name, string_agg(column_name, '|' ORDER BY position) AS columns,
        coalesce(string_agg(column_name, '|' ORDER BY position) FILTER (is_pk), '') AS primary_keys, max(row_count) AS row_count
        FROM catalog GROUP BY table_name""",
)
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = profile.erd_nodes(profile.catalog_profile(star(spark, sf_dir)))
    return nodes.select("table_name", joined("columns"), joined("primary_keys"), "row_count")


# ---- quality -----------------------------------------------------------------------------------

ISSUE_SQL = {
    "high_nulls": ("high", "null_percentage > 50"),
    "low_cardinality": ("medium", "classification = 'dimension' AND cardinality < 10"),
    "poor_quality": ("high", "data_quality_score < 0.3"),
    "potential_primary_key": ("low", "classification = 'dimension' AND NOT is_pk AND cardinality > 100 AND null_percentage < 5"),
}


def holed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the star tables plus events with missing values."""
    lines = F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))
    tables = star(spark, sf_dir)
    tables["lineitem"] = tables["lineitem"].withColumn("l_returnflag", lines)
    return profile.catalog_profile(tables)


HOLED_CATALOG = catalog_cte().replace(
    "count(*) - count(l_returnflag) AS null_count, count(*) FILTER (l_returnflag = '') AS blank_count, count(DISTINCT l_returnflag)",
    "count(*) FILTER (l_linenumber <> 1) AS null_count, 0 AS blank_count, count(DISTINCT l_returnflag) FILTER (l_linenumber = 1)",
)


def issue_check(number: int, kind: str) -> None:
    severity, condition = ISSUE_SQL[kind]

    @check(
        f"F{number}_issue_{kind}",
        f"WITH {HOLED_CATALOG} SELECT table_name, column_name, '{kind}' AS type, '{severity}' AS severity FROM catalog WHERE {condition}",
    )
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        issues = quality.column_issues(holed_catalog(spark, sf_dir))
        return issues.where(F.col("type") == kind).select("table_name", "column_name", "type", "severity")


for _i, _kind in enumerate(ISSUE_SQL, 1):
    issue_check(_i, _kind)

ISSUE_COUNT = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in ISSUE_SQL.values())


@check(
    "F5_table_quality",
    f"""WITH {HOLED_CATALOG}, t AS (SELECT table_name, round(avg(data_quality_score), 6) AS score, count(*) AS column_count,
          max(row_count) AS row_count, CAST(sum({ISSUE_COUNT}) AS BIGINT) AS issue_count FROM catalog GROUP BY table_name)
        SELECT *, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS band FROM t""",
)
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_quality(holed_catalog(spark, sf_dir)).withColumn("score", F.round("score", 6))


QUALITY_CTE = f"""{HOLED_CATALOG}, per AS (SELECT table_name, avg(data_quality_score) AS score, """ + ", ".join(
    f"count(*) FILTER ({c}) AS {k}" for k, (_, c) in ISSUE_SQL.items()
) + """ FROM catalog GROUP BY table_name), report AS (SELECT round(avg(score), 6) AS overall_score, count(*) AS total_tables,
  count(*) FILTER (score > 0.8) AS high_quality_tables, count(*) FILTER (score > 0.5 AND score <= 0.8) AS medium_quality_tables,
  count(*) FILTER (score <= 0.5) AS low_quality_tables, """ + ", ".join(
    f"CAST(sum({k}) AS BIGINT) AS {k}_issues" for k in ISSUE_SQL
) + " FROM per)"


@check("F6_catalog_quality", f"WITH {QUALITY_CTE} SELECT * FROM report")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.catalog_quality(holed_catalog(spark, sf_dir)).withColumn("overall_score", F.round("overall_score", 6))


@check(
    "F6_ordered_issues",
    f"WITH {HOLED_CATALOG}, found AS (" + " UNION ALL ".join(
        f"SELECT table_name, column_name, '{k}' AS type, '{s}' AS severity FROM catalog WHERE {c}" for k, (s, c) in ISSUE_SQL.items()
    ) + """) SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
      table_name, column_name, type) AS place, * FROM found""",
)
def f6_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators.ordering import global_position

    issues = quality.column_issues(holed_catalog(spark, sf_dir)).drop("message")
    ranked = issues.withColumn("_rank", quality.severity_rank(F.col("severity")))
    return global_position(ranked, ["_rank", "table_name", "column_name", "type"], name="place").drop("_rank")


@check(
    "F7_recommendations",
    f"""WITH {QUALITY_CTE} SELECT 'overall_quality' AS type, 'high' AS priority FROM report WHERE overall_score < 0.5
        UNION ALL SELECT 'null_values', 'high' FROM report WHERE high_nulls_issues > 0
        UNION ALL SELECT 'primary_keys', 'medium' FROM report WHERE potential_primary_key_issues > 0
        UNION ALL SELECT 'cardinality', 'medium' FROM report WHERE low_cardinality_issues > 0""",
)
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recommendations(holed_catalog(spark, sf_dir)).select("type", "priority")
