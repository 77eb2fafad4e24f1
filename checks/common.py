"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

STAMP = "2024-06-01 08:00:00"


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the equivalent SQL where one exists."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Star tables with the storage type name of each column, in column order.
STAR_SCHEMA: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "Int32", "r_name": "String"},
    "nation": {"n_nationkey": "Int32", "n_name": "String", "n_regionkey": "Int32"},
    "customer": {
        "c_custkey": "Int64", "c_name": "String", "c_nationkey": "Int32", "c_acctbal": "Float64",
        "c_mktsegment": "String",
    },
    "supplier": {"s_suppkey": "Int64", "s_name": "String", "s_nationkey": "Int32", "s_acctbal": "Float64"},
    "part": {
        "p_partkey": "Int64", "p_name": "String", "p_brand": "String", "p_type": "String", "p_size": "Int32",
        "p_retailprice": "Float64",
    },
    "orders": {
        "o_orderkey": "Int64", "o_custkey": "Int64", "o_orderstatus": "String", "o_totalprice": "Float64",
        "o_orderdate": "DateTime", "o_orderpriority": "String",
    },
    "lineitem": {
        "l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32",
        "l_quantity": "Float64", "l_extendedprice": "Float64", "l_discount": "Float64", "l_tax": "Float64",
        "l_returnflag": "String", "l_linestatus": "String", "l_shipdate": "DateTime",
    },
}


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in STAR_SCHEMA}


# Shared column names across tables, as a designed warehouse would have them: used where the rules
# read names.
RENAMES: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "region_key", "r_name": "region_name"},
    "nation": {"n_nationkey": "nation_key", "n_name": "nation_name", "n_regionkey": "region_key"},
    "customer": {
        "c_custkey": "customer_key", "c_name": "customer_name", "c_nationkey": "nation_key",
        "c_acctbal": "balance_amount", "c_mktsegment": "market_segment",
    },
    "supplier": {
        "s_suppkey": "supplier_key", "s_name": "supplier_name", "s_nationkey": "nation_key",
        "s_acctbal": "balance_amount",
    },
    "part": {
        "p_partkey": "part_key", "p_name": "part_name", "p_brand": "part_brand", "p_type": "part_type",
        "p_size": "part_size_code", "p_retailprice": "retail_price",
    },
    "orders": {
        "o_orderkey": "order_key", "o_custkey": "customer_key", "o_orderstatus": "order_status",
        "o_totalprice": "total_price", "o_orderdate": "order_date", "o_orderpriority": "order_priority",
    },
    "lineitem": {
        "l_orderkey": "order_key", "l_partkey": "part_key", "l_suppkey": "supplier_key",
        "l_linenumber": "line_num", "l_quantity": "quantity", "l_extendedprice": "sales_amount",
        "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag", "l_linestatus": "line_status",
        "l_shipdate": "ship_date",
    },
}


def silver(spark: SparkSession, sf_dir: str, suffix: str = "") -> dict[str, DataFrame]:
    """Star tables under their designed names."""
    return {f"{name}{suffix}": df.withColumnsRenamed(RENAMES[name]) for name, df in star(spark, sf_dir).items()}


def stats_cte(renamed: bool = False, suffix: str = "", name: str = "stats") -> str:
    """CTE with one row of counts per column of the star tables."""
    parts = []
    for tab, columns in STAR_SCHEMA.items():
        for position, (column, kind) in enumerate(columns.items(), 1):
            shown = RENAMES[tab][column] if renamed else column
            blank = f"count(*) FILTER ({column} = '')" if kind == "String" else "0"
            parts.append(
                f"SELECT '{tab}{suffix}' AS table_name, '{shown}' AS column_name, {position} AS position, "
                f"'{kind}' AS type_name, count(*) AS row_count, count(*) - count({column}) AS null_count, "
                f"{blank} AS blank_count, count(DISTINCT {column}) AS cardinality FROM {tab}"
            )
    return f"{name} AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


NULL_PCT = "CASE WHEN row_count > 0 THEN null_count * 100.0 / row_count ELSE 0 END"
RATIO = "CASE WHEN row_count > 0 THEN cardinality * 1.0 / row_count ELSE 0 END"
IS_NUMERIC = "regexp_matches(type_name, 'Int(8|16|32|64)|Float(32|64)|Decimal')"

CLASS_BY_TYPE = f"""CASE WHEN {IS_NUMERIC} AND cardinality > 100 THEN 'fact'
 WHEN regexp_matches(lower(type_name), 'date|timestamp') THEN 'dimension'
 WHEN contains(type_name, 'String') THEN 'dimension'
 WHEN {IS_NUMERIC} AND cardinality <= 10 THEN 'dimension'
 WHEN {IS_NUMERIC} THEN 'fact' ELSE 'dimension' END"""

CLASS_ERD = """CASE WHEN regexp_matches(lower(type_name), 'float|int|uint|decimal') THEN 'fact'
 WHEN cardinality > 10000 AND contains(lower(type_name), 'string') THEN 'fact' ELSE 'dimension' END"""

PK_UNIQUE = """(null_count <= 0 AND cardinality = row_count AND regexp_matches(lower(type_name), 'string|int|uint')
 AND (regexp_matches(lower(column_name), 'id|key|code|num|no') OR cardinality > 1000))"""

QUALITY_CATALOG = """CASE WHEN cardinality = 0 THEN 0.0 ELSE
 (least(cardinality / 1000.0, 1.0) + 1.0 - null_count * 1.0 / greatest(cardinality, 1)) / 2 END"""

QUALITY_TABLE = """CASE WHEN row_count = 0 THEN 0.0 ELSE
 (greatest(0.0, 1.0 - null_count * 1.0 / row_count) + least(cardinality / 1000.0, 1.0)) / 2 END"""

QUALITY_ERD = f"""greatest(0.0, least(1.0, 1.0
 - CASE WHEN {NULL_PCT} > 10 THEN 0.3 WHEN {NULL_PCT} > 5 THEN 0.1 ELSE 0 END
 + CASE WHEN cardinality > 1000 THEN 0.1 WHEN cardinality > 100 THEN 0.05 ELSE 0 END
 - CASE WHEN cardinality < 10 AND row_count > 1000 THEN 0.2 ELSE 0 END))"""

IS_MEASURE = """CASE WHEN regexp_matches(lower(table_name), 'calendar|time|date|dim') THEN false
 WHEN regexp_matches(lower(column_name), '_id|_key|id_|key_') THEN false
 WHEN regexp_matches(lower(column_name), '_num|_code|_flag|is_|has_|working|_year|_day|_month|_qtr|_week') THEN false
 WHEN regexp_matches(lower(column_name),
   'amount|total|sum|quantity|count|value|price|cost|revenue|sales_amount') THEN true
 ELSE regexp_matches(lower(type_name), 'float|int|uint|decimal|numeric') END"""


def catalog_cte(renamed: bool = False, suffix: str = "") -> str:
    """stats + catalog CTEs: profile by storage type."""
    return stats_cte(renamed, suffix) + f""",
 classed AS (SELECT *, {NULL_PCT} AS null_percentage, {RATIO} AS cardinality_ratio,
   {CLASS_BY_TYPE} AS classification, {QUALITY_CATALOG} AS data_quality_score FROM stats),
 catalog AS MATERIALIZED (SELECT *, (classification = 'dimension' AND null_count <= 0 AND cardinality_ratio >= 0.8
   AND cardinality >= 100 AND regexp_matches(type_name, 'Int(8|16|32|64)|String')) AS is_pk FROM classed)"""


def erd_cte(renamed: bool = False, suffix: str = "") -> str:
    return stats_cte(renamed, suffix) + f""",
 erd AS MATERIALIZED (SELECT *, {NULL_PCT} AS null_percentage, {CLASS_ERD} AS classification, {PK_UNIQUE} AS is_pk,
   {QUALITY_ERD} AS data_quality_score FROM stats),
 counted AS (SELECT table_name, max(row_count) AS row_count, count(*) AS column_count,
   count(*) FILTER (classification = 'fact') AS fact_columns,
   count(*) FILTER (classification = 'dimension') AS dimension_columns FROM erd GROUP BY table_name),
 typed AS (SELECT *, CASE WHEN fact_columns > dimension_columns OR (row_count > 100000 AND dimension_columns > 3)
   THEN 'fact' ELSE 'dimension' END AS table_type FROM counted)"""


def text_of(column: str, kind: str) -> str:
    return column if kind == "String" else f"CAST({column} AS VARCHAR)"


def long_cte(tables: list[str] | None = None, name: str = "cells", distinct: bool = True,
             kinds: tuple[str, ...] | None = None) -> str:
    """CTE with the (distinct) values of every column as text."""
    parts = []
    for tab in tables or STAR_SCHEMA:
        for column, kind in STAR_SCHEMA[tab].items():
            if kinds is None or kind in kinds:
                parts.append(
                    f"SELECT {'DISTINCT ' if distinct else ''}'{tab}' AS table_name, '{column}' AS column_name, "
                    f"{text_of(column, kind)} AS value FROM {tab}"
                )
    return f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"


def joined(column: str, separator: str = "|") -> Column:
    """Array column as text, so that results compare plainly."""
    return F.array_join(column, separator).alias(column)


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column).cast("double"), digits).alias(column)


SPACE_SQL = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"
