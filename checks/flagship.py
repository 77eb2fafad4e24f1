"""The flagship query: every layer from text to wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import STAMP, check, table
from starloom.plans.star import land_all, typed_from_text, wide_table


def typed_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """lineitem, part and supplier landed as text and typed by inference."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    sources = {"lineitem": lineitem, "part": table(spark, sf_dir, "part"), "supplier": table(spark, sf_dir, "supplier")}
    return typed_from_text(land_all(sources, STAMP))


def flagship_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = typed_star(spark, sf_dir)
    return wide_table(
        typed["lineitem"],
        {"part": (typed["part"], "l_partkey", "p_partkey"), "supplier": (typed["supplier"], "l_suppkey", "s_suppkey")},
    )


@check(
    "star_flagship",
    """SELECT p_brand AS brand, count(*) AS lines, count(DISTINCT s_name) AS suppliers,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS VARCHAR) AS sales_amount,
       CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_ship,
       CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_ship
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
       GROUP BY p_brand""",
)
def star_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = flagship_wide(spark, sf_dir)
    return wide.groupBy(F.col("part_p_brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("supplier_s_name").alias("suppliers"),
        F.sum("l_extendedprice").cast("string").alias("sales_amount"),
        F.min("l_shipdate").cast("string").alias("first_ship"),
        F.max("l_shipdate").cast("string").alias("last_ship"),
    )
