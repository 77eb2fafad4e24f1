"""Read-only access to gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import check, silver
from starloom.operators import access
from starloom.operators import calendar as cal


def gold(spark: SparkSession, sf_dir: str) -> set[str]:
    """Register the gold tables as views of the session and return their names."""
    tables = silver(spark, sf_dir)
    views = {
        "items_fact": tables["lineitem"].withColumn("ship_day", F.col("ship_date").cast("date")),
        "part_dim": tables["part"],
        "supplier_dim": tables["supplier"],
        "calendar_dim": cal.calendar(cal.days_of(tables["lineitem"], "ship_date")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return set(views)


QUERY = """WITH big AS (SELECT part_key, sum(quantity) AS q FROM items_fact GROUP BY part_key)
SELECT p.part_brand, 'drop table' AS note, count(*) AS parts, sum(q) AS quantity FROM big JOIN part_dim p ON big.part_key = p.part_key
WHERE p.part_key IN (SELECT part_key FROM items_fact WHERE discount > 0.05) GROUP BY p.part_brand"""


@check(
    "O1_gold_query",
    """SELECT p_brand AS part_brand, 'drop table' AS note, count(*) AS parts, sum(q) AS quantity
       FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey
       WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05) GROUP BY p_brand""",
)
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.gold_query(spark, QUERY, gold(spark, sf_dir))


@check("O2_with_limit", "SELECT p_brand AS part_brand, count(*) AS parts FROM part GROUP BY 1 ORDER BY 1 LIMIT 7")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT part_brand, count(*) AS parts FROM part_dim GROUP BY part_brand ORDER BY part_brand LIMIT 7"
    return access.gold_query(spark, sql, gold(spark, sf_dir), limit=20)


@check(
    "O3_star_query",
    """SELECT l_orderkey AS order_key, l_linenumber AS line_num, l_partkey AS part_key, l_suppkey AS supplier_key, round(l_extendedprice, 2) AS sales_amount,
       strftime(l_shipdate, '%Y-%m') AS calendar_year_month, s_name AS supplier_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50""",
)
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT order_key, line_num, part_key, f.supplier_key, round(sales_amount, 2) AS sales_amount, calendar_year_month, supplier_name
             FROM items_fact f LEFT JOIN calendar_dim c ON f.ship_day = c.calendar_date LEFT JOIN supplier_dim s ON f.supplier_key = s.supplier_key
             ORDER BY order_key, line_num, part_key, f.supplier_key, sales_amount"""
    return access.gold_query(spark, sql, gold(spark, sf_dir), limit=50)
