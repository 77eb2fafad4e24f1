"""Calendar dimension over the range of the order dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import check, table
from starloom.operators import calendar as cal

FIXED = [("New Year''s Day", 1, 1, 1), ("Juneteenth National Independence Day", 6, 19, 2021), ("Independence Day", 7, 4, 1),
         ("Veterans Day", 11, 11, 1), ("Christmas Day", 12, 25, 1)]
NTH = [("Martin Luther King Jr. Day", 1, 1, 3, 1986), ("Washington''s Birthday", 2, 1, 3, 1971), ("Labor Day", 9, 1, 1, 1),
       ("Columbus Day", 10, 1, 2, 1971), ("Thanksgiving", 11, 4, 4, 1)]


def fixed_sql(day: str) -> str:
    return "CASE " + " ".join(
        f"WHEN month({day}) = {m} AND day({day}) = {d} AND year({day}) >= {y}"
        + (f" AND year({day}) NOT BETWEEN 1971 AND 1977" if n == "Veterans Day" else "") + f" THEN '{n}'"
        for n, m, d, y in FIXED
    ) + " END"


WEEKDAY = "CASE " + " ".join(
    f"WHEN month(d) = {m} AND isodow(d) = {w} AND (day(d) - 1) // 7 + 1 = {n} AND year(d) >= {y} THEN '{name}'" for name, m, w, n, y in NTH
) + """ WHEN month(d) = 5 AND isodow(d) = 1 AND month(d + 7) = 6 AND year(d) >= 1971 THEN 'Memorial Day'
  WHEN month(d) = 10 AND isodow(d) = 1 AND (day(d) - 1) // 7 + 1 = 4 AND year(d) BETWEEN 1971 AND 1977 THEN 'Veterans Day' END"""

DAYS = """days AS (SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders),
  (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS d))"""

CALENDAR = f"""WITH {DAYS}, named AS (SELECT d, coalesce({fixed_sql('d')}, {WEEKDAY},
   CASE WHEN isodow(d) = 1 THEN {fixed_sql('(d - 1)')} || ' (observed)' END, CASE WHEN isodow(d) = 5 THEN {fixed_sql('(d + 1)')} || ' (observed)' END) AS h FROM days),
 base AS (SELECT *, CASE WHEN isodow(d) <= 5 AND h IS NULL THEN 1 ELSE 0 END AS w FROM named),
 cal AS (SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS calendar_id, strftime(d, '%Y-%m-%d') AS calendar_date, year(d) AS calendar_year,
  year(d) || '-Q' || quarter(d) AS calendar_year_qtr, quarter(d) AS calendar_qtr_num, 'Q' || quarter(d) AS calendar_qtr_name,
  strftime(d, '%Y-%m') AS calendar_year_month, month(d) AS calendar_month_num, monthname(d) AS calendar_month_name,
  strftime(d, '%Y-%W') AS calendar_year_week, CAST(CAST(strftime(d, '%W') AS INT) AS VARCHAR) AS calendar_week_num,
  'Wk' || CAST(strftime(d, '%W') AS INT) AS calendar_week_name, isodow(d) AS calendar_day, dayname(d) AS calendar_day_name,
  CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend, day(d) AS day_of_month, day(last_day(d)) AS days_in_month,
  coalesce(h, '') AS holiday_name, CASE WHEN h IS NULL THEN 'N' ELSE 'Y' END AS holiday_flag, w AS working,
  CAST(sum(w) OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY d) AS INT) AS working_day,
  CAST(sum(w) OVER (PARTITION BY strftime(d, '%Y-%m')) AS INT) AS working_days FROM base)"""


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = cal.calendar(cal.days_of(table(spark, sf_dir, "orders"), "o_orderdate"))
    return built.withColumn("calendar_date", F.col("calendar_date").cast("string"))


PARTS = {
    "K1_calendar_date": ["calendar_date"],
    "K2_calendar_id": ["calendar_id"],
    "K3_date_parts": ["calendar_id", "calendar_year", "calendar_qtr_num", "calendar_month_num", "day_of_month"],
    "K4_quarter_labels": ["calendar_id", "calendar_year_qtr", "calendar_qtr_name"],
    "K5_month_labels": ["calendar_id", "calendar_year_month", "calendar_month_name"],
    "K6_week_labels": ["calendar_id", "calendar_year_week", "calendar_week_num", "calendar_week_name"],
    "K7_weekday": ["calendar_id", "calendar_day", "calendar_day_name", "is_weekend"],
    "K8_days_in_month": ["calendar_id", "days_in_month"],
    "K9_holidays": ["calendar_id", "holiday_name", "holiday_flag"],
    "K10_working": ["calendar_id", "working"],
    "K11_working_day": ["calendar_id", "working_day"],
    "K12_working_days": ["calendar_id", "working_days"],
}


def _register(name: str, columns: list[str]) -> None:
    @check(name, f"{CALENDAR} SELECT {', '.join(columns)} FROM cal")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return order_calendar(spark, sf_dir).select(*columns)


for _name, _columns in PARTS.items():
    _register(_name, _columns)


@check("K_calendar_all_columns", f"{CALENDAR} SELECT * FROM cal")
def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_calendar(spark, sf_dir)


@check(
    "K13_calendar_status",
    f"{CALENDAR} SELECT count(*) AS total_rows, min(calendar_date) AS min_date, max(calendar_date) AS max_date, count(DISTINCT calendar_year) AS years FROM cal",
)
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.calendar_status(order_calendar(spark, sf_dir))


@check(
    "K_orders_by_working_day",
    f"""{CALENDAR} SELECT calendar_year_qtr, holiday_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN cal ON strftime(o_orderdate, '%Y-%m-%d') = calendar_date GROUP BY ALL""",
)
def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("calendar_date", F.col("o_orderdate").cast("date").cast("string"))
    return orders.join(order_calendar(spark, sf_dir), "calendar_date").groupBy("calendar_year_qtr", "holiday_name").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
