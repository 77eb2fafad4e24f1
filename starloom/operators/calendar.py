"""Calendar dimension: one row per day with labels, working days and holidays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def check_range(start: str, end: str) -> None:
    """Both ``yyyy-MM-dd`` and start before end."""
    try:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError as problem:
        raise ValueError("dates must have the form yyyy-MM-dd") from problem
    if first >= last:
        raise ValueError("start date must be before end date")


def days_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All days of a range, made over partitions."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("calendar_date"))


def days_of(df: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last date of a column; only two values leave the aggregate."""
    span = df.agg(F.min(F.col(column).cast("date")).alias("first"), F.max(F.col(column).cast("date")).alias("last"))
    return span.where(F.col("first").isNotNull()).select(F.explode(F.sequence("first", "last")).alias("calendar_date"))


# US federal holidays. Fixed dates: (month, day, first year).
FIXED_HOLIDAYS = {
    "New Year's Day": (1, 1, 1),
    "Juneteenth National Independence Day": (6, 19, 2021),
    "Independence Day": (7, 4, 1),
    "Veterans Day": (11, 11, 1),
    "Christmas Day": (12, 25, 1),
}
# Week-day rules: (month, ISO week day, n-th or -1 for last, first year).
WEEKDAY_HOLIDAYS = {
    "Martin Luther King Jr. Day": (1, 1, 3, 1986),
    "Washington's Birthday": (2, 1, 3, 1971),
    "Memorial Day": (5, 1, -1, 1971),
    "Labor Day": (9, 1, 1, 1),
    "Columbus Day": (10, 1, 2, 1971),
    "Thanksgiving": (11, 4, 4, 1),
}


def _fixed_holiday(day: Column) -> Column:
    """Name of the fixed-date holiday of a day, NULL when it is none.

    Veterans Day lay on the fourth Monday of October from 1971 to 1977.
    """
    found = F.lit(None).cast("string")
    for name, (month, dom, since) in FIXED_HOLIDAYS.items():
        hit = (F.month(day) == month) & (F.dayofmonth(day) == dom) & (F.year(day) >= since)
        if name == "Veterans Day":
            hit = hit & ~F.year(day).between(1971, 1977)
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def _weekday_holiday(day: Column) -> Column:
    found = F.lit(None).cast("string")
    iso = F.weekday(day) + 1
    nth = F.floor((F.dayofmonth(day) - 1) / 7) + 1
    for name, (month, weekday, n, since) in WEEKDAY_HOLIDAYS.items():
        place = F.month(F.date_add(day, 7)) != month if n == -1 else nth == n
        hit = (F.month(day) == month) & (iso == weekday) & place & (F.year(day) >= since)
        found = F.when(hit, F.lit(name)).otherwise(found)
    moved = (F.month(day) == 10) & (iso == 1) & (nth == 4) & F.year(day).between(1971, 1977)
    return F.when(moved, F.lit("Veterans Day")).otherwise(found)


def us_holiday(day: Column) -> Column:
    """Holiday name of a day; fixed dates on Saturday are also observed on Friday, on Sunday on Monday."""
    before, after = _fixed_holiday(F.date_sub(day, 1)), _fixed_holiday(F.date_add(day, 1))
    suffix = F.lit(" (observed)")
    return F.coalesce(
        _fixed_holiday(day),
        _weekday_holiday(day),
        F.when(F.weekday(day) == 0, F.concat(before, suffix)),
        F.when(F.weekday(day) == 4, F.concat(after, suffix)),
    )


def week_of_year(day: Column) -> Column:
    """Weeks start on Monday; days before the first Monday of the year are week 0."""
    return F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7).cast("int")


def calendar(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 22 calendar columns for a frame of days (``calendar_date``).

    ``holidays`` (holiday_date, holiday_name; unique dates) replaces the built-in US rules.
    """
    day = F.col("calendar_date")
    if holidays is not None:
        named = days.join(holidays.withColumnRenamed("holiday_date", "calendar_date"), "calendar_date", "left")
    else:
        named = days.withColumn("holiday_name", us_holiday(day))
    is_holiday = F.col("holiday_name").isNotNull()
    year, week = F.year(day).cast("string"), week_of_year(day).cast("string")
    basic = named.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("calendar_id"),
        day,
        F.year(day).alias("calendar_year"),
        F.concat(year, F.lit("-Q"), F.quarter(day)).alias("calendar_year_qtr"),
        F.quarter(day).alias("calendar_qtr_num"),
        F.concat(F.lit("Q"), F.quarter(day)).alias("calendar_qtr_name"),
        F.date_format(day, "yyyy-MM").alias("calendar_year_month"),
        F.month(day).alias("calendar_month_num"),
        F.date_format(day, "MMMM").alias("calendar_month_name"),
        F.concat(year, F.lit("-"), F.lpad(week, 2, "0")).alias("calendar_year_week"),
        week.alias("calendar_week_num"),
        F.concat(F.lit("Wk"), week).alias("calendar_week_name"),
        (F.weekday(day) + 1).alias("calendar_day"),
        F.date_format(day, "EEEE").alias("calendar_day_name"),
        (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofmonth(F.last_day(day)).alias("days_in_month"),
        F.coalesce(F.col("holiday_name"), F.lit("")).alias("holiday_name"),
        F.when(is_holiday, "Y").otherwise("N").alias("holiday_flag"),
        F.when((F.weekday(day) < 5) & ~is_holiday, 1).otherwise(0).alias("working"),
    )
    month = Window.partitionBy("calendar_year_month")  # at most 31 rows
    so_far = month.orderBy("calendar_date").rowsBetween(Window.unboundedPreceding, 0)
    return basic.withColumns(
        {
            "working_day": F.sum("working").over(so_far).cast("int"),
            "working_days": F.sum("working").over(month).cast("int"),
        }
    )


def calendar_range(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    check_range(start, end)
    return calendar(days_between(spark, start, end), holidays)


def calendar_status(cal: DataFrame) -> DataFrame:
    return cal.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("calendar_date").alias("min_date"),
        F.max("calendar_date").alias("max_date"),
        F.count_distinct("calendar_year").alias("years"),
    )
