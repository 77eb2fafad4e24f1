"""Operations logs: routing by phase, search, statistics, retention."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns every log table has, phases and their own columns with defaults.
BASE_COLUMNS = [
    "timestamp", "logger_name", "log_level", "message", "module", "function", "line_number", "phase",
    "endpoint", "method", "request_data", "error_type", "error_traceback", "metadata",
]
PHASE_COLUMNS: dict[str, dict[str, object]] = {
    "Acquire": {"source_id": "", "transformation_id": 0},
    "Discover": {"schema_name": "", "table_name": ""},
    "Model": {"schema_name": "", "table_name": "", "analysis_type": ""},
    "Transform": {"transformation_id": 0, "transformation_stage": "", "schema_name": "", "table_name": ""},
    "Pipeline": {"pipeline_id": "", "execution_id": "", "schedule_type": ""},
    "Administration": {"operation_type": "", "resource_type": ""},
}
APPLICATION = "application"
TABLES = [APPLICATION, *[phase.lower() for phase in PHASE_COLUMNS]]
DEFAULT_TTL_DAYS = 7


def target_table(phase: Column) -> Column:
    """Table of a log row: its phase when known, else the application table."""
    known = F.coalesce(phase.isin(list(PHASE_COLUMNS)), F.lit(False))
    return F.when(known, F.lower(phase)).otherwise(F.lit(APPLICATION))


def route_logs(df: DataFrame) -> DataFrame:
    """Tag rows with their table and default the columns of that table; columns of others are NULL."""
    phase = F.col("phase")
    extra: dict[str, Column] = {}
    for name, columns in PHASE_COLUMNS.items():
        for column, default in columns.items():
            given = F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)
            chain = extra.get(column)
            extra[column] = F.when(phase == name, given) if chain is None else chain.when(phase == name, given)
    return df.withColumns({**extra, "target_table": target_table(phase)})


def log_table(routed: DataFrame, table: str) -> DataFrame:
    """Rows of one log table with exactly its columns."""
    own = next((c for p, c in PHASE_COLUMNS.items() if p.lower() == table), {})
    return routed.where(F.col("target_table") == table).select(*BASE_COLUMNS, *own)


def write_logs(routed: DataFrame, path: str) -> None:
    """Append to one folder per table and day, the unit that retention removes."""
    dated = routed.withColumn("log_date", F.to_date("timestamp"))
    dated.write.mode("append").partitionBy("target_table", "log_date").parquet(path)


def all_logs(tables: dict[str, DataFrame]) -> DataFrame:
    """All log tables as one; columns a table lacks are NULL."""
    tagged = [df.withColumn("target_table", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# Columns a log search returns.
SEARCH_COLUMNS = [
    "timestamp", "logger_name", "log_level", "message", "module", "function", "line_number", "phase",
    "endpoint", "method", "error_type", "metadata",
]


def query_logs(logs: DataFrame, logger_name: str | None = None, log_level: str | None = None,
               phase: str | None = None, start: str | None = None, end: str | None = None,
               limit: int | None = None, offset: int = 0, tie: str | None = None) -> DataFrame:
    """Matching rows, newest first; ``limit`` and ``offset`` make a page, ``tie`` orders rows of one instant."""
    wanted = logs
    for column, value in (("logger_name", logger_name), ("log_level", log_level), ("phase", phase)):
        if value is not None:
            wanted = wanted.where(F.col(column) == value)
    if start is not None:
        wanted = wanted.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        wanted = wanted.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    order = [F.col("timestamp").desc()] + ([F.col(tie)] if tie else [])
    found = wanted.orderBy(*order).select(*SEARCH_COLUMNS).offset(offset)
    return found if limit is None else found.limit(limit)


def log_total(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_logs"))


def logs_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_level").agg(F.count(F.lit(1)).alias("logs")).orderBy(F.col("logs").desc(), "log_level")


def top_loggers(logs: DataFrame, n: int = 10) -> DataFrame:
    counted = logs.groupBy("logger_name").agg(F.count(F.lit(1)).alias("logs"))
    return counted.orderBy(F.col("logs").desc(), "logger_name").limit(n)


def log_time_span(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def retained(logs: DataFrame, now: Column, ttl_days: int = DEFAULT_TTL_DAYS) -> DataFrame:
    """Rows young enough to keep."""
    return logs.where(F.col("timestamp") >= cutoff(now, ttl_days))


def cutoff(now: Column, ttl_days: int = DEFAULT_TTL_DAYS) -> Column:
    return now - F.make_dt_interval(days=F.lit(ttl_days))


def prune_report(logs: DataFrame, now: Column, ttl_days: int = DEFAULT_TTL_DAYS) -> DataFrame:
    """Deleted and remaining rows per table."""
    old = F.col("timestamp") < cutoff(now, ttl_days)
    return logs.groupBy("target_table").agg(
        F.count_if(old).alias("deleted"), F.count_if(~old).alias("remaining")
    )


def prune_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("deleted").alias("total_deleted"), F.sum("remaining").alias("total_remaining"))


def prune_folders(spark: SparkSession, path: str, now: datetime, ttl_days: int = DEFAULT_TTL_DAYS) -> DataFrame:
    """Remove the day folders of ``write_logs`` that lie wholly before the cutoff; (target_table, deleted, remaining) rows.

    Which folders go is decided by their names, and the counts come from file footers. The driver holds one
    row per table and expired day. A folder is deleted through the file system that holds it.
    """
    stored = spark.read.parquet(path)
    old = F.col("log_date") < F.lit((now - timedelta(days=ttl_days)).date())
    report = stored.groupBy("target_table").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("remaining")).collect()
    expired = stored.where(old).select("target_table", F.col("log_date").cast("string").alias("day")).distinct().collect()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in expired:
        folder = hadoop.Path(f"{path}/target_table={row['target_table']}/log_date={row['day']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.createDataFrame(report, "target_table string, deleted long, remaining long")
