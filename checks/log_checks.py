"""Operations logs, derived from the events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import check, table
from starloom.operators import logs
from starloom.session import scratch_path
from starloom.streaming.jobs import stream_logs

PHASE = """CASE user_id % 8 WHEN 0 THEN 'Acquire' WHEN 1 THEN 'Discover' WHEN 2 THEN 'Model' WHEN 3 THEN 'Transform' WHEN 4 THEN 'Pipeline'
 WHEN 5 THEN 'Administration' WHEN 6 THEN 'Elsewhere' END"""
TARGET = f"CASE WHEN coalesce({PHASE}, 'Elsewhere') = 'Elsewhere' THEN 'application' ELSE lower({PHASE}) END"


def as_logs(events: DataFrame) -> DataFrame:
    """events in the shape of log rows."""
    empty = ["module", "function", "endpoint", "method", "request_data", "error_type", "error_traceback"]
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("user_"), "user_id").alias("logger_name"), F.upper("event_type").alias("log_level"),
        F.col("props").alias("message"), *[F.lit("").alias(c) for c in empty],
        F.col("event_id").cast("int").alias("line_number"), F.expr(PHASE).alias("phase"), F.lit("{}").alias("metadata"),
        "event_id", F.when(F.col("event_type") == "click", F.col("user_id").cast("int")).alias("transformation_id"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"))


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log tables, separated and put together again."""
    routed = logs.route_logs(source(spark, sf_dir))
    return logs.all_logs({name: logs.log_table(routed, name) for name in logs.TABLES})


@check(
    "N1_route_logs",
    f"""SELECT event_id, {TARGET} AS target_table,
        CASE WHEN user_id % 8 IN (0, 3) THEN CASE WHEN event_type = 'click' THEN user_id ELSE 0 END END AS transformation_id,
        CASE WHEN user_id % 8 IN (1, 2, 3) THEN '' END AS schema_name, CASE WHEN user_id % 8 = 4 THEN '' END AS schedule_type FROM events""",
)
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.route_logs(source(spark, sf_dir)).select("event_id", "target_table", "transformation_id", "schema_name", "schedule_type")


@check(
    "N2_query_logs",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, 'user_' || user_id AS logger_name, upper(event_type) AS log_level, props AS message,
        event_id AS line_number, {PHASE} AS phase FROM events WHERE event_type = 'error' AND user_id % 8 = 3
        AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5""",
)
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = logs.query_logs(every(spark, sf_dir), log_level="ERROR", phase="Transform", start="2024-01-05", end="2024-01-25",
                           limit=20, offset=5, tie="line_number")
    return page.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "logger_name", "log_level", "message", "line_number", "phase")


@check("N3_log_total", "SELECT count(*) AS total_logs FROM events")
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_total(every(spark, sf_dir))


@check("N4_logs_by_level", "SELECT upper(event_type) AS log_level, count(*) AS logs FROM events GROUP BY 1")
def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.logs_by_level(every(spark, sf_dir))


@check("N5_top_loggers", "SELECT 'user_' || user_id AS logger_name, count(*) AS logs FROM events GROUP BY 1 ORDER BY logs DESC, logger_name LIMIT 10")
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.top_loggers(every(spark, sf_dir))


@check("N6_log_time_span", "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest FROM events")
def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = logs.log_time_span(every(spark, sf_dir))
    return span.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("oldest", "newest")])


NOW = "2024-01-31 00:00:00"


@check(
    "N7_prune_report",
    f"""SELECT {TARGET} AS target_table, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS deleted,
        count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS remaining FROM events GROUP BY 1""",
)
def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.prune_report(every(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@check(
    "N7_prune_totals",
    "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS total_deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS total_remaining FROM events",
)
def n7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.prune_totals(logs.prune_report(every(spark, sf_dir), F.lit(NOW).cast("timestamp")))


@check(
    "N7_pruned_folders",
    f"""SELECT target_table, deleted, remaining, remaining AS stored FROM (SELECT {TARGET} AS target_table,
          count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS remaining FROM events GROUP BY 1)""",
)
def n7_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log-days")
    logs.write_logs(logs.route_logs(source(spark, sf_dir)), path)
    report = logs.prune_folders(spark, path, datetime.fromisoformat(NOW))
    stored = spark.read.parquet(path).groupBy("target_table").agg(F.count(F.lit(1)).alias("stored"))
    return report.join(stored, "target_table")


@check("N7_retained", "SELECT event_id AS line_number FROM events WHERE ts >= TIMESTAMP '2024-01-24'")
def n7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.retained(every(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("line_number")


@check("N8_stream_logs", f"SELECT {TARGET} AS target_table, strftime(ts, '%Y-%m-%d') AS log_date, count(*) AS logs FROM events GROUP BY ALL")
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    twice = stream.unionByName(stream)  # every row is delivered two times
    target = scratch_path(spark, "logs")
    stream_logs(as_logs(twice), "event_id", target, scratch_path(spark, "progress"), "40 days").awaitTermination()
    stored = spark.read.parquet(target)
    return stored.groupBy("target_table", F.col("log_date").cast("string").alias("log_date")).agg(F.count(F.lit(1)).alias("logs"))
