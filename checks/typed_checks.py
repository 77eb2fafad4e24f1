"""Typed tables and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.common import STAMP, STAR_SCHEMA, check, star, table
from checks.profile_checks import landed, profile_sql
from starloom.functions import values
from starloom.operators import profile, typed
from starloom.session import scratch_path
from starloom.sources.ingest import land
from starloom.sources.writers import compact, pack_small_files

KEYS = "l_orderkey, l_linenumber"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@check(
    "J1_storage_type",
    f"""WITH {profile_sql(list(STAR_SCHEMA))} SELECT table_name, column_name,
        CASE inferred_type WHEN 'numeric' THEN CASE WHEN q > 0.8 THEN 'Decimal(15, 2)' ELSE 'Decimal(10, 2)' END WHEN 'date' THEN 'Date' ELSE 'String' END AS storage_type
        FROM (SELECT *, (greatest(0.0, 1.0 - blank_count * 1.0 / row_count) + least(cardinality / 1000.0, 1.0)) / 2 AS q
          FROM base JOIN inferred USING (table_name, column_name))""",
)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profile_schema(landed(spark, sf_dir, list(STAR_SCHEMA)))
    kind = typed.storage_type_column(F.col("inferred_type"), F.col("data_quality_score"))
    return found.select("table_name", "column_name", kind.alias("storage_type"))


@check("J2_to_string", "SELECT doc_id, trim(text, ' ') AS text FROM documents")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("   "), "text", F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", typed.typed_column(padded, "string", 1.0).alias("text"))


def mixed_dates() -> Column:
    day = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format(day, "yyyyMMdd"))
        .when(F.col("o_orderpriority").startswith("2"), F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority").startswith("3"), F.date_format(day, "d-M-yyyy"))
        .when(F.col("o_orderpriority").startswith("4"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderstatus") == "F", "31/02/2001 soon")
        .otherwise(F.date_format(day, " yyyy-MM-dd HH:mm:ss "))
    )


UNREADABLE = "o_orderstatus = 'F' AND NOT regexp_matches(o_orderpriority, '^[1-4]')"


@check("J3_to_date_best_effort", f"SELECT o_orderkey, CASE WHEN {UNREADABLE} THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%Y-%m-%d') AS by_pattern FROM orders")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", values.to_date_best_effort(mixed_dates()).cast("string").alias("day"),
        values.to_date_best_effort(us, "MM/DD/YYYY").cast("string").alias("by_pattern"),
    )


@check("J4_to_datetime_best_effort", f"SELECT o_orderkey, CASE WHEN {UNREADABLE} THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS moment, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    text = F.lpad(seconds.cast("string"), 10, "0")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(values.to_datetime_best_effort(mixed_dates()), "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.unix_timestamp(values.to_datetime_best_effort(text)).alias("seconds"),
    )


@check("J5_to_int_or_null", f"SELECT {KEYS}, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_orderkey END AS n, CAST(NULL AS BIGINT) AS fraction FROM lineitem")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string"))
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", values.to_long_strict(text).alias("n"), values.to_long_strict(F.col("l_tax").cast("string")).alias("fraction")
    )


@check("J6_to_float_or_null", f"SELECT {KEYS}, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS price FROM lineitem")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), "l_extendedprice")).otherwise(F.col("l_extendedprice").cast("string"))
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", values.to_double(text).alias("price"))


@check(
    "J7_currency_to_decimal",
    f"""SELECT {KEYS}, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS price,
        CAST(TRY_CAST(regexp_replace(CAST(l_extendedprice AS VARCHAR) || '79', '^(\\d*\\.\\d{{2}})\\d+$', '\\1') AS DECIMAL(15,2)) AS VARCHAR) AS cut FROM lineitem""",
)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    longer = F.concat(F.col("l_extendedprice").cast("string"), F.lit("79"))
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", values.currency_to_decimal(money).cast("string").alias("price"),
        values.currency_to_decimal(longer).cast("string").alias("cut"),
    )


@check(
    "J8_accounting_to_decimal",
    f"SELECT {KEYS}, CAST(CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(15,2)) AS VARCHAR) AS amount FROM lineitem",
)
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.format_number("l_extendedprice", 2)
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("($"), money, F.lit(")"))).otherwise(money)
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", values.accounting_to_decimal(text).cast("string").alias("amount"))


@check("J9_to_bool_flag", f"SELECT {KEYS}, CASE WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 1 ELSE 0 END AS flag FROM lineitem")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_linestatus") == "O", "1").when(F.col("l_tax") == 0, "TRUE")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", values.to_flag(text).alias("flag"))


def stage1(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bronze = landed(spark, sf_dir, [name], stamped=True)
    specs = typed.column_specs(profile.discover(bronze), name)
    return typed.build_stage1(bronze[name], specs)


@check(
    "J10_build_stage1",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(CAST(l_quantity AS DECIMAL(15,2)) AS VARCHAR) AS l_quantity, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS l_extendedprice,
       l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, '2024-06-01' AS create_date FROM lineitem""",
)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage1(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"), "l_returnflag",
        F.col("l_shipdate").cast("string").alias("l_shipdate"), F.col("create_date").cast("string").alias("create_date"),
    )


@check(
    "J10_write_stage1_by_year",
    "SELECT year(o_orderdate)::INT AS create_year, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS VARCHAR) AS total FROM orders GROUP BY 1",
)
def j10_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage1(spark, sf_dir, "orders")
    stored = typed.write_stage1(rows, scratch_path(spark, "stage1"), "o_orderdate")
    return stored.groupBy(F.col("create_year").cast("int").alias("create_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("string").alias("total")
    )


def marked_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money with brackets, 14 digits before the point and, for one part in a hundred, no number at all."""
    price = F.format_number("p_retailprice", 2)
    wide = F.concat(F.lpad((F.col("p_partkey") + 1).cast("string"), 14, "9"), F.lit(".25"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("#"), "p_partkey").alias("name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("($"), price, F.lit(")"))).otherwise(price).alias("bracketed"),
        wide.alias("wide"), F.when(F.col("p_partkey") % 100 == 0, "none").otherwise(wide).alias("spoiled"),
    )


@check(
    "J10_wide_and_bracketed_money",
    """SELECT '#' || p_partkey AS name, CAST(CAST(CASE WHEN p_size % 3 = 0 THEN -p_retailprice ELSE p_retailprice END AS DECIMAL(15,2)) AS VARCHAR) AS bracketed,
       lpad(CAST(p_partkey + 1 AS VARCHAR), 14, '9') || '.25' AS wide FROM part""",
)
def j10_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_money(spark, sf_dir)
    low = 0.5  # a low quality score changes the label only
    return rows.select(
        "name", typed.typed_column(F.col("bracketed"), "numeric", low).cast("string").alias("bracketed"),
        typed.typed_column(F.col("wide"), "numeric", low, digits=14).cast("string").alias("wide"),
    )


@check(
    "J10_lost_values",
    "SELECT 'spoiled' AS column_name, 'numeric' AS inferred_type, count(*) FILTER (p_partkey % 100 = 0) AS lost FROM part",
)
def j10_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_money(spark, sf_dir)
    specs = typed.column_specs(profile.discover({"part": rows}), "part")
    return typed.lost_values(rows, specs).where("column_name = 'spoiled'")


@check("J10_lossless", "SELECT '#' || p_partkey AS name, CASE WHEN p_partkey % 100 = 0 THEN 'none' ELSE lpad(CAST(p_partkey + 1 AS VARCHAR), 14, '9') || '.25' END AS spoiled FROM part")
def j10_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_money(spark, sf_dir)
    specs = typed.lossless_specs(rows, typed.column_specs(profile.discover({"part": rows}), "part"))
    return typed.build_stage1(rows, specs).select("name", "spoiled")


@check("J11_snapshot_stage2", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return typed.snapshot_stage2(rows, scratch_path(spark, "stage2"))


@check(
    "J12_compact",
    "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = scratch_path(spark, "parts"), scratch_path(spark, "compacted")
    table(spark, sf_dir, "events").select("user_id", "event_id").repartition(16).write.parquet(source)
    return compact(spark, source, target, 2, ["user_id"], "event_id")


@check(
    "J12_pack_small_files",
    "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 1 AS files FROM events GROUP BY event_type",
)
def j12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition folder of many small files becomes one file with the same rows."""
    path = scratch_path(spark, "small-files")
    table(spark, sf_dir, "events").select("event_type", "event_id").repartition(8).write.partitionBy("event_type").parquet(path)
    pack_small_files(spark, path)
    packed = spark.read.parquet(path)
    return packed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("_metadata.file_path").cast("int").alias("files")
    )


@check(
    "J13_reconcile_counts",
    """SELECT 'orders' AS target_table, count(*) AS source_count, count(*) AS target_count, true AS counts_match, 'success' AS status FROM orders
       UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_tax > 0), false, 'error' FROM lineitem""",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), lines(spark, sf_dir)
    return typed.reconcile_counts({"orders": (orders, land(orders, STAMP)), "lineitem": (items, items.where("l_tax > 0"))})


@check(
    "J14_count_all",
    " UNION ALL ".join(f"SELECT 'source_count_{t}' AS name, count(*) AS row_count FROM {t}" for t in STAR_SCHEMA),
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.count_all(star(spark, sf_dir))


@check("J15_rename_from_metadata", "SELECT c_custkey AS customer_key, c_name AS c_name, c_mktsegment AS segment FROM customer")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.rename_from_specs(table(spark, sf_dir, "customer"), {"c_custkey": "customer_key", "c_name": "", "c_mktsegment": "segment"})
