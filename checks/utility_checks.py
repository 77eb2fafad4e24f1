"""General column utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import SPACE_SQL, check, table
from starloom.functions import text, values
from starloom.operators import cleanse
from starloom.sources import ingest


@check(
    "C1_clean_string",
    # A NUL between spaces keeps them apart until it is dropped; chr(1) stands for it here.
    f"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, ' ', ' ' || chr(1) || chr(9) || ' '), '^{SPACE_SQL}+', ''),
        '{SPACE_SQL}+', ' ', 'g'), chr(1), '') AS text FROM documents""",
)
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(" \n"), F.replace("text", F.lit(" "), F.lit(" \x00\t ")), F.lit("\x00"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_string(dirty).alias("text"))




@check(
    "C2_is_email",
    """SELECT event_id, event_type <> 'view' AS is_email, false AS bare FROM events""",
)
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.format_string("u%d.%s@mail-%d.example.%s", "user_id", "event_type", "event_id",
                              F.when(F.col("event_type") == "view", "x").otherwise("org"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.is_email(address).alias("is_email"), text.is_email(F.col("event_type")).alias("bare")
    )


@check(
    "C3_is_url",
    r"""SELECT page_id, regexp_matches(url, '^https?://[-\w.]+(:[0-9]+)?(/[\w/.]*(\?[\w&=%.]*)?(#[\w.]*)?)?$') AS is_url FROM pages""",
)
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.is_url(F.col("url")).alias("is_url"))


@check(
    "C4_truncate",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END AS short FROM documents",
)
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@check("C5_file_extension", r"SELECT page_id, lower(regexp_extract(url, '[^/.][^/]*(\.[^./]*)$', 1)) AS extension FROM pages")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_extension(F.col("url")).alias("extension"))


@check(
    "C6_parse_datetime",
    """SELECT event_id, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d 00:00:00.000000') WHEN 'error' THEN NULL
       WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.000000') END AS moment FROM events""",
)
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_type")
    shown = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "error", F.date_format(ts, "dd/MM/yyyy"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(values.parse_datetime(shown), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment")
    )


@check("C7_format_datetime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", values.format_datetime(F.col("ts")).alias("moment"))


@check("C8_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("digest"))


@check(
    "C9_json",
    """SELECT event_id, true AS valid, event_type = 'view' AS mixed_valid,
       CASE WHEN event_type = 'view' THEN props ELSE '{}' END AS mixed FROM events""",
)
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.concat("props", F.lit("}")))
    return table(spark, sf_dir, "events").select(
        "event_id", text.is_json(F.col("props")).alias("valid"), text.is_json(mixed).alias("mixed_valid"),
        text.json_or_default(mixed, "{}").alias("mixed"),
    )


@check(
    "C10_safe_ratio",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS ratio,
       round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END * 100, 4) AS pct FROM lineitem""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(text.safe_ratio(tax, discount), 6).alias("ratio"),
        F.round(text.safe_pct(tax, discount), 4).alias("pct"),
    )


@check(
    "C11_format_units",
    """SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n * 1.0::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE)
         WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size,
       CASE WHEN s < 60 THEN printf('%.1fs', s * 1.0::DOUBLE) WHEN s < 3600 THEN printf('%.1fm', s / 60.0::DOUBLE)
         ELSE printf('%.1fh', s / 3600.0::DOUBLE) END AS took
       FROM (SELECT doc_id, n_chars * n_chars * 3 AS n, n_chars + 1 AS s FROM documents)""",
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.format_bytes(n * n * 3).alias("size"), text.format_duration(n + 1).alias("took")
    )


@check(
    "C12_normalize_dataframe",
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CAST(l_quantity AS DOUBLE) AS quantity, l_returnflag AS flag FROM lineitem",
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("  "), F.col("l_extendedprice").cast("string")).alias("price"),
        F.col("l_quantity").cast("string").alias("quantity"), F.concat("l_returnflag", F.lit(" \n")).alias("flag"),
    )
    return cleanse.normalize_columns(rows)


@check(
    "C12_long_whole_numbers",
    """SELECT '#' || o_orderkey AS name, 9007199254740992 + o_orderkey AS above_double,
       CAST(90071992547409920000 AS DECIMAL(38,0)) + o_orderkey AS above_bigint FROM orders""",
)
def c12_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("decimal(38,0)")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("#"), "o_orderkey").alias("name"), (key + 9007199254740992).cast("string").alias("above_double"),
        (key + F.lit("90071992547409920000").cast("decimal(38,0)")).cast("string").alias("above_bigint"),
    )
    return cleanse.normalize_columns(rows)


@check(
    "C13_boolean_and_day",
    """SELECT 'late' AS column_name, 'boolean' AS data_type WHERE (SELECT count(*) FROM orders) > 0
       UNION ALL SELECT 'day', 'datetime' WHERE (SELECT count(*) FROM orders) > 0""",
)
def c13_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("late"), F.col("o_orderdate").cast("date").alias("day"))
    return cleanse.detect_data_types(rows)


@check(
    "C13_detect_data_types",
    """SELECT 'o_orderkey' AS column_name, 'integer' AS data_type UNION ALL SELECT 'o_custkey', 'integer'
       UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) < count(*) * 0.5 THEN 'categorical' ELSE 'string' END FROM orders
       UNION ALL SELECT 'o_totalprice', 'float' UNION ALL SELECT 'o_orderdate', 'datetime'
       UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) < count(*) * 0.5 THEN 'categorical' ELSE 'string' END FROM orders""",
)
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.detect_data_types(table(spark, sf_dir, "orders"))


@check(
    "C14_validate_schema",
    """SELECT * FROM (VALUES ('c_acctbal', 'integer', 'float', 'type_mismatch', 'warning'), ('c_phone', 'string', NULL, 'missing_column', 'error'))
       t(column_name, expected_type, actual_type, finding, severity) WHERE (SELECT count(*) FROM customer) > 0""",
)
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = cleanse.detect_data_types(table(spark, sf_dir, "customer")).withColumnRenamed("data_type", "type_name")
    expected = ingest.schema_frame(spark, {"c_custkey": "integer", "c_acctbal": "integer", "c_phone": "string", "c_mktsegment": "categorical"})
    return ingest.schema_diff(expected, actual)
