"""Sources, sinks and landing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.common import SPACE_SQL, STAMP, STAR_SCHEMA, catalog_cte, check, star, table, text_of
from starloom.functions.text import clean_text, file_target_name, query_target_name
from starloom.operators.profile import catalog_profile, discover
from starloom.session import cut_lineage, scratch_path
from starloom.sources import ingest, quoted, readers, writers
from starloom.streaming.jobs import incremental_ingest


def as_text(tab: str, extra: str = "") -> str:
    columns = ", ".join(
        f"coalesce({text_of(c, k)}, '') AS {c}" for c, k in STAR_SCHEMA[tab].items()
    )
    return f"SELECT {columns}{extra} FROM {tab}"


@check(
    "A1_read_csv_strings",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, coalesce(role, '') AS role,
       coalesce(text, '') AS text FROM conversations""",
)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    (
        table(spark, sf_dir, "conversations").write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return readers.read_csv_strings(spark, path)


@check("A2_read_parquet_strings", as_text("orders"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet_strings(spark, f"{sf_dir}/orders.parquet")


@check("A3_decode_bytes", "SELECT doc_id, text FROM documents")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    western = F.col("text").rlike(r"(?s)^[\x00-\x7F\xA0-\xFF]*$")
    content = F.when(western, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", readers.decode_bytes(content).alias("text"))


@check("A3_decode_files", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def a3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of files in two encodings, each file's found from all of its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    western, folder = F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$"), scratch_path(spark, "encoded")
    line = F.concat("doc_id", F.lit("\t"), "text")
    docs.where(western).select(F.encode(line, "ISO-8859-1").cast("string").alias("value")).write.text(f"{folder}/west")
    docs.where(~western).select(line.alias("value")).write.text(f"{folder}/utf8")
    lines = quoted.decoded_lines(spark, [f"{folder}/west", f"{folder}/utf8"])
    return lines.select(F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"), F.regexp_replace("line", "^[0-9]+\t", "").alias("text"))


@check(
    "A6_json_records_to_rows",
    """SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS scalar FROM events
       UNION ALL SELECT event_id, CAST(props->>'$.k' AS VARCHAR), NULL FROM events WHERE event_type <> 'view'
       UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_type <> 'view'""",
)
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    listed = F.format_string('[%s, "%s", %s]', "props", "event_type", "props")
    payload = events.select("event_id", F.when(F.col("event_type") == "view", F.col("props")).otherwise(listed).alias("body"))
    rows = readers.json_records_to_rows(payload, "body")
    return rows.select(
        "event_id", F.get_json_object("record", "$.k").alias("k"), F.get_json_object("record", "$.value").alias("scalar")
    )


@check(
    "A7_ingest_many",
    """SELECT 'customer' AS target_table, 'success' AS status, count(*) AS records FROM customer
       UNION ALL SELECT 'lineitem', 'success', count(*) FROM lineitem
       UNION ALL SELECT 'no_such_file', 'error', 0""",
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{sf_dir}/{name}.parquet" for name in ("customer", "no_such_file", "lineitem")]
    results = ingest.ingest_many(spark, paths, "parquet", scratch_path(spark, "bronze"), STAMP)
    return results.select("target_table", "status", "records")


@check(
    "A7_equal_base_names",
    """SELECT target, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'part' ELSE 'part_2' END AS target FROM customer) GROUP BY target""",
)
def a7_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one name in two folders, each with half of the customers."""
    customers, folders, out = table(spark, sf_dir, "customer"), [scratch_path(spark, side) for side in "ab"], scratch_path(spark, "bronze")
    for rest, folder in enumerate(folders):
        customers.where(F.col("c_custkey") % 2 == rest).write.parquet(f"{folder}/part.parquet")
    done = ingest.ingest_many(spark, [f"{folder}/part.parquet" for folder in folders], "parquet", out, STAMP)
    stored = [spark.read.parquet(f"{out}/{r['target_table']}").select(F.lit(r["target_table"]).alias("target")) for r in done.collect()]
    return reduce(DataFrame.unionByName, stored).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A7_quoted_line_breaks",
    """SELECT c_custkey, reader, 'name ' || chr(10) || ' "of" ' || c_name AS name FROM (SELECT *, unnest(['batch', 'single']) AS reader FROM customer)""",
)
def a7_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with quoted line breaks through both readers."""
    path = scratch_path(spark, "broken-lines")
    name = F.concat(F.lit('name \n "of" '), "c_name").alias("name")
    table(spark, sf_dir, "customer").select("c_custkey", name).write.option("header", True).option("escape", '"').csv(path)
    both = {"batch": readers.read_batch(spark, [path], "csv"), "single": readers.read_csv_strings(spark, path)}
    shown = [df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.lit(which).alias("reader"), "name") for which, df in both.items()]
    return reduce(DataFrame.unionByName, shown)


@check(
    "A7_batch_file_counts",
    """SELECT 'orders.parquet' AS source_file, 'orders' AS target_table, count(*) AS records FROM orders""",
)
def a7_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.file_counts(readers.read_batch(spark, [f"{sf_dir}/orders.parquet"]))


@check(
    "A8_target_name",
    """SELECT page_id, split_part(regexp_extract(url, '([^/]*)$', 1), '.', 1) AS file_target,
       lower(regexp_replace(regexp_extract(url, '([^/.]*)$', 1), '[^a-zA-Z0-9_]', '', 'g')) AS query_target FROM pages""",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.concat(F.lit('SELECT a, b from "raw".'), F.regexp_extract("url", r"([^/.]*)$", 1), F.lit(", other"))
    return table(spark, sf_dir, "pages").select(
        "page_id", file_target_name(F.col("url")).alias("file_target"), query_target_name(sql).alias("query_target")
    )


@check("A9_to_string_columns", as_text("lineitem"))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.string_columns(table(spark, sf_dir, "lineitem"))


BROKEN = """replace(replace(replace(replace(replace(replace(text, 'è', 'â€™'), 'à', 'â€œ'), 'ü', 'â€¢'), 'ö', 'â€¦'),
 'ß', 'â€"'), 'ä', 'â€')"""
REPAIRED = """replace(replace(replace(replace(replace(replace(text, 'è', ''''), 'à', '"'), 'ü', '•'), 'ö', '…'),
 'ß', '—'), 'ä', '"')"""


@check(
    "A10_clean_text",
    f"""SELECT doc_id, regexp_replace(regexp_replace({REPAIRED},
        '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'),
        '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS text FROM documents""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\x01  "), F.expr(BROKEN.replace("'â€\"'", "'â€\"'")), F.lit("\U0001F600\x07\t "))
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(text).alias("text"))


@check("A11_stamp_load", f"SELECT o_orderkey, '{STAMP}' AS create_date FROM orders")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stamp_load(table(spark, sf_dir, "orders").select("o_orderkey"), STAMP)


@check(
    "A12_add_load_metadata",
    f"SELECT s_suppkey, '{STAMP}' AS _loaded_at, 'src_1' AS _source_id, 'batch_7' AS _batch_id FROM supplier",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.add_load_metadata(
        table(spark, sf_dir, "supplier").select("s_suppkey"), "src_1", "batch_7", F.lit(STAMP)
    )


@check(
    "A13_nan_to_null",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS l_discount FROM lineitem",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    broken = lines.withColumn("l_discount", F.when(F.col("l_discount") == 0.05, float("nan")).otherwise(F.col("l_discount")))
    return ingest.nan_to_null(broken)


def catalog_name(kind: str) -> str:
    """A table name of its own for each run."""
    return f"{kind}_{uuid.uuid4().hex}"


@check("A14_replace_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = catalog_name("replaced")
    writers.replace_table(table(spark, sf_dir, "customer").limit(0), name)
    writers.replace_table(table(spark, sf_dir, "customer"), name)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@check("A15_append_table", "SELECT c_mktsegment, 2 * count(*) AS n FROM customer GROUP BY c_mktsegment")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, rows = catalog_name("appended"), table(spark, sf_dir, "customer")
    writers.append_table(rows, name)
    writers.append_table(rows, name)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A16_schema_diff",
    """SELECT * FROM (VALUES ('l_extendedprice', 'string', 'numeric', 'type_mismatch', 'warning'),
       ('l_comment', 'string', NULL, 'missing_column', 'error'))
       t(column_name, expected_type, actual_type, finding, severity)
       WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover({"lineitem": ingest.land(table(spark, sf_dir, "lineitem"), STAMP)}).select(
        F.col("original_column_name").alias("column_name"), F.col("inferred_type").alias("type_name")
    )
    expected = ingest.schema_frame(
        spark, {"l_orderkey": "string", "l_extendedprice": "string", "l_tax": "numeric", "l_comment": "string"}
    )
    return ingest.schema_diff(expected, found)


@check(
    "A17_merge_parts",
    "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kinds = [F.col("event_type") == "view", F.col("event_type") == "click",
             ~F.col("event_type").isin("view", "click")]
    parts = [events.where(k).select(*order) for k, order in zip(kinds, (events.columns, events.columns[::-1], events.columns))]
    return readers.merge_parts(parts).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A18_load_summary",
    """SELECT count(*) FILTER (event_type <> 'error') AS total_records,
       count(DISTINCT (user_id, event_type)) AS total_parts,
       count(DISTINCT (user_id, event_type)) FILTER (event_type <> 'error') AS successful_parts,
       count(DISTINCT (user_id, event_type)) FILTER (event_type = 'error') AS failed_parts,
       round(count(*) FILTER (event_type <> 'error') / 8.0, 6) AS records_per_second FROM events""",
)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("records"))
    results = parts.withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("success"))
    return ingest.load_summary(results, 8.0).withColumn("records_per_second", F.round("records_per_second", 6))


@check(
    "A19_export_catalog",
    f"WITH {catalog_cte()} " + " UNION ALL ".join(f"SELECT '{fmt}' AS format, table_name, column_name, cardinality FROM catalog" for fmt in ("json", "csv")),
)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, out = cut_lineage(catalog_profile(star(spark, sf_dir))), []  # stored once, written in both formats
    for fmt in ("json", "csv"):
        path = scratch_path(spark, "catalog")
        writers.export_catalog(catalog, path, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        out.append(back.select(F.lit(fmt).alias("format"), "table_name", "column_name",
                               F.col("cardinality").cast("bigint").alias("cardinality")))
    return out[0].unionByName(out[1])


@check("A20_incremental_ingest", as_text("customer", f", '{STAMP}' AS create_date"))
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer")
    incoming, target, progress = (scratch_path(spark, n) for n in ("incoming", "landed", "progress"))
    source.where(F.col("c_mktsegment") == "BUILDING").write.mode("append").parquet(incoming)
    incremental_ingest(spark, incoming, source.schema, target, progress, STAMP).awaitTermination()
    source.where(F.col("c_mktsegment") != "BUILDING").write.mode("append").parquet(incoming)
    incremental_ingest(spark, incoming, source.schema, target, progress, STAMP).awaitTermination()
    return spark.read.parquet(target)
