"""Config-driven cleansing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Observation, functions as F

from checks.common import check, strip_sql, table
from starloom.operators import cleanse


@check("B1_map_columns", "SELECT c_custkey AS customer_key, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"c_custkey": "customer_key", "c_name": "name", "no_such": "x"}
    return cleanse.map_columns(table(spark, sf_dir, "customer"), names)


@check("B2_select_columns", "SELECT c_name AS name, c_acctbal FROM customer")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.select_columns(cleanse.map_columns(table(spark, sf_dir, "customer"), {"c_name": "name"}), ["name", "c_acctbal"])


@check(
    "B3_convert_string",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders",
)
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return cleanse.convert_columns(rows, {"price": "string", "absent": "int"})


@check(
    "B4_convert_int",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS from_text,
       CAST(l_quantity AS BIGINT) AS from_number,
       CASE WHEN l_tax = 0 THEN 0 END AS fractional FROM lineitem""",
)
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), F.col("l_orderkey"))).otherwise(F.lit("n/a"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("from_text"), F.col("l_quantity").alias("from_number"),
        F.col("l_tax").cast("string").alias("fractional"),
    )
    return cleanse.convert_columns(rows, {"from_text": "int", "from_number": "int", "fractional": "int"})


@check(
    "B5_convert_float",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem",
)
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "R", F.lit("nan?")).otherwise(F.col("l_extendedprice").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("price"))
    return cleanse.convert_columns(rows, {"price": "float"})


@check(
    "B6_convert_datetime",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day FROM orders",
)
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    text = F.when(F.col("o_orderstatus") == "F", F.lit("2001-02-30")).otherwise(
        F.coalesce(layout, F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day"))
    return cleanse.convert_columns(rows, {"day": "datetime"}).withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))


@check(
    "B7_convert_boolean",
    "SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS flag, l_discount <> 0 AS discounted FROM lineitem",
)
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), F.col("l_discount").alias("discounted"))
    return cleanse.convert_columns(rows, {"flag": "boolean", "discounted": "boolean"})


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with values removed where the type is 'error'."""
    kept = F.when(F.col("event_type") != "error", F.col("value"))
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", kept.alias("value"), kind.alias("kind"))


GAPPED = """SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS value,
 CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events"""


@check("B8_nulls_drop", f"SELECT * FROM ({GAPPED}) WHERE value IS NOT NULL AND kind IS NOT NULL")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.handle_nulls(gapped(spark, sf_dir), "drop")


@check("B9_nulls_fill", f"SELECT event_id, user_id, value, coalesce(kind, '') AS kind FROM ({GAPPED})")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.handle_nulls(gapped(spark, sf_dir), "fill", "")


@check(
    "B10_forward_fill",
    f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(kind IGNORE NULLS) OVER w AS kind
        FROM ({GAPPED}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gapped(spark, sf_dir)
    return cleanse.handle_nulls(rows, "forward_fill", order=["event_id"]).withColumn("user_id", F.col("user_id"))


@check(
    "B10_forward_fill_by_key",
    f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(kind IGNORE NULLS) OVER w AS kind
        FROM ({GAPPED}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def b10_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.handle_nulls(gapped(spark, sf_dir), "forward_fill", order=["event_id"], keys=["user_id"])


@check(
    "B11_backward_fill",
    f"""SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER w AS value, first_value(kind IGNORE NULLS) OVER w AS kind
        FROM ({GAPPED}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.handle_nulls(gapped(spark, sf_dir), "backward_fill", order=["event_id"])


@check("B12_remove_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.remove_duplicates(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@check("B13_trim_whitespace", f"SELECT doc_id, {strip_sql('text')} AS text, lang FROM documents")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n 　")).alias("text"), "lang")
    return cleanse.trim_whitespace(rows)


@check("B14_remove_special_chars", "SELECT doc_id, regexp_replace(text, '[.,;:!?*#%-]', '', 'g') AS text, regexp_replace(source, '[.,;:!?*#%-]', '', 'g') AS source FROM documents")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.remove_special_chars(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ".,;:!?*#%-")


FILTERS = {
    "B15_filter_equals": ("kind", "equals", "click", "kind = 'click'"),
    "B16_filter_not_equals": ("kind", "not_equals", "click", "kind IS DISTINCT FROM 'click'"),
    "B17_filter_greater_than": ("value", "greater_than", 12.5, "value > 12.5"),
    "B18_filter_less_than": ("value", "less_than", 12.5, "value < 12.5"),
    "B19_filter_contains": ("kind", "contains", "^c|or$", "coalesce(regexp_matches(kind, '^c|or$'), false)"),
    "B20_filter_not_contains": ("kind", "not_contains", "^c|or$", "NOT coalesce(regexp_matches(kind, '^c|or$'), false)"),
}


def _register_filter(name: str, column: str, operator: str, value: object, sql: str) -> None:
    @check(name, f"SELECT * FROM ({GAPPED}) WHERE {sql}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cleanse.filter_rows(gapped(spark, sf_dir), [{"column": column, "operator": operator, "value": value}])


for _name, _spec in FILTERS.items():
    _register_filter(_name, *_spec)


@check(
    "B21_aggregate",
    f"""SELECT kind, count(user_id) AS user_id, round(sum(value), 4) AS value_sum, max(value) AS value_max,
        round(avg(value), 6) AS value_mean, count(DISTINCT value) AS value_nunique FROM ({GAPPED}) WHERE kind IS NOT NULL GROUP BY kind""",
)
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleanse.aggregate(gapped(spark, sf_dir), ["kind"], {"user_id": "count", "value": ["sum", "max", "mean", "nunique"]})
    return out.withColumns({"value_sum": F.round("value_sum", 4), "value_mean": F.round("value_mean", 6)})


@check(
    "B21_median_of_a_repeated_value",
    """SELECT event_type, median(CASE WHEN event_id % 2 = 0 THEN 5.0 ELSE round(value, 2) END) AS value FROM events GROUP BY event_type""",
)
def b21_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("event_id") % 2 == 0, 5.0).otherwise(F.round("value", 2))
    rows = table(spark, sf_dir, "events").select("event_type", half.alias("value"))
    return cleanse.aggregate(rows, ["event_type"], {"value": "median"})


@check(
    "B21_aggregate_median_first_last",
    f"""SELECT user_id, round(median(value), 6) AS value_median, arg_min(value, event_id) FILTER (value IS NOT NULL) AS value_first,
        arg_max(value, event_id) FILTER (value IS NOT NULL) AS value_last FROM ({GAPPED}) GROUP BY user_id""",
)
def b21_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleanse.aggregate(gapped(spark, sf_dir), ["user_id"], {"value": ["median", "first", "last"]}, order="event_id")
    return out.withColumn("value_median", F.round("value_median", 6))


@check(
    "B22_flatten_nested",
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS body_k, event_type AS body_kinds_0,
       CASE WHEN event_type = 'view' THEN 'seen' END AS body_kinds_1, value AS body_inner_0_v FROM events""",
)
def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "view", F.array("event_type", F.lit("seen"))).otherwise(F.array("event_type"))
    body = F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), kinds.alias("kinds"),
        F.array(F.struct(F.col("value").alias("v"))).alias("inner"),
    )
    return cleanse.flatten_nested(table(spark, sf_dir, "events").select("event_id", body.alias("body")))


@check(
    "B22_flatten_json_paths",
    """SELECT event_id, 'a_k' AS path, CAST(props->>'$.k' AS VARCHAR) AS value FROM events
       UNION ALL SELECT event_id, 'list_0', event_type FROM events
       UNION ALL SELECT event_id, 'list_1_k', CAST(props->>'$.k' AS VARCHAR) FROM events""",
)
def b22_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string('{"a": %s, "list": ["%s", %s]}', "props", "event_type", "props")
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return cleanse.flatten_json_paths(rows, "body", ["event_id"])


CONFIG = {
    "column_mappings": {"o_orderstatus": "status", "o_totalprice": "price"},
    "select_columns": ["o_orderkey", "status", "price", "o_orderpriority"],
    "type_conversions": {"price": "int"},
    "cleansing": {"null_handling": {"strategy": "fill", "value": -1}, "remove_duplicates": True,
                  "trim_whitespace": True, "remove_special_chars": "0-9-"},
    "filters": [{"column": "status", "operator": "not_equals", "value": "P"}],
    "aggregations": {"group_by": ["o_orderpriority"], "functions": {"price": ["max", "count"], "o_orderkey": "count"}},
}


@check(
    "B23_transform",
    f"""WITH c AS (SELECT o_orderkey, o_orderstatus AS status,
          coalesce(CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END, -1) AS price,
          {strip_sql("o_orderpriority")} AS p FROM orders)
        SELECT regexp_replace(p, '[0-9-]', '', 'g') AS o_orderpriority, max(price) AS price_max, count(price) AS price_count,
          count(o_orderkey) AS o_orderkey FROM c WHERE status IS DISTINCT FROM 'P' GROUP BY 1""",
)
def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.transform(table(spark, sf_dir, "orders"), CONFIG, (Observation(), Observation()))
