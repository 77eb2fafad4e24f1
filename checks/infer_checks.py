"""Type inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.common import STAR_SCHEMA, check, long_cte, star, strip_sql, table
from starloom.functions import values
from starloom.operators import infer

# Order dates rendered in each layout, some of them spoiled.
RENDERED = {
    "YYYYMMDD": ("yyyyMMdd", "%Y%m%d"),
    "YYYY-MM-DD": ("yyyy-MM-dd", "%Y-%m-%d"),
    "MM/DD/YYYY": ("MM/dd/yyyy", "%m/%d/%Y"),
    "DD-MM-YYYY": ("dd-MM-yyyy", "%d-%m-%Y"),
}
LABELS = {"YYYYMMDD": "compact_date", "YYYY-MM-DD": "iso_date", "MM/DD/YYYY": "us_date", "DD-MM-YYYY": "european_date"}
SPOILED = {"YYYYMMDD": "20230231", "YYYY-MM-DD": "2023-13-01", "MM/DD/YYYY": "13/13/2023", "DD-MM-YYYY": "31-02-2023"}


def rendered(layout: str) -> Column:
    return F.when(F.col("o_orderstatus") == "F", SPOILED[layout]).otherwise(F.date_format("o_orderdate", RENDERED[layout][0]))


def _register_layout(number: int, layout: str) -> None:
    shown = RENDERED[layout][1]

    @check(
        f"D{number}_match_{LABELS[layout]}",
        f"""SELECT o_orderkey, true AS matched, o_orderstatus <> 'F' AS valid,
            CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
            false AS name_matched FROM orders WHERE strftime(o_orderdate, '{shown}') IS NOT NULL""",
    )
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = rendered(layout)
        return table(spark, sf_dir, "orders").select(
            "o_orderkey", values.matches_date_pattern(text, layout).alias("matched"),
            values.valid_for_pattern(text, layout).alias("valid"),
            values.date_by_pattern(text, layout).cast("string").alias("day"),
            values.matches_date_pattern(F.col("o_orderpriority"), layout).alias("name_matched"),
        )


for _number, _layout in enumerate(RENDERED, 1):
    _register_layout(_number, _layout)


@check(
    "D5_match_unix_timestamp",
    """SELECT event_id, event_type <> 'view' AS matched, event_type NOT IN ('view', 'click') AS valid,
       CASE WHEN event_type NOT IN ('view', 'click') THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    text = F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).when(
        F.col("event_type") == "click", "9999999999").otherwise(seconds)
    return table(spark, sf_dir, "events").select(
        "event_id", values.matches_date_pattern(text, "Unix Timestamp").alias("matched"),
        values.valid_for_pattern(text, "Unix Timestamp").alias("valid"),
        values.date_by_pattern(text, "Unix Timestamp").cast("string").alias("day"),
    )


@check(
    "D6_match_iso_datetime",
    """SELECT event_id, true AS matched, event_type <> 'click' AS valid,
       CASE WHEN event_type <> 'click' THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        F.col("event_type") == "click", "2023-02-30T10:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return table(spark, sf_dir, "events").select(
        "event_id", values.matches_date_pattern(text, "ISO DateTime").alias("matched"),
        values.valid_for_pattern(text, "ISO DateTime").alias("valid"),
        values.date_by_pattern(text, "ISO DateTime").cast("string").alias("day"),
    )


def rendered_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return infer.long_values(orders.select(*[rendered(layout).alias(layout) for layout in RENDERED]), "orders")


RENDERED_LONG = "rendered AS (" + " UNION ALL ".join(
    f"SELECT 'orders' AS table_name, '{layout}' AS column_name, CASE WHEN o_orderstatus = 'F' THEN '{SPOILED[layout]}' "
    f"ELSE strftime(o_orderdate, '{fmt}') END AS value FROM orders" for layout, (_, fmt) in RENDERED.items()
) + ")"

PATTERN_SQL = {
    "YYYYMMDD": ("'^\\d{8}$'", 0.9, "try_strptime(v, '%Y%m%d') IS NOT NULL AND TRY_CAST(left(v, 4) AS INT) BETWEEN 1900 AND 2100"),
    "YYYY-MM-DD": ("'^\\d{4}-\\d{2}-\\d{2}$'", 0.95, "try_strptime(v, '%Y-%m-%d') IS NOT NULL"),
    "MM/DD/YYYY": ("'^\\d{1,2}/\\d{1,2}/\\d{4}$'", 0.9, "try_strptime(v, '%m/%d/%Y') IS NOT NULL"),
    "DD-MM-YYYY": ("'^\\d{1,2}-\\d{1,2}-\\d{4}$'", 0.9, "try_strptime(v, '%d-%m-%Y') IS NOT NULL"),
    "Unix Timestamp": ("'^\\d{10}$'", 0.8, "TRY_CAST(v AS BIGINT) BETWEEN 0 AND 4102444800"),
    "ISO DateTime": ("'^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}'", 0.95, "TRY_CAST(replace(left(v, 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL"),
}


def date_scores_sql(source: str, rate: str = "0") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT table_name, column_name, '{p}' AS pattern, {i} AS ord, {base} AS base, count(*) AS n,
            count(*) FILTER (regexp_matches(v, {rx})) AS m, count(*) FILTER (regexp_matches(v, {rx}) AND ({valid})) AS ok
            FROM (SELECT table_name, column_name, {strip_sql('value')} AS v FROM {source}) GROUP BY ALL"""
        for i, (p, (rx, base, valid)) in enumerate(PATTERN_SQL.items())
    )
    return f"""scores AS (SELECT table_name, column_name, pattern, ord, m * 1.0 / n AS match_ratio, ok * 1.0 / m AS valid_ratio,
        base * (m * 1.0 / n) * (ok * 1.0 / m) * (0.8 + 0.2 * ({rate})) AS confidence FROM ({parts}) WHERE m > 0)"""


@check(
    "D7_date_confidence",
    f"""WITH {RENDERED_LONG}, {date_scores_sql('rendered')}
        SELECT column_name, pattern, round(match_ratio, 6) AS match_ratio, round(valid_ratio, 6) AS valid_ratio,
        round(confidence, 6) AS confidence FROM scores""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = infer.date_scores(rendered_long(spark, sf_dir))
    return scores.select("column_name", "pattern", *[F.round(c, 6).alias(c) for c in ("match_ratio", "valid_ratio", "confidence")])


SHAPES = "regexp_matches(v, '^\\d+\\.\\d+$') THEN 'decimal' WHEN regexp_matches(v, '^\\d+$') THEN 'integer' WHEN regexp_matches(v, '^\\$?\\d+(?:,\\d{3})*(?:\\.\\d{2})?$') THEN 'currency' WHEN regexp_matches(v, '^\\d+(?:\\.\\d+)?%$') THEN 'percentage' WHEN regexp_matches(v, '^\\d+(?:\\.\\d+)?[eE][+-]?\\d+$') THEN 'scientific' WHEN regexp_matches(v, '^-\\d+(?:\\.\\d+)?$') THEN 'negative_number'"


def lineitem_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    shown = (
        F.when(F.col("l_linenumber") == 1, price.cast("string"))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("$"), F.format_number(price, 2)))
        .when(F.col("l_linenumber") == 3, F.concat(F.col("l_tax").cast("string"), F.lit("%")))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("-"), F.col("l_quantity").cast("string")))
        .when(F.col("l_linenumber") == 5, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("e+04")))
        .when(F.col("l_linenumber") == 6, F.col("l_orderkey").cast("string"))
        .otherwise(F.col("l_returnflag"))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"))


@check(
    "D8_numeric_pattern",
    f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'decimal' WHEN 2 THEN 'currency' WHEN 3 THEN 'percentage'
        WHEN 4 THEN 'negative_number' WHEN 5 THEN 'scientific' WHEN 6 THEN 'integer' END AS shape,
        round(CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice WHEN 3 THEN l_tax WHEN 4 THEN -l_quantity
        WHEN 5 THEN l_quantity * 10000 WHEN 6 THEN l_orderkey END, 4) AS number FROM lineitem""",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_shapes(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", values.numeric_pattern(F.col("shown")).alias("shape"),
        F.round(values.loose_number(F.col("shown")), 4).alias("number"),
    )


def star_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [infer.long_values(df, name) for name, df in star(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


STAR_LONG = long_cte(list(STAR_SCHEMA))


def sample_cte(n: int | None = None) -> str:
    """All distinct values with their rank, or the first n of each column."""
    return f"""{STAR_LONG}, sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS rank
        FROM (SELECT DISTINCT * FROM cells WHERE value IS NOT NULL AND value <> '')) {f"WHERE rank <= {n}" if n else ""})"""


def features_sql(source: str) -> str:
    return f"""feats AS (SELECT table_name, column_name, count(*) AS n, count(shape) * 1.0 / count(*) AS pattern_ratio,
      count(*) FILTER (shape = 'decimal') * 1.0 / count(*) AS decimal_ratio,
      coalesce(CASE WHEN count(num) > 1 AND stddev_pop(num) > 0 THEN 1 / (1 + stddev_pop(num) / avg(abs(num))) END, 0) AS range_consistency,
      1 / (1 + stddev_pop(length(v)) / greatest(1.0, avg(length(v)))) AS length_consistency
      FROM (SELECT *, CASE WHEN {SHAPES} END AS shape, TRY_CAST(regexp_replace(v, '[,$%]', '', 'g') AS DOUBLE) AS num
        FROM (SELECT table_name, column_name, {strip_sql('value')} AS v FROM {source})) GROUP BY table_name, column_name),
     numeric AS (SELECT *, least(1.0, pattern_ratio * 0.4 + decimal_ratio * 0.2 + range_consistency * 0.2 + length_consistency * 0.1)
       AS numeric_confidence FROM feats)"""


FEATURES = ("pattern_ratio", "decimal_ratio", "range_consistency", "length_consistency")


@check(
    "D9_numeric_features",
    f"WITH {STAR_LONG.replace('SELECT DISTINCT', 'SELECT')}, {features_sql('cells')} SELECT table_name, column_name, n, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM feats",
)
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = infer.numeric_features(star_values(spark, sf_dir))
    return features.select("table_name", "column_name", "n", *[F.round(c, 6).alias(c) for c in FEATURES])


@check(
    "D10_numeric_confidence",
    f"WITH {sample_cte()}, {features_sql('sampled')} SELECT table_name, column_name, round(numeric_confidence, 6) AS numeric_confidence, "
    "numeric_confidence > 0.7 AS is_numeric FROM numeric",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.numeric_confidence(infer.distinct_values(star_values(spark, sf_dir))).select(
        "table_name", "column_name", F.round("numeric_confidence", 6).alias("numeric_confidence"), "is_numeric"
    )


def inferred_cte(source: str) -> str:
    """scores, feats, numeric, inferred over a sample CTE."""
    return f"""{date_scores_sql(source)}, {features_sql(source)},
     best AS (SELECT table_name, column_name, arg_max(pattern, (confidence, -ord)) AS date_pattern, max(confidence) AS dc
       FROM scores GROUP BY table_name, column_name),
     inferred AS (SELECT table_name, column_name, coalesce(dc, 0) AS dc, numeric_confidence AS nc,
       CASE WHEN coalesce(dc, 0) > 0.7 THEN 'date' WHEN numeric_confidence > 0.7 THEN 'numeric' ELSE 'string' END AS inferred_type,
       CASE WHEN coalesce(dc, 0) > 0.7 THEN date_pattern WHEN numeric_confidence > 0.7 THEN 'numeric_measure' END AS pattern,
       CASE WHEN coalesce(dc, 0) > 0.7 THEN dc WHEN numeric_confidence > 0.7 THEN numeric_confidence
         ELSE greatest(0.1, 1.0 - greatest(coalesce(dc, 0), numeric_confidence)) END AS type_confidence
       FROM numeric LEFT JOIN best USING (table_name, column_name))"""


@check(
    "D11_infer_column_types",
    f"""WITH {sample_cte()}, {inferred_cte('sampled')}, top3 AS (SELECT table_name, column_name,
          string_agg(value, '|' ORDER BY rank) AS samples FROM sampled WHERE rank <= 3 GROUP BY ALL)
        SELECT table_name, column_name, inferred_type, pattern, round(type_confidence, 6) AS type_confidence, samples
        FROM inferred JOIN top3 USING (table_name, column_name)""",
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = star_values(spark, sf_dir)
    shown = infer.distinct_sample(found, 3).groupBy("table_name", "column_name").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples")
    )
    return infer.infer_types(infer.distinct_values(found)).join(shown, ["table_name", "column_name"]).select(
        "table_name", "column_name", "inferred_type", "pattern", F.round("type_confidence", 6).alias("type_confidence"), "samples"
    )


@check(
    "D11_infer_date_layouts",
    f"""WITH {RENDERED_LONG}, sampled AS (SELECT DISTINCT * FROM rendered),
        {inferred_cte('sampled')} SELECT column_name, inferred_type, pattern, round(type_confidence, 6) AS type_confidence FROM inferred""",
)
def d11_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_types(infer.distinct_values(rendered_long(spark, sf_dir))).select(
        "column_name", "inferred_type", "pattern", F.round("type_confidence", 6).alias("type_confidence")
    )


def misleading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column whose smallest values are dates and whose other values are names."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    dates = orders.where("o_orderkey <= 28").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("mixed"))
    return infer.long_values(dates.union(parts.select(F.concat(F.lit("z"), "p_name"))), "mixed")


@check(
    "D11_smallest_values_mislead",
    f"""WITH sampled AS (SELECT DISTINCT 'mixed' AS table_name, 'mixed' AS column_name, value FROM (
          SELECT strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders WHERE o_orderkey <= 28 UNION ALL SELECT 'z' || p_name FROM part)),
        {inferred_cte('sampled')} SELECT column_name, inferred_type, pattern, round(type_confidence, 6) AS type_confidence FROM inferred""",
)
def d11_mislead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_types(infer.distinct_values(misleading(spark, sf_dir))).select(
        "column_name", "inferred_type", "pattern", F.round("type_confidence", 6).alias("type_confidence")
    )


@check(
    "D12_stride_sample",
    f"""WITH {STAR_LONG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS position,
          count(*) OVER (PARTITION BY table_name, column_name) AS size FROM cells)
        SELECT table_name, column_name, position, value FROM (SELECT *, greatest(1, size // 100) AS step FROM numbered)
        WHERE (position - 1) % step = 0 AND position - 1 < step * 100""",
)
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = star_values(spark, sf_dir).dropDuplicates()
    return infer.stride_sample(distinct, 100)


SIMPLE_SQL = {
    "integer": r"^-?\d+$|^-?\d{1,3}(,\d{3})*$",
    "decimal": r"^-?\d+\.\d+$|^-?\d{1,3}(,\d{3})*\.\d+$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$|^\d{8}$",
    "datetime": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "boolean": r"^(true|false|yes|no|1|0|y|n)$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
}


@check(
    "D13_infer_types_regex",
    f"""WITH {STAR_LONG.replace('SELECT DISTINCT', 'SELECT')}, first AS (SELECT table_name, column_name, value FROM cells WHERE value <> ''),
        shares AS ({' UNION ALL '.join(f"SELECT table_name, column_name, '{f}' AS family, {i} AS ord, avg(CASE WHEN regexp_matches(value, '{rx}', 'i') THEN 1.0 ELSE 0 END) AS share FROM first GROUP BY ALL" for i, (f, rx) in enumerate(SIMPLE_SQL.items()))}),
        best AS (SELECT table_name, column_name, arg_max(family, (share, -ord)) AS family, max(share) AS share FROM shares GROUP BY ALL)
        SELECT table_name, column_name, CASE WHEN share >= 0.3 THEN family ELSE 'string' END AS inferred_type,
          round(CASE WHEN share >= 0.3 THEN share ELSE 0 END, 6) AS confidence FROM best""",
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_types_simple(star_values(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@check(
    "D14_apply_feedback",
    f"""WITH {RENDERED_LONG}, rates AS (SELECT CASE event_type WHEN 'view' THEN 'YYYYMMDD' WHEN 'click' THEN 'MM/DD/YYYY'
            WHEN 'error' THEN 'DD-MM-YYYY' ELSE 'other' END AS p, avg(CASE WHEN value > 12 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1),
        {date_scores_sql('rendered', "coalesce((SELECT r FROM rates WHERE p = pattern), 0)")}
        SELECT column_name, pattern, round(confidence, 6) AS confidence FROM scores""",
)
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.when(F.col("event_type") == "view", "YYYYMMDD").when(F.col("event_type") == "click", "MM/DD/YYYY").when(
        F.col("event_type") == "error", "DD-MM-YYYY").otherwise("other")
    corrections = table(spark, sf_dir, "events").select(pattern.alias("pattern"), (F.col("value") > 12).alias("was_correct"))
    scores = infer.date_scores(rendered_long(spark, sf_dir), infer.success_rates(corrections))
    return scores.select("column_name", "pattern", F.round("confidence", 6).alias("confidence"))


@check("D15_distinct_sample", f"WITH {sample_cte(10)} SELECT table_name, column_name, rank, value FROM sampled")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.distinct_sample(star_values(spark, sf_dir), 10).select("table_name", "column_name", "rank", "value")
