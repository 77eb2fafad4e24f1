"""Config-driven cleansing: map, convert, cleanse, filter, aggregate, in that order."""

from __future__ import annotations

from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from starloom.functions.text import clean_string, strip
from starloom.functions.values import parse_datetime, to_double, to_long_coerced
from starloom.operators.ordering import carry_fill, global_position, running_total


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename; names the frame does not have are ignored."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def convert_column(df: DataFrame, column: str, kind: str) -> Column:
    """Conversion expression of one column; unreadable values become NULL."""
    value = F.col(column)
    is_text = _is_text(df, column)
    if kind == "string":
        return value.cast("string")
    if kind == "int":
        if is_text:
            return to_long_coerced(value)
        return F.when(value == F.floor(value), value.try_cast("bigint"))
    if kind == "float":
        return to_double(value) if is_text else value.cast("double")
    if kind == "datetime":
        return parse_datetime(strip(value)) if is_text else value.try_cast("timestamp")
    if kind == "boolean":
        return F.length(value) > 0 if is_text else value.cast("double") != 0
    raise ValueError(f"unknown conversion: {kind}")


def convert_columns(df: DataFrame, conversions: dict[str, str]) -> DataFrame:
    known = {c: k for c, k in conversions.items() if c in df.columns}
    return df.withColumns({c: convert_column(df, c, k) for c, k in known.items()}) if known else df


def handle_nulls(df: DataFrame, strategy: str, value: Any = "", order: list[str] | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """``drop`` rows with a NULL, ``fill`` with a constant, or carry values ``forward_fill``/``backward_fill``."""
    if strategy == "drop":
        return df.dropna("any")
    if strategy == "fill":
        return df.fillna(value)
    if strategy in ("forward_fill", "backward_fill"):
        if not order:
            raise ValueError("filling from neighbours needs an explicit row order")
        fixed = set(order) | set(keys or [])
        columns = [c for c in df.columns if c not in fixed]
        return carry_fill(df, columns, order, keys, backward=strategy == "backward_fill")
    raise ValueError(f"unknown NULL strategy: {strategy}")


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def trim_whitespace(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in text_columns(df)})


def remove_special_chars(df: DataFrame, characters: str) -> DataFrame:
    """Delete the characters of a regex class from every text column."""
    return df.withColumns({c: F.regexp_replace(F.col(c), f"[{characters}]", "") for c in text_columns(df)})


def filter_condition(column: str, operator: str, value: Any) -> Column:
    """Predicate of one filter; negative ones keep NULL rows."""
    col = F.col(column)
    if operator == "equals":
        return col == value
    if operator == "not_equals":
        return ~col.eqNullSafe(F.lit(value))
    if operator == "greater_than":
        return col > value
    if operator == "less_than":
        return col < value
    matched = F.coalesce(col.rlike(value), F.lit(False))
    if operator == "contains":
        return matched
    if operator == "not_contains":
        return ~matched
    raise ValueError(f"unknown filter operator: {operator}")


def filter_rows(df: DataFrame, filters: list[dict[str, Any]]) -> DataFrame:
    for one in filters:
        if one["column"] in df.columns:
            df = df.where(filter_condition(one["column"], one["operator"], one["value"]))
    return df


# Aggregate names of the configuration and the functions they stand for.
AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
}
ORDERED_AGGREGATES = ("first", "last")
MEDIAN = "median"


def _aggregate_column(column: str, name: str, order: str | None) -> Column:
    value = F.col(column)
    if name in ORDERED_AGGREGATES:
        if order is None:
            raise ValueError(f"{name} needs an explicit row order")
        seen = F.when(value.isNotNull(), F.col(order))
        return F.min_by(value, seen) if name == "first" else F.max_by(value, seen)
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    return AGGREGATES[name](value)


def _medians(df: DataFrame, group_by: list[str], column: str, output: str) -> DataFrame:
    """Exact medians by position. Equal values are counted first, so neither a group nor a value gathers in a task."""
    known = df.where(F.col(column).isNotNull()).select(*group_by, F.col(column).cast("double").alias("_value"))
    counted = known.groupBy(*group_by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, "_n", ["_value"], group_by, "_upto")
    sizes = counted.groupBy(*group_by).agg(F.sum("_n").alias("_size"))

    def holds(position: Column) -> Column:
        return ((F.col("_upto") - F.col("_n") < position) & (position <= F.col("_upto"))).cast("int")

    halves = holds(F.floor((F.col("_size") + 1) / 2)) + holds(F.floor(F.col("_size") / 2) + 1)
    middle = placed.join(sizes, group_by).withColumn("_halves", halves).where(F.col("_halves") > 0)
    return middle.groupBy(*group_by).agg((F.sum(F.col("_value") * F.col("_halves")) / 2).alias(output))


def aggregate(df: DataFrame, group_by: list[str], functions: dict[str, str | list[str]],
              order: str | None = None) -> DataFrame:
    """Grouped aggregates; rows with a NULL key are dropped; nothing happens unless both parts are given.

    One function per column keeps the column name, several give ``<column>_<function>``. ``first`` and
    ``last`` take the order column.
    """
    if not group_by or not functions:
        return df
    keyed, outputs, medians, names = df.dropna(subset=group_by), [], [], list(group_by)
    for column, wanted in functions.items():
        for name in [wanted] if isinstance(wanted, str) else wanted:
            output = column if isinstance(wanted, str) else f"{column}_{name}"
            names.append(output)
            if name == MEDIAN:
                medians.append((column, output))
            else:
                outputs.append(_aggregate_column(column, name, order).alias(output))
    grouped = keyed.groupBy(*group_by)
    result = grouped.agg(*outputs) if outputs else keyed.select(*group_by).distinct()
    for column, output in medians:
        result = result.join(_medians(keyed, group_by, column, output), group_by, "left")
    return result.select(*names)


def transform(df: DataFrame, config: dict[str, Any], seen: tuple[Observation, Observation] | None = None) -> DataFrame:
    """All steps of a configuration in the fixed order.

    ``seen`` may name two observations that receive the input and output row counts (``rows``) as a
    by-product of the job that runs the result.
    """
    if seen:
        df = df.observe(seen[0], F.count(F.lit(1)).alias("rows"))
    if "column_mappings" in config:
        df = map_columns(df, config["column_mappings"])
    if "select_columns" in config:
        df = select_columns(df, config["select_columns"])
    if "type_conversions" in config:
        df = convert_columns(df, config["type_conversions"])
    cleansing = config.get("cleansing", {})
    if "null_handling" in cleansing:
        rule = cleansing["null_handling"]
        df = handle_nulls(df, rule["strategy"], rule.get("value", ""), rule.get("order"), rule.get("keys"))
    if cleansing.get("remove_duplicates"):
        df = remove_duplicates(df)
    if cleansing.get("trim_whitespace"):
        df = trim_whitespace(df)
    if "remove_special_chars" in cleansing:
        df = remove_special_chars(df, cleansing["remove_special_chars"])
    if "filters" in config:
        df = filter_rows(df, config["filters"])
    if "aggregations" in config:
        rule = config["aggregations"]
        df = aggregate(df, rule.get("group_by", []), rule.get("functions", {}), rule.get("order"))
    if seen:
        df = df.observe(seen[1], F.count(F.lit(1)).alias("rows"))
    return df


def flatten_nested(df: DataFrame, separator: str = "_", max_depth: int | None = None) -> DataFrame:
    """Struct fields become ``a_b`` columns, list items ``a_0``, ``a_1``, ...

    The number of list columns is the longest list in the data, found by one aggregate for all lists of
    a level. All levels of the schema are flattened; with ``max_depth``, values below it stay as JSON text.
    """
    for _ in count() if max_depth is None else range(max_depth + 1):
        lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        structs = [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]
        if not lists and not structs:
            return df
        longest = (
            df.agg(*[F.max(F.size(F.col(f"`{n}`"))).alias(n) for n in lists]).first().asDict() if lists else {}
        )
        columns: list[Column] = []
        for field in df.schema:
            value = F.col(f"`{field.name}`")
            if field.name in structs:
                columns += [
                    value.getField(child).alias(f"{field.name}{separator}{child}") for child in field.dataType.names
                ]
            elif field.name in lists:
                columns += [
                    F.get(value, F.lit(i)).alias(f"{field.name}{separator}{i}")
                    for i in range(max(longest[field.name] or 0, 0))
                ]
            else:
                columns.append(value)
        df = df.select(*columns)
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    return df.withColumns({n: F.to_json(F.col(f"`{n}`")) for n in nested}) if nested else df


def _json_depth(df: DataFrame, text: str) -> int:
    """Deepest nesting of the JSON documents, from one aggregate over their brackets."""
    outside_strings = F.regexp_replace(F.col(text), r'"(\\.|[^"\\])*"', "")
    brackets = F.split(F.regexp_replace(outside_strings, r"[^{}\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))

    def step(seen: Column, mark: Column) -> Column:
        now = seen["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["deepest"], now).alias("deepest"))

    deepest = F.aggregate(brackets, start, step, lambda seen: seen["deepest"])
    return df.agg(F.max(F.when(F.try_parse_json(F.col(text)).isNotNull(), deepest))).first()[0] or 0


def flatten_json_paths(df: DataFrame, text: str, keys: list[str], separator: str = "_",
                       max_depth: int | None = None) -> DataFrame:
    """Ragged JSON text to long rows (keys, path, value): one row per leaf, whatever the documents hold.

    All levels of the documents are followed; with ``max_depth``, values below it stay as JSON text.
    """
    spark = df.sparkSession
    depth = _json_depth(df, text) if max_depth is None else min(_json_depth(df, text), max_depth)
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("node")).where(
        F.col("node").isNotNull()
    )
    leaves: list[DataFrame] = []
    for step_no in range(depth + 1):
        kind = F.schema_of_variant(F.col("node"))
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        if step_no == depth:
            value = F.when(nested, F.to_json("node")).otherwise(F.variant_get("node", "$", "string"))
            leaves.append(level.select(*keys, "path", value.alias("value")))
            break
        leaves.append(
            level.where(~nested).select(*keys, "path", F.variant_get("node", "$", "string").alias("value"))
        )
        exploded = level.where(nested).lateralJoin(
            spark.tvf.variant_explode(F.col("node").outer()).select(
                F.col("pos"), F.col("key"), F.col("value").alias("child")
            )
        )
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        level = exploded.select(
            *keys,
            F.when(F.col("path") == "", step).otherwise(F.concat(F.col("path"), F.lit(separator), step)).alias("path"),
            F.col("child").alias("node"),
        )
    return reduce(DataFrame.unionByName, leaves).where(F.col("path") != "")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Clean every text column, then make those numeric whose values all parse as numbers.

    Whole numbers become bigint, or a decimal without fraction where some do not fit, so none is rounded; other
    numbers become double. Whole numbers of more than 38 digits stay text. One aggregate over all columns decides;
    only its single row reaches the driver.
    """
    names = text_columns(df)
    cleaned = df.withColumns({c: clean_string(F.col(c)) for c in names})
    if not names:
        return cleaned

    def every(c: str, holds: Column) -> Column:
        return F.coalesce(F.bool_and(F.col(c).isNull() | holds), F.lit(False)) & (F.count(F.col(c)) > 0)

    def whole(c: str) -> Column:
        return F.col(c).rlike("^[+-]?[0-9]+$")

    tests = {  # casts of other texts fail slowly, and count only where all are whole numbers
        "double": lambda c: to_double(F.col(c)).isNotNull(),
        "whole": whole,
        "bigint": lambda c: whole(c) & F.col(c).try_cast("bigint").isNotNull(),
        "decimal(38,0)": lambda c: whole(c) & F.col(c).try_cast("decimal(38,0)").isNotNull(),
    }
    found = cleaned.agg(*[every(c, test(c)).alias(f"{kind} {c}") for c in names for kind, test in tests.items()]).first().asDict()
    changed = {}
    for c in names:
        if found[f"whole {c}"]:
            fitting = next((kind for kind in ("bigint", "decimal(38,0)") if found[f"{kind} {c}"]), None)
            if fitting:
                changed[c] = F.col(c).cast(fitting)
        elif found[f"double {c}"]:
            changed[c] = to_double(F.col(c))
    return cleaned.withColumns(changed)


def detect_data_types(df: DataFrame) -> DataFrame:
    """Broad kind of each column by storage type; text with few distinct values is ``categorical``.

    Booleans are a kind of their own, and days count as ``datetime`` like instants.
    """
    from starloom.operators.profile import column_statistics

    stats = column_statistics({"input": df})
    kind = F.col("type_name")
    return stats.select(
        "column_name",
        F.when(kind == "UInt8", "boolean")
        .when(kind.isin("Int32", "Int64"), "integer")
        .when(kind.startswith("Float"), "float")
        .when(kind.rlike("^(U?Int|Decimal)"), "numeric")
        .when(kind.isin("DateTime", "Date"), "datetime")
        .when(F.col("cardinality") < F.col("row_count") * 0.5, "categorical")
        .otherwise("string")
        .alias("data_type"),
    )
