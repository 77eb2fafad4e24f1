"""Storage type names and the rules that read column and table names.

The rules test the *type name* of a column by substring, so every Spark type is first turned into
one of the names below (``Int64``, ``Float64``, ``String``, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Spark simple type -> storage type name.
TYPE_NAMES = {
    "string": "String",
    "date": "Date",
    "timestamp": "DateTime",
    "timestamp_ntz": "DateTime",
    "tinyint": "Int8",
    "smallint": "Int16",
    "int": "Int32",
    "bigint": "Int64",
    "float": "Float32",
    "double": "Float64",
    "boolean": "UInt8",
}

# Integer and float types that may be joined with each other.
NUMERIC_FAMILY = [
    "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64",
]

# Word lists of the measure rule, tried in this order.
CALENDAR_TABLE_WORDS = ["calendar", "time", "date", "dim"]
KEY_COLUMN_WORDS = ["_id", "_key", "id_", "key_"]
ATTRIBUTE_COLUMN_WORDS = [
    "_num", "_code", "_flag", "is_", "has_", "working", "_year", "_day", "_month", "_qtr", "_week",
]
MEASURE_COLUMN_WORDS = [
    "amount", "total", "sum", "quantity", "count", "value", "price", "cost", "revenue", "sales_amount",
]
MEASURE_TYPE_WORDS = ["float", "int", "uint", "decimal", "numeric"]

# Name endings used by the classifier that explains itself.
IDENTIFIER_ENDINGS = ["id", "key", "code", "num", "no", "name"]
MEASURE_ENDINGS = [
    "amount", "cost", "price", "value", "quantity", "qty", "count", "total", "sum", "avg", "rate",
]

# Hints of the uniqueness-based key rule.
UNIQUE_KEY_HINTS = ["id", "key", "code", "num", "no"]
UNIQUE_KEY_TYPES = ["string", "int", "uint"]


def storage_type_name(data_type: T.DataType) -> str:
    """Name of a Spark type as the rules know it."""
    if isinstance(data_type, T.DecimalType):
        return f"Decimal({data_type.precision}, {data_type.scale})"
    if isinstance(data_type, T.ArrayType):
        return f"Array({storage_type_name(data_type.elementType)})"
    return TYPE_NAMES.get(data_type.simpleString(), "String")


def type_family(type_name: str) -> str:
    """Join family of a type name: columns of one family have comparable values."""
    name = type_name.lower().replace("nullable(", "").replace(")", "")
    if name in NUMERIC_FAMILY:
        return "numeric"
    if "string" in name:
        return "string"
    return name


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the lower-cased text holds one of the words."""
    return F.lower(text).rlike("|".join(words))


def ends_with_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("(" + "|".join(words) + ")$")


def types_compatible(left: Column, right: Column) -> Column:
    """Same type, both in the numeric family, or both text."""

    def plain(name: Column) -> Column:
        return F.regexp_replace(F.lower(name), r"nullable\(|\)", "")

    a, b = plain(left), plain(right)
    return (
        (a == b)
        | (a.isin(NUMERIC_FAMILY) & b.isin(NUMERIC_FAMILY))
        | (a.contains("string") & b.contains("string"))
    )


def is_measure(table: Column, column: Column, type_name: Column) -> Column:
    """Name rule: does the column hold a measure (true) or describe a dimension (false)?"""
    return (
        F.when(contains_any(table, CALENDAR_TABLE_WORDS), F.lit(False))
        .when(contains_any(column, KEY_COLUMN_WORDS), F.lit(False))
        .when(contains_any(column, ATTRIBUTE_COLUMN_WORDS), F.lit(False))
        .when(contains_any(column, MEASURE_COLUMN_WORDS), F.lit(True))
        .otherwise(contains_any(type_name, MEASURE_TYPE_WORDS))
    )


def is_identifier_name(column: Column) -> Column:
    return ends_with_any(column, IDENTIFIER_ENDINGS)


def is_measure_name(column: Column) -> Column:
    return ends_with_any(column, MEASURE_ENDINGS)


def name_tokens(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), "[_-]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def name_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the word sets of two names; 0 when either is empty."""
    a, b = name_tokens(left), name_tokens(right)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / F.size(F.array_union(a, b))
    )
